"""Boosted trees of small depth over a table of figures, fitted on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Steps of the fit: trees per class, levels, size of a step, cuts per figure, least examples of a leaf, and what holds leaves near zero.
ROUNDS, DEPTH, RATE, CUTS, LEAST, HOLD = 30, 3, 0.35, 32, 6, 2.0


@dataclass
class Model:
    """Trees as complete binary heaps: a figure and a threshold per inner node, a value per leaf."""

    figures: np.ndarray  # rounds, classes, inner nodes
    thresholds: np.ndarray
    values: np.ndarray  # rounds, classes, leaves

    def scores(self, x: np.ndarray, prior: np.ndarray) -> np.ndarray:
        out = prior.astype(float).copy()
        rows = np.arange(len(x))
        inner = self.figures.shape[2]
        for figures, thresholds, values in zip(self.figures, self.thresholds, self.values):
            for k in range(len(figures)):
                if not values[k].any():
                    continue
                node = np.zeros(len(x), np.int64)
                while len(node) and node[0] < inner:
                    node = 2 * node + 1 + (x[rows, figures[k][node]] > thresholds[k][node])
                out[:, k] += values[k][node - inner]
        return out


def _tree(bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray):
    inner, n_figures = 2**DEPTH - 1, bins.shape[1]
    figures, thresholds = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(bins), np.int64)
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        local = node - first
        best = np.full(width, 1e-9)
        chosen = np.zeros((width, 2), np.int64) - 1
        for f in range(n_figures):
            size = len(cuts[f]) + 1
            if size < 2:
                continue
            key = local * size + bins[:, f]
            g, h, n = (np.bincount(key, weights=w, minlength=width * size).reshape(width, size).cumsum(axis=1) for w in (slope, curve, None))
            whole = g[:, -1:] ** 2 / (h[:, -1:] + HOLD)
            gain = g**2 / (h + HOLD) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + HOLD) - whole
            gain[(n < LEAST) | (n[:, -1:] - n < LEAST)] = 0
            at = gain.argmax(axis=1)
            better = gain[np.arange(width), at] > best
            best[better] = gain[np.arange(width), at][better]
            chosen[better] = np.stack((np.full(width, f), at), axis=1)[better]
        right = np.zeros(len(bins), np.int64)
        for k in np.flatnonzero(chosen[:, 0] >= 0):
            f, at = chosen[k]
            figures[first + k], thresholds[first + k] = f, cuts[f][at]
            mine = local == k
            right[mine] = bins[mine, f] > at
        node = 2 * node + 1 + right
    leaf = node - inner
    g, h = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (slope, curve))
    return figures, thresholds, -RATE * g / (h + HOLD), leaf


def fit(x: np.ndarray, labels: np.ndarray, classes: int, prior: np.ndarray) -> Model:
    """Trees that add to the ``prior`` scores (rows by classes) so that the softmax gives the ``labels``.

    Too few examples for a split leave the prior as it is.  The same table gives
    the same model.
    """
    cuts = []
    for column in x.T:
        edges = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) if len(column) else np.zeros(0)
        cuts.append(edges[edges < column.max()] if len(column) else edges)
    bins = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1) if len(x) else np.zeros((0, x.shape[1]), np.int64)
    inner = 2**DEPTH - 1
    model = Model(np.zeros((ROUNDS, classes, inner), np.int64), np.full((ROUNDS, classes, inner), np.inf), np.zeros((ROUNDS, classes, inner + 1)))
    if len(x) < 2 * LEAST:
        return model
    scores = prior.astype(float).copy()
    wanted = labels[:, None] == np.arange(classes)
    for round_no in range(ROUNDS):
        chance = np.exp(scores - scores.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        for k in range(classes):
            slope, curve = chance[:, k] - wanted[:, k], np.maximum(chance[:, k] * (1 - chance[:, k]), 1e-6)
            figures, thresholds, values, leaf = _tree(bins, cuts, slope, curve)
            model.figures[round_no, k], model.thresholds[round_no, k], model.values[round_no, k] = figures, thresholds, values
            scores[:, k] += values[leaf]
    return model
