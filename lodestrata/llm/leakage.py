"""Evaluation passages that leaked into a corpus, whole, in part or reworded.

Latent semantic retrieval.  Every document is read as overlapping passages,
each a TF-IDF vector over all its subwords (runs of four letters, pairs of Han
characters, hashed into ``TERMS`` coordinates).  A randomised SVD of all passages, summed
up over all partitions, gives the latent space.  Passages near an item in it
are candidates; nothing else is compared.  Candidates are then checked exactly:
the longest stretch of letters and digits that document and item share, and for
reworded passages the longest common subsequence of terms and the answer (the
item's telling terms that its question does not give away).

The corpus is read three times (document frequencies, SVD, search), the search
once more for every ``block_items`` items.  What reaches the driver is bounded
by the number of coordinates and dimensions, whatever corpus and items.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and digits of a cell; a passage is two cells, and begins at every cell.
CELL = 64
#: Letters of a coordinate of scripts with letters; a pair of Han characters is one, too.
GRAM = 4
#: Items of fewer letters and digits have too little for a passage; every text is a candidate for them.
SHORT = 24
#: Coordinates of the hashed terms, dimensions of the latent space, and those added while it is found.
TERMS, RANK, OVERSAMPLING = 1 << 14, 40, 8
#: Least cosine of a candidate, and of one whose wording is compared.
LEAST_COSINE, REWORDED_COSINE = 0.2, 0.75
#: Share of an item's terms in common order, and of its answer, that make a reworded passage.
LEAST_COMMON, LEAST_ANSWER = 0.6, 0.8
#: Terms that make up an answer: the item's numbers, then its rarest terms, without those of its question.
ANSWER_TERMS = 12
#: Longest gram that leads the search for stretches; shorter items have shorter ones.
GRAMS = (28, 14, 7, 3, 1)
#: Items of one search.
BLOCK_ITEMS = 4096
SLICE_CHARS = 1_000_000
_BLOCK = 512
#: Vectors gathered at once, passages compared with the items at once, and places that a term's sum takes at once.
_GATHERED, _COMPARED, _PIECE = 1 << 14, 1024, 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SCHEMA = "doc_id bigint, item_id bigint, kind string, shared_chars int, item_chars int, common_share double, answer_share double, cosine double"

@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower form of letters and digits by code point, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x40000):
        char = chr(code)
        if unicodedata.category(char)[0] in "LN":
            small = char.lower()
            table[code] = ord(small) if len(small) == 1 else code
    table[10] = 10  # ends every text
    return table


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(maxsize=1)
def _han() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for first, last in ((0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        table[first : last + 1] = True
    return table


@functools.lru_cache(maxsize=1)
def _digits() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[code for code in range(0x20000) if chr(code).isdigit()]] = True
    return table


class Slice:
    """Letters and digits of some texts, and where each text begins; and, when they are asked for, words and hashes of stretches."""

    def __init__(self, texts: list[str]):
        code = np.frombuffer("\n".join(t.replace("\n", " ") for t in [*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        small = _letters().take(code)
        self.shown = small > 0
        self.kept = small[self.shown]
        self.starts = np.concatenate(([0], np.flatnonzero(self.kept == 10) + 1))

    @functools.cached_property
    def han(self) -> np.ndarray:
        return _han().take(self.kept)

    @functools.cached_property
    def total(self) -> np.ndarray:
        """Sums of letters times powers of a base, up to every place."""
        out = np.zeros(len(self.kept) + 1, np.uint64)
        np.cumsum(self.kept * _powers(_BASE, len(self.kept)), dtype=np.uint64, out=out[1:])
        return out

    @functools.cached_property
    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and pairs of Han characters as hashes, and where each begins, in order of place."""
        # A word ends at anything that is no letter, and beside a Han character.
        apart = np.concatenate(([True], ~self.shown))[:-1][self.shown]
        wall = self.han | (self.kept == 10)
        begin = np.flatnonzero((apart | np.concatenate(([True], wall[:-1]))) & ~wall)
        walls = np.append(np.flatnonzero(wall), len(self.kept))
        end = np.minimum(np.append(begin[1:], len(self.kept)), walls[np.searchsorted(walls, begin)])
        back = _powers(_INVERSE, len(self.kept) + 1)
        pair = np.flatnonzero(self.han[:-1] & self.han[1:])
        place = np.concatenate((begin, pair))
        term = np.concatenate(((self.total[end] - self.total[begin]) * back[begin], (self.total[pair + 2] - self.total[pair]) * back[pair]))
        order = np.argsort(place, kind="stable")
        term = term[order]
        term ^= term >> np.uint64(31)
        term *= np.uint64(0x94D049BB133111EB)
        return term ^ (term >> np.uint64(29)), place[order]

    @property
    def term(self) -> np.ndarray:
        return self.terms[0]

    @property
    def place(self) -> np.ndarray:
        return self.terms[1]

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1

    def coordinates(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and their places, in order.

        A coordinate is a pair of Han characters or a run of GRAM other letters,
        whatever stands between them, so spaces and line breaks change nothing.
        """
        kept = np.concatenate((self.kept, np.full(GRAM, 10, np.uint32)))
        n = len(self.kept)
        mixed = kept[:n] * np.uint32(0x9E3779B1) + kept[1 : n + 1] * np.uint32(0x85EBCA6B)
        whole = (self.kept != 10) & (kept[1 : n + 1] != 10)
        pair = self.han
        longer = whole & ~pair
        run = mixed.copy()
        for k, factor in zip(range(2, GRAM), (0xC2B2AE35, 0x27D4EB2F)):
            letter = kept[k : n + k]
            run += letter * np.uint32(factor)
            longer &= letter != 10
        mixed = np.where(pair, mixed, run)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        place = np.flatnonzero((whole & pair) | longer)
        return (mixed[place] >> np.uint32(32 - TERMS.bit_length() + 1)).astype(np.uint16), place

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates, where those of each cell begin, and the number of cells before each text (every text has one)."""
        coordinate, place = self.coordinates()
        sizes = np.maximum(1, -(-(np.diff(self.starts) - 1) // CELL))
        before = np.concatenate(([0], np.cumsum(sizes)))
        first = np.repeat(self.starts[:-1] - before[:-1] * CELL, sizes) + np.arange(before[-1]) * CELL
        return coordinate, np.append(np.searchsorted(place, first), len(place)), before

    def grams(self, gram: int) -> np.ndarray:
        n = len(self.kept)
        if n < gram:
            return np.zeros(0, np.uint64)
        mixed = (self.total[gram:] - self.total[:-gram]) * _powers(_INVERSE, n)[: n - gram + 1]
        mixed ^= mixed >> np.uint64(29)
        return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _slices(batch):
    ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
    start = 0
    while start < len(texts):
        stop, chars = start + 1, len(texts[start])
        while stop < len(texts) and chars + len(texts[stop]) <= SLICE_CHARS:
            chars += len(texts[stop])
            stop += 1
        yield ids.slice(start, stop - start), Slice(texts[start:stop])
        start = stop


def _sums(begin: np.ndarray, coordinate: np.ndarray, table: np.ndarray, piece: int) -> np.ndarray:
    """For every row, which begins at ``begin``, the sum of its coordinates' vectors.

    Rows are filled up to whole pieces with a vector of zeros, since products with
    ones add pieces of one length several times faster than ``reduceat`` adds rows.
    """
    sizes = np.diff(begin)
    edges = np.concatenate(([0], np.cumsum(-(-sizes // piece))))
    filled = np.full(edges[-1] * piece, len(table), np.intp)
    filled[np.arange(len(coordinate)) + np.repeat(edges[:-1] * piece - begin[:-1], sizes)] = coordinate
    filled = filled.reshape(-1, piece)
    table = np.concatenate((table, np.zeros((1, table.shape[1]), table.dtype)))
    sums, ones, step = np.empty((len(filled), table.shape[1]), np.float32), np.ones((1, piece), np.float32), _GATHERED // piece
    # Some pieces at a time, so that the gathered vectors stay in the processor's cache.
    for at in range(0, len(filled), step):
        sums[at : at + step] = np.matmul(ones, table.take(filled[at : at + step], axis=0, mode="clip"))[:, 0]
    out = np.zeros((len(sizes), table.shape[1]), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = sums if len(sums) == len(full) else np.add.reduceat(sums, edges[full], axis=0)
    return out


def _passages(cells: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Every cell with the next one of its text; the last cell of a text stands alone."""
    out = cells.copy()
    goes_on = np.ones(len(cells), bool)
    goes_on[before[1:] - 1] = False
    goes_on = np.flatnonzero(goes_on)
    out[goes_on] += cells[goes_on + 1]
    return out


def _frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """Cells with each coordinate, and all cells, over the whole corpus."""

    def count(batches):
        seen, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, part in _slices(batch):
                coordinate, begin, before = part.cells()
                # Narrow numbers sort faster; only a text of very many letters needs wide ones.
                number = np.uint32 if before[-1] < 1 << 17 else np.uint64
                cell = np.repeat(np.arange(before[-1], dtype=number), np.diff(begin))
                key = np.sort(cell * number(TERMS) + coordinate)
                seen += np.bincount((key[np.flatnonzero(key[1:] != key[:-1])] & number(TERMS - 1)).astype(np.int64), minlength=TERMS)
                seen += np.bincount((key[-1:] & number(TERMS - 1)).astype(np.int64), minlength=TERMS)
                n += int(before[-1])
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([n, *seen[some]], pa.int64())], ["coordinate", "n"])

    rows = documents.mapInArrow(count, "coordinate bigint, n bigint").groupBy("coordinate").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(TERMS, np.int64)
    known = rows[rows.coordinate >= 0]
    seen[known.coordinate.to_numpy(np.int64)] = known.n.to_numpy(np.int64)
    return seen, int(rows[rows.coordinate < 0].n.sum())


def _latent_basis(documents: DataFrame, idf: np.ndarray, seed: int = 7) -> np.ndarray:
    """Coordinates by latent dimensions: the right singular vectors of all passages.

    With Y = A·Omega, each partition adds up YᵀY and YᵀA; the range's orthonormal
    basis is Y·R for an R that follows from YᵀY, so QᵀA = Rᵀ(YᵀA) and A is read once.
    """
    width = RANK + OVERSAMPLING

    def sums(batches):
        omega = np.random.default_rng(seed).standard_normal((TERMS, width), np.float32)
        weighted = omega * idf[:, None].astype(np.float32)
        square, products = np.zeros((width, width)), np.zeros((TERMS, width), np.float32)
        for batch in batches:
            for _, part in _slices(batch):
                coordinate, begin, before = part.cells()
                image = _passages(_sums(begin, coordinate, weighted, CELL), before)
                square += image.T.astype(float) @ image
                # A term's cell is in the passage that begins there and in the one before.
                double = image.copy()
                inner = np.ones(len(image), bool)
                inner[before[:-1]] = False
                inner = np.flatnonzero(inner)
                double[inner] += image[inner - 1]
                order = np.argsort(coordinate, kind="stable")
                cell = np.repeat(np.arange(before[-1]), np.diff(begin))
                products += _sums(np.searchsorted(coordinate[order], np.arange(TERMS + 1)), cell[order], double, _PIECE)
        products *= idf[:, None].astype(np.float32)
        blocks = [b for b in range(0, TERMS, _BLOCK) if products[b : b + _BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *blocks], pa.int64()), pa.array([square.tobytes(), *[products[b : b + _BLOCK].tobytes() for b in blocks]], pa.binary())], ["block", "data"]
        )

    def total(batches):
        # One running sum per block; nothing else is held.
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(data.as_py(), np.float64 if block < 0 else np.float32).astype(np.float64)
                kept[block] = kept[block] + part if block in kept else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.int64()), pa.array([v.astype(np.float64 if k < 0 else np.float32).tobytes() for k, v in kept.items()], pa.binary())], ["block", "data"]
        )

    schema = "block bigint, data binary"
    rows = documents.mapInArrow(sums, schema).repartition("block").mapInArrow(total, schema).collect()
    square, products = np.zeros((width, width)), np.zeros((TERMS, width))
    for r in rows:
        if r.block < 0:
            square += np.frombuffer(r.data, np.float64).reshape(width, width)
        else:
            part = np.frombuffer(r.data, np.float32).reshape(-1, width)
            products[r.block : r.block + len(part)] += part
    values, vectors = np.linalg.eigh(square)
    good = values > max(values.max(), 1e-12) * 1e-9
    small = products @ (vectors[:, good] / np.sqrt(values[good]))
    left, _, _ = np.linalg.svd(small, full_matrices=False)
    return left[:, :RANK].astype(np.float32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]


def _latent(part: Slice, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent vectors of all passages, of unit length, and the number of passages before each text."""
    coordinate, begin, before = part.cells()
    weighted = basis * idf[:, None].astype(np.float32)
    return _unit(_passages(_sums(begin, coordinate, weighted, CELL), before)), before


def _index(keys: np.ndarray, wanted: np.ndarray, end: int) -> np.ndarray:
    """Where each wanted number stands in ``keys`` (sorted, below ``end``), -1 where it doesn't."""
    if end <= 1 << 24:
        table = np.full(end, -1, np.int32)
        table[keys] = np.arange(len(keys))
        return table.take(wanted)
    at = np.searchsorted(keys, wanted)
    return np.where(np.append(keys, -1)[at] == wanted, at, -1)


class Items:
    """Items of one search: latent passages, and their grams by length of gram."""

    def __init__(self, ids: list[int], texts: list[str], questions: list[str], idf: np.ndarray, basis: np.ndarray):
        part = Slice(texts)
        self.ids = np.array(ids, np.int64)
        self.chars = np.diff(part.starts) - 1
        self.need = np.maximum(1, -(-self.chars // 2))
        self.latent, before = _latent(part, idf, basis)
        self.edges = before
        # Passages by their number within the item, those of items with many passages first: the ones of a number stand side by side.
        sizes = np.diff(before)
        by_size = np.argsort(-sizes, kind="stable")
        self.column = np.argsort(by_size)
        self.ranked = np.concatenate([self.latent[before[by_size[sizes[by_size] > k]] + k] for k in range(sizes.max())])
        self.ranks = np.concatenate(([0], np.cumsum([np.count_nonzero(sizes > k) for k in range(sizes.max())])))
        text = part.text_of(part.place)
        self.terms = [part.term[text == n] for n in range(len(ids))] if len(ids) < 64 else np.split(part.term, np.searchsorted(text, np.arange(1, len(ids))))
        asked = Slice(questions)
        asked_of = asked.text_of(asked.place)
        # How rare a term is, by the coordinate that it begins with.
        coordinate, at = part.coordinates()
        weights = np.append(idf[coordinate], 0)[np.minimum(np.searchsorted(at, part.place), len(at))]
        numeric = _digits()[np.minimum(part.kept[part.place], 0x10FFFF)]
        self.answers = []
        for n in range(len(ids)):
            mine = np.flatnonzero(text == n) if len(ids) < 64 else np.arange(*np.searchsorted(text, (n, n + 1)))
            terms, first = np.unique(part.term[mine], return_index=True)
            fresh = ~np.isin(terms, asked.term[asked_of == n])
            order = np.lexsort((terms[fresh], -weights[mine][first][fresh], ~numeric[mine][first][fresh]))
            self.answers.append(np.sort(terms[fresh][order[:ANSWER_TERMS]]))
        sizes = np.array([len(a) for a in self.answers], np.int64)
        self.least_answer = np.ceil(LEAST_ANSWER * sizes).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *self.answers])
        order = np.argsort(flat, kind="stable")
        self.answer_terms, first = np.unique(flat[order], return_index=True)
        self.answer_begin, self.answer_items = np.concatenate((first, [len(flat)])), np.repeat(np.arange(len(ids)), sizes)[order]
        self.answer_sizes, self.answer_keys = sizes, np.repeat(np.arange(len(first)), np.diff(self.answer_begin)) * len(ids) + self.answer_items
        self.answer_mask = np.zeros(1 << 20, bool)
        self.answer_mask[(self.answer_terms >> np.uint64(44)).astype(np.int64)] = True
        # The gram of an item is shorter than the half that is sought, so every such half holds one.
        gram_of = np.array([next((g for g in GRAMS if g <= max(1, n * 6 // 10)), 1) for n in self.need])
        self.classes = []
        for gram in sorted(set(gram_of[self.chars > 0].tolist())):
            hashes = part.grams(gram)
            place = np.arange(len(hashes))
            item = part.text_of(place)
            inside = (place + gram <= part.starts[item + 1] - 1) & (gram_of[item] == gram)
            hashes, item, place = hashes[inside], item[inside], (place - part.starts[item])[inside]
            order = np.argsort(hashes, kind="stable")
            keys, first = np.unique(hashes[order], return_index=True)
            mask = np.zeros(1 << 22, bool)
            mask[(keys >> np.uint64(42)).astype(np.int64)] = True
            self.classes.append((gram, keys, np.concatenate((first, [len(order)])), item[order], place[order], mask))

    def nearest(self, vectors: np.ndarray, before: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, cosine) of the texts and items whose nearest passages are candidates, by text and item."""
        found = []
        # Blocks of whole texts, and of the passages of these.
        cuts = np.unique(np.searchsorted(before, np.arange(0, before[-1], _COMPARED)))
        cuts = np.concatenate((cuts[cuts < len(before) - 1], [len(before) - 1]))
        for first, last in zip(cuts[:-1], cuts[1:]):
            best = np.full((last - first, len(self.ids)), -2, np.float32)
            for low in range(before[first], before[last], _COMPARED):
                high = min(low + _COMPARED, before[last])
                there = vectors[low:high].T
                cosine = self.ranked[: self.ranks[1]] @ there
                for begin, end in zip(self.ranks[1:-1], self.ranks[2:]):
                    np.maximum(cosine[: end - begin], self.ranked[begin:end] @ there, out=cosine[: end - begin])
                one, other = np.searchsorted(before, low, side="right") - 1, np.searchsorted(before, high)
                nearest = np.maximum.reduceat(cosine, np.maximum(before[one:other] - low, 0), axis=1).T
                np.maximum(best[one - first : other - first], nearest, out=best[one - first : other - first])
            best = best[:, self.column]
            best[:, self.chars < SHORT] = 1
            text, item = np.nonzero(best >= least)
            found.append((text + first, item, best[text, item]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3

    def between(self, vectors: np.ndarray, before: np.ndarray, text: int, item: int) -> np.ndarray:
        """Cosines of a text's passages and an item's, the same whatever else is searched (products of larger matrices may differ in the last digits)."""
        return vectors[before[text] : before[text + 1]] @ self.latent[self.edges[item] : self.edges[item + 1]].T

    def nearest_passage(self, vectors: np.ndarray, before: np.ndarray, text: int, item: int) -> int:
        return int(before[text] + np.argmax(self.between(vectors, before, text, item).max(axis=1)))

    def answer_hits(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Places of a slice's terms that stand in an answer, in order, and which of the answers' terms each is."""
        maybe = np.flatnonzero(self.answer_mask[(part.term >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.answer_terms, part.term[maybe]), max(len(self.answer_terms) - 1, 0))
        true = self.answer_terms[at] == part.term[maybe] if len(maybe) else np.zeros(0, bool)
        return part.place[maybe[true]], at[true]

    def answered(self, part: Slice, hits: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
        """Which of the wanted pairs (sorted keys text * items + item) have enough of the item's answer anywhere in the text."""
        once = np.unique(part.text_of(hits[0]) * len(self.answer_terms) + hits[1])
        if not len(once) or not len(wanted):
            return np.zeros(len(wanted), bool)
        text, which = once // len(self.answer_terms), once % len(self.answer_terms)
        times = self.answer_begin[which + 1] - self.answer_begin[which]
        spot = np.repeat(self.answer_begin[which] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        place = _index(wanted, np.repeat(text, times) * len(self.ids) + self.answer_items[spot], (len(part.starts) - 1) * len(self.ids))
        counts = np.bincount(place[place >= 0], minlength=len(wanted))
        return (counts >= self.least_answer[wanted % len(self.ids)]) & (counts > 0)

    def answer_shares(self, hits: tuple[np.ndarray, np.ndarray], item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Shares of the items' answers that stand between two places, for any number of items with their places."""
        first, last = np.searchsorted(hits[0], low), np.searchsorted(hits[0], high)
        counts = np.zeros(len(item), np.int64)
        # Some items at a time, so that the hits between their places stay few.
        ends = np.cumsum(last - first)
        cuts = np.unique(np.concatenate((np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, 1 << 20)), [len(item)])))
        for one, other in itertools.pairwise(np.unique(np.append(0, cuts)).tolist()):
            times = (last - first)[one:other]
            source = np.repeat(np.arange(one, other), times)
            spot = np.repeat(first[one:other] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(len(source))
            key = hits[1][spot] * len(self.ids) + item[source]
            at = np.minimum(np.searchsorted(self.answer_keys, key), len(self.answer_keys) - 1)
            true = self.answer_keys[at] == key
            once = np.unique(source[true] * len(self.answer_keys) + at[true])
            counts += np.bincount(once // len(self.answer_keys), minlength=len(item))
        return counts / np.maximum(1, self.answer_sizes[item])

    def stretches(self, part: Slice, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, longest stretch in common) of wanted pairs, sorted keys text * items + item; pairs without a common gram are left out."""
        n = len(self.ids)
        out = [(np.zeros(0, np.int64),) * 3]
        for gram, keys, begin, items, places, mask in self.classes:
            hashes = part.grams(gram)
            maybe = np.flatnonzero(mask[(hashes >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
            true = keys[at] == hashes[maybe]
            place, which = maybe[true], at[true]
            times = begin[which + 1] - begin[which]
            source = np.repeat(np.arange(len(which)), times)
            spot = np.repeat(begin[which] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(len(source))
            text, item = part.text_of(place)[source], items[spot]
            pair = text * n + item
            keep = _index(wanted, pair, (len(part.starts) - 1) * n) >= 0
            pair, here, there = pair[keep], place[source][keep], places[spot[keep]]
            if not len(pair):
                continue
            order = np.lexsort((here, here - there, pair))
            pair, here, diagonal = pair[order], here[order], (here - there)[order]
            breaks = np.concatenate(([True], (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1]) | (here[1:] != here[:-1] + 1)))
            first = np.flatnonzero(breaks)
            length = np.diff(np.concatenate((first, [len(here)]))) + gram - 1
            key, index = np.unique(pair[first], return_inverse=True)
            best = np.zeros(len(key), np.int64)
            np.maximum.at(best, index, length)
            out.append((key // n, key % n, best))
        return tuple(np.concatenate(x) for x in zip(*out))


def common_terms(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits: one word of arithmetic per term of ``a``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        match = row & places.get(x, 0)
        row = ((row + match) | (row - match)) & full
    return len(b) - row.bit_count()


def _found(items: Items, idf: np.ndarray, basis: np.ndarray, ids: pa.Array, part: Slice, least_cosine: float) -> pa.RecordBatch:
    vectors, before = _latent(part, idf, basis)
    text, item, cosine = items.nearest(vectors, before, least_cosine)
    pair = text * len(items.ids) + item
    t, i, best = items.stretches(part, pair)
    shared = np.zeros(len(pair), np.int64)
    shared[np.searchsorted(pair, t * len(items.ids) + i)] = best
    exact = (shared >= items.need[item]) & (items.chars[item] > 0)
    rows = [(k, "stretch", None, None) for k in np.flatnonzero(exact)]
    maybe = np.flatnonzero(~exact & (cosine >= REWORDED_COSINE))
    hits = items.answer_hits(part)
    maybe = maybe[items.answered(part, hits, pair[maybe])]
    # Around the nearest passage, as much text on either side of it as the item is long.
    passage = np.array([items.nearest_passage(vectors, before, t, i) for t, i in zip(text[maybe].tolist(), item[maybe].tolist())], np.int64)
    middle = part.starts[text[maybe]] + (passage - before[text[maybe]]) * CELL
    low = np.maximum(part.starts[text[maybe]], middle - items.chars[item[maybe]])
    high = np.minimum(part.starts[text[maybe] + 1], middle + 2 * CELL + items.chars[item[maybe]])
    answered = items.answer_shares(hits, item[maybe], low, high)
    for n in np.flatnonzero(answered >= LEAST_ANSWER):
        terms = items.terms[item[maybe[n]]]
        # The item's terms that stand in the same order there.
        common = common_terms(terms, part.term[slice(*np.searchsorted(part.place, (low[n], high[n])))]) / len(terms)
        if common >= LEAST_COMMON:
            rows.append((maybe[n], "reworded", common, float(answered[n])))
    at = np.array([r[0] for r in rows], np.int64)
    near = [1.0 if items.chars[item[k]] < SHORT else float(items.between(vectors, before, int(text[k]), int(item[k])).max()) for k in at.tolist()]
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(text[at], pa.int64())),
            pa.array(items.ids[item[at]], pa.int64()),
            pa.array([r[1] for r in rows], pa.string()),
            pa.array(shared[at], pa.int32()),
            pa.array(items.chars[item[at]], pa.int32()),
            pa.array([r[2] for r in rows], pa.float64()),
            pa.array([r[3] for r in rows], pa.float64()),
            pa.array(near, pa.float64()),
        ],
        [f.split()[0] for f in SCHEMA.split(", ")],
    )


def _blocks(items: DataFrame, size: int):
    """Items once each, ``size`` at a time, in order."""
    question = F.col("question") if "question" in items.columns else F.lit(None).cast("string")
    rows = items.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min(F.struct("text", question.alias("question"))).alias("i"))
    rows = rows.select("item_id", "i.text", "i.question").orderBy("item_id").toLocalIterator()
    while block := list(itertools.islice(rows, size)):
        yield block


def leaks(documents: DataFrame, items: DataFrame, least_cosine: float = LEAST_COSINE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, kind, shared_chars, item_chars, common_share, answer_share, cosine), one row per document row and item that leaked into it.

    ``documents`` has doc_id and text, ``items`` item_id, text and perhaps
    question.  ``stretch``: the document holds at least half of the item in one
    stretch; only letters and digits count, without case.  ``reworded``: it does
    not, but ``LEAST_COMMON`` of the item's terms stand in the same order near a
    passage of it that has ``LEAST_ANSWER`` of its answer.  Items are searched
    ``block_items`` at a time, any number of them.  Null and empty texts match
    nothing; repeated items count once; every document row is searched.
    """
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    found = spark.createDataFrame([], SCHEMA)
    space = None
    for block in _blocks(items, block_items):
        if space is None:
            seen, n = _frequencies(documents)
            idf = np.log1p(n / np.maximum(1, seen))
            space = idf, _latent_basis(documents, idf)
        prepared = Items([r.item_id for r in block], [r.text for r in block], [r.question or "" for r in block], *space)
        shared = spark.sparkContext.broadcast((prepared, *space))

        def search(batches, shared=shared):
            prepared, idf, basis = shared.value
            for batch in batches:
                for ids, part in _slices(batch):
                    yield _found(prepared, idf, basis, ids, part, least_cosine)

        found = found.unionByName(documents.mapInArrow(search, SCHEMA))
    return found
