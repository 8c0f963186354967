"""Figures per document that tell prose from lists, tables and junk.

Whole texts are measured in array operations over their code points, some
million characters at a time.  Tables show in delimiters that stand under one
another in neighbouring lines, lists in markers, in lines of like shape and in
indentation or lengths that come in turn; junk in symbols, broken characters,
repetition and missing words.  What the figures say together is learned:
boosted trees over all of them are fitted on a bounded sample of labelled
documents, beginning from a weak guess by rules.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import boosting

LETTER, HAN, DIGIT, SPACE, PUNCT, SYMBOL = 1, 2, 4, 8, 16, 32

#: Characters measured at a time, which bounds a worker's memory; one text is never split.
SLICE_CHARS = 1_000_000

KINDS = ("prose", "list", "table", "junk")

#: Labelled documents that the trees are fitted on at most, chosen by the hash of their id.
MAX_LABELS = 10_000

#: How much the guess by rules counts before anything is learned, in units of a score.
GUESS = 1.0

#: Characters by their part in a line.
BULLETS = "-*+•·‣▪◦●○■□–—☐☑✓✔"
CLOSERS = ".)）、．]】:：,"
OPENERS = "(（[【"
ENDS = ".!?。！？…‽؟"
QUOTES = "”’\"'»」』)）]】"
BROKEN = "\ufffd□▯▢¤§¶†‡¬¦¨¯´¸�"
CODE = "<>{}=\\&"

#: Distances in lines at which indents may come again.
PERIODS = (2, 3, 4, 5, 6)

FIGURES = (
    "n_chars n_words n_lines mean_word_length symbol_ratio digit_ratio punct_ratio end_punct_share common_word_share "
    "list_share table_share indent_share indent_periodicity length_autocorrelation repeated_line_share compressed_ratio broken_ratio mojibake_ratio "
    "code_ratio machine_line_share long_word_share inner_punct_ratio rule_line_share marker_ratio"
).split()

#: What the trees see.
SIGNALS = [*FIGURES, "_shown", "_scattered", "_inside_share", "_going_on_share", "_line_width", "_line_spread", "_monotonous", "_wordy"]

SCHEMA = "doc_id bigint, " + ", ".join(f"{n} {'bigint' if n.startswith('n_') else 'double'}" for n in FIGURES) + ", text_kind string"


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower form by code point."""
    kinds = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    by_category = {"L": LETTER, "M": LETTER, "N": DIGIT, "Z": SPACE, "P": PUNCT, "S": SYMBOL, "C": SPACE}
    for code in range(0x20000):
        char = chr(code)
        category = unicodedata.category(char)
        kinds[code] = SYMBOL if category in ("Co", "Cn") else by_category[category[0]]
        small = char.lower()
        if len(small) == 1:
            lower[code] = ord(small)
    for first, last in ((0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        kinds[first : last + 1] = HAN
    kinds[[ord(c) for c in BROKEN]] = SYMBOL
    return kinds, lower


@functools.lru_cache(maxsize=None)
def _flags(chars: str) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in chars]] = True
    return table


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _word_hash(word: str) -> int:
    return sum(ord(c) * pow(int(_BASE), i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)


class Vocabulary:
    """Common words of all languages, prepared for array lookup."""

    def __init__(self, words: list[str]):
        words = sorted({w.lower() for w in words if w})
        kinds, _ = _tables()
        han = [w for w in words if kinds[ord(w[0])] == HAN]
        spaced = np.array(sorted(_word_hash(w) for w in words if kinds[ord(w[0])] != HAN), np.uint64)
        self.spaced = spaced if len(spaced) else np.array([0], np.uint64)
        self.han: dict[int, np.ndarray] = {}
        for w in han:
            self.han.setdefault(len(w), []).append([ord(c) for c in w])
        self.first = _flags("".join(sorted({w[0] for w in han})))


def _found_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def measure(texts: list[str], words: Vocabulary) -> dict[str, np.ndarray]:
    """The figures of ``FIGURES`` for every text."""
    kinds, lower = _tables()
    n = len(texts)
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    stops = np.cumsum(sizes + 1)
    starts = stops - sizes - 1
    kind = kinds[np.minimum(code, 0x10FFFF)]
    per_doc = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)

    letters, han, digits, space = kind == LETTER, kind == HAN, kind == DIGIT, kind == SPACE
    shown = ~space
    n_shown, n_letters, n_han, n_digits = map(per_doc, (shown, letters, han, digits))
    n_punct, n_symbols = per_doc(kind == PUNCT), per_doc(kind == SYMBOL)
    safe = np.maximum(n_shown, 1)

    # Words: runs of letters and digits; a Han character counts as a word.
    alnum = letters | digits
    padded = np.concatenate(([False], alnum, [False]))
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    begin, end = edges[0::2], edges[1::2]
    word_doc = np.searchsorted(stops, begin, side="right")
    length = end - begin
    n_runs = np.bincount(word_doc, minlength=n)
    run_chars = np.bincount(word_doc, weights=length, minlength=n)
    long_chars = np.bincount(word_doc, weights=np.where(length > 24, length, 0), minlength=n)
    n_words = n_runs + n_han

    small = lower[np.minimum(code, 0x10FFFF)].astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(small * _powers(_BASE, len(small)), dtype=np.uint64)))
    hashes = (total[end] - total[begin]) * _powers(_INVERSE, len(small) + 1)[begin]
    common = np.bincount(word_doc, weights=_found_in(hashes, words.spaced), minlength=n)
    covered = np.zeros(len(code), bool)
    candidates = np.flatnonzero(words.first[np.minimum(code, 0x10FFFF)])
    for size, listed in words.han.items():
        at = candidates[candidates + size <= len(code)]
        for chars in listed:
            hit = at
            for offset, char in enumerate(chars):
                hit = hit[code[hit + offset] == char]
            for offset in range(size):
                covered[hit + offset] = True
    common = common + per_doc(covered & han)

    # Lines.
    breaks = np.flatnonzero(code == 10)
    line_start = np.concatenate(([0], breaks[:-1] + 1))
    line_doc = np.searchsorted(stops, line_start, side="right")
    per_line = lambda mask: np.add.reduceat(mask, line_start, dtype=np.int64)
    place = np.arange(len(code))
    size = per_line(shown)
    first = np.minimum.reduceat(np.where(shown, place, len(code)), line_start)
    last = np.maximum.reduceat(np.where(shown, place, -1), line_start)
    full = size > 0
    first = np.where(full, first, breaks)
    last = np.where(full, last, breaks)
    look = np.concatenate((code, np.full(8, 10, np.uint32)))
    c0, c1, c2, c3, c4 = (look[first + i] for i in range(5))
    is_digit = lambda c: (c >= 48) & (c <= 57)
    closes, opens = _flags(CLOSERS), _flags(OPENERS)
    blank = lambda c: kinds[c] == SPACE

    def closed(a, b):
        # 3.5 and 12:06 are no numbering.
        return closes[a] & ~is_digit(b)

    c5 = look[first + 5]
    numbered = is_digit(c0) & (closed(c1, c2) | (is_digit(c1) & (closed(c2, c3) | (is_digit(c2) & closed(c3, c4)))))
    enclosed = opens[c0] & is_digit(c1) & (closes[c2] | (is_digit(c2) & (closes[c3] | (is_digit(c3) & closes[c4]))))
    lettered = (kinds[c0] == LETTER) & ((c1 == 41) | (c1 == 46)) & blank(c2)
    circled = (c0 >= 0x2460) & (c0 <= 0x2473)
    checkbox = (c0 == 91) & (c2 == 93) & blank(c3)
    heading = (c0 == 35) & (blank(c1) | ((c1 == 35) & (blank(c2) | (c2 == 35))))
    bullet = _flags(BULLETS)[c0] & blank(c1) & (size > 1)
    item = (bullet | numbered | enclosed | circled | checkbox | lettered) & ~heading

    before_last = np.where(last > line_start, look[np.maximum(last - 1, 0)], 10)
    ends_flag, quote_flag = _flags(ENDS), _flags(QUOTES)
    ended = full & (ends_flag[look[last]] | (quote_flag[look[last]] & ends_flag[before_last]))

    # Delimiters under one another: the same count in a neighbouring line of the text.
    content = np.flatnonzero(full & ~heading)
    row_doc = line_doc[content]
    same_up = np.concatenate(([False], row_doc[1:] == row_doc[:-1]))
    same_down = np.concatenate((same_up[1:], [False]))

    def beside(test_up, test_down):
        return (same_up & test_up) | (same_down & test_down)

    def aligned(count):
        up, down = np.roll(count, 1), np.roll(count, -1)
        return beside(count == up, count == down)

    following = look[1 : len(code) + 1]
    tabs = per_line(code == 9)[content]
    pipes = per_line(code == 124)[content]
    semicolons = per_line((code == 59) & (following != 32))[content]
    commas = per_line((code == 44) & (following != 32))[content]
    row = ((tabs >= 1) & aligned(tabs)) | ((pipes >= 2) & aligned(pipes)) | ((semicolons >= 2) & aligned(semicolons)) | ((commas >= 2) & aligned(commas))
    # Columns made of spaces: places where a cell begins after a gap, in two neighbouring lines.
    gap = shown[2:] & (code[1:-1] == 32) & (code[:-2] == 32)
    cell = np.flatnonzero(gap) + 2
    line_of = np.searchsorted(line_start, cell, side="right") - 1
    rank = np.full(len(line_start), -1, np.int64)
    rank[content] = np.arange(len(content))
    cell_row, column = rank[line_of], cell - line_start[line_of]
    inner = (cell_row >= 0) & (cell > first[line_of])
    cell_row, column = cell_row[inner], column[inner]
    stride = int((breaks - line_start).max(initial=0)) + 1
    spots = np.sort(cell_row * stride + column)
    if len(spots):
        own_up = _found_in(spots - stride, spots) & same_up[spots // stride]
        own_down = _found_in(spots + stride, spots) & same_down[spots // stride]
        standing = np.bincount((spots // stride)[own_up | own_down], minlength=len(content))
        row |= standing >= 2
        single = (standing == 1) & aligned(np.minimum(standing, 1))
        cells = np.bincount(cell_row, minlength=len(content))
        row |= single & (cells >= 1)
        # A cell that overflows its column shifts those after it.
        for _ in range(3):
            row |= (cells >= 1) & beside(np.roll(row, 1), np.roll(row, -1))

    text_size = size[content]
    marks = item[content]
    sentence = ended[content]
    equals = per_line(code == 61)[content]
    machine = is_digit(c0[content]) & (equals >= 1) & (per_line((code == 91) | (code == 93))[content] >= 2)
    # A rule is a line of one and the same sign.
    signs = per_line((kind == PUNCT) | (kind == SYMBOL))[content]
    rule = (signs == text_size) & (text_size >= 3) & ~(row & (pipes >= 2))
    # Lines of like shape: short, without a sentence's end, beside another such line.
    width = text_size + per_line(han)[content]
    short = ~sentence & ~row & ~machine & ~rule & (width <= 45)
    plain_item = short & ((same_up & np.roll(short, 1)) & (same_down & np.roll(short, -1)) | beside(np.roll(short, 1) & np.roll(short, 2), np.roll(short, -1) & np.roll(short, -2)))
    items = (marks | plain_item) & ~row & ~machine & ~rule
    weight = lambda mask: np.bincount(row_doc, weights=np.where(mask, text_size, 0), minlength=n)
    body = np.maximum(weight(np.ones(len(content), bool)), 1)
    n_content = np.bincount(row_doc, minlength=n)
    share = lambda mask: np.bincount(row_doc, weights=mask, minlength=n) / np.maximum(n_content, 1)

    indent = (first - line_start)[content]
    indented = share((indent > 0) & beside(indent == np.roll(indent, 1), indent == np.roll(indent, -1)))
    # Correlation of each line's length with the next one's.
    x = np.log1p(text_size.astype(float))
    mean = np.bincount(row_doc, weights=x, minlength=n) / np.maximum(n_content, 1)
    centred = x - mean[row_doc]
    spread = np.bincount(row_doc, weights=centred**2, minlength=n)
    pairs = np.bincount(row_doc, weights=np.where(same_down, centred * np.roll(centred, -1), 0), minlength=n)
    autocorrelation = np.where(n_content < 3, 0, np.where(spread > 1e-9, pairs / np.maximum(spread, 1e-9), 1))
    # Periodicity: correlation of the indents with those some lines on, for the best of a few distances.
    deep = indent.astype(float)
    deep -= (np.bincount(row_doc, weights=deep, minlength=n) / np.maximum(n_content, 1))[row_doc]
    variety = np.bincount(row_doc, weights=deep**2, minlength=n)
    periodicity = np.zeros(n)
    for period in PERIODS:
        pair = np.flatnonzero(row_doc[period:] == row_doc[:-period])
        together = np.bincount(row_doc[pair], weights=deep[pair] * deep[pair + period], minlength=n)
        turns = (n_content >= 3 * period) & (variety > 1e-9)
        periodicity = np.maximum(periodicity, np.where(turns, together / np.maximum(variety, 1e-9) * n_content / np.maximum(n_content - period, 1), 0))
    # Wrapped prose has sentences that end inside a line, or lines that go on in small letters.
    stops_inside = per_line(ends_flag[look[: len(code)]] & ((kinds[np.minimum(following, 0x10FFFF)] == SPACE) | (kinds[np.minimum(following, 0x10FFFF)] == HAN)) & (following != 10) & (following != 13))[content]
    begins = look[first[content]]
    going_on = (kinds[begins] == LETTER) & (lower[begins] == begins) & (begins < 0x250)
    numbers = text_size.astype(float)
    average = np.bincount(row_doc, weights=numbers, minlength=n) / np.maximum(n_content, 1)
    deviation = np.sqrt(np.bincount(row_doc, weights=(numbers - average[row_doc]) ** 2, minlength=n) / np.maximum(n_content, 1))
    # Repeated lines: equal hashes within a text.
    line_hash = (total[breaks] - total[line_start]) * _powers(_INVERSE, len(small) + 1)[line_start]
    keys = line_hash[content] ^ (row_doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, index, counts = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = weight(counts[index] > 1)
    order = np.argsort(index, kind="stable")
    leads = np.zeros(len(content), bool)
    if len(content):
        leads[order[np.concatenate(([0], np.cumsum(counts)[:-1]))]] = True
    repeated = weight((counts[index] > 1) & ~leads)

    prior = np.concatenate(([10], code[:-1])).astype(np.uint32)
    second = ((following >= 0x80) & (following <= 0xBF)) | ((following >= 0x2010) & (following <= 0x2122)) | np.isin(following, (0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0x192, 0x2C6, 0x2DC))
    lead = np.isin(code, [ord(c) for c in "ÃÂÐÑÅÄ"]) | ((code >= 0xE2) & (code <= 0xE9))
    third = np.concatenate((second[1:], [False]))
    strict = np.isin(code, (0xC3, 0xC2, 0xD0, 0xD1))
    mojibake = lead & second & (strict | third)
    # Signs inside words; the two commonest of them may be a delimiter and part of a cell.
    between = (kinds[np.minimum(prior, 0x10FFFF)] == LETTER) & (kinds[np.minimum(following, 0x10FFFF)] == LETTER)
    inner = np.array([per_doc(between & (code == ord(c))) for c in ";/,."])
    inner_punct = np.sort(inner, axis=0)[:2].sum(axis=0)
    scattered = np.where((inner > 0).sum(axis=0) >= 3, np.sort(inner, axis=0)[:3].sum(axis=0), 0)
    twice = _flags("#$@!%&*~^")[np.minimum(code, 0x10FFFF)] & (code == following) & (code != prior)
    starts_line = np.concatenate(([True], code[:-1] == 10))
    marker = per_doc(twice & ~starts_line)

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n_raw = np.fromiter(map(len, raw), np.int64, n)
    n_packed = np.fromiter((len(zlib.compress(b, 1)) for b in raw), np.int64, n)
    return {
        "n_chars": sizes,
        "n_words": n_words,
        "n_lines": n_content,
        "mean_word_length": np.where(n_runs > 0, run_chars / np.maximum(n_runs, 1), 0.0),
        "symbol_ratio": n_symbols / safe,
        "digit_ratio": n_digits / safe,
        "punct_ratio": n_punct / safe,
        "end_punct_share": share(sentence),
        "common_word_share": common / np.maximum(n_words, 1),
        "list_share": weight(items) / body,
        "table_share": weight(row) / body,
        "indent_share": indented,
        "length_autocorrelation": autocorrelation,
        "repeated_line_share": repeated / body,
        "compressed_ratio": n_packed / np.maximum(n_raw, 1),
        "broken_ratio": per_doc(_flags(BROKEN)[np.minimum(code, 0x10FFFF)]) / safe,
        "mojibake_ratio": per_doc(mojibake) / np.maximum(n_letters, 1),
        "code_ratio": per_doc(_flags(CODE)[np.minimum(code, 0x10FFFF)]) / safe,
        "machine_line_share": weight(machine) / body,
        "long_word_share": long_chars / np.maximum(run_chars + n_han, 1),
        "inner_punct_ratio": inner_punct / np.maximum(n_letters + n_han, 1),
        "rule_line_share": weight(rule) / body,
        "marker_ratio": marker / np.maximum(n_words, 1),
        "_shown": n_shown,
        "_scattered": scattered / np.maximum(n_letters + n_han, 1),
        "indent_periodicity": periodicity,
        "_inside_share": share(stops_inside > 0),
        "_going_on_share": share(going_on),
        "_line_width": average,
        "_line_spread": deviation / np.maximum(average, 1),
        "_monotonous": (n_raw >= 100) & (n_packed < 30 + 0.06 * n_raw),
        "_wordy": n_letters + n_han,
    }


def first_guess(f: dict[str, np.ndarray]) -> np.ndarray:
    """Number of the kind (see ``KINDS``) by rules."""
    table = f["table_share"] > 0.5
    # Items without markers, wider than a short line or ended like sentences: the lines' shape over the whole text, where it isn't wrapped prose.
    rhythm, turns = f["length_autocorrelation"], f["indent_periodicity"] > 0.6
    itemised = (f["n_lines"] >= 5) & (f["_inside_share"] < 0.1) & (f["_going_on_share"] <= 0.5) & (f["_line_width"] <= 160) & (f["symbol_ratio"] < 0.05) & (f["punct_ratio"] < 0.15)
    even = (f["_line_spread"] <= 0.6) | (rhythm <= -0.5)
    shaped = itemised & (((f["end_punct_share"] < 0.1) & (even | turns)) | (turns & (np.abs(rhythm) >= 0.3) & (f["_going_on_share"] < 0.1)))
    listed = ~table & ((f["list_share"] > 0.5) | shaped)
    # One of these alone is found in prose of other languages, too.
    strange = (
        (f["symbol_ratio"] > 0.15).astype(int)
        + (f["punct_ratio"] > 0.4)
        + (f["mean_word_length"] > 12)
        + ((f["common_word_share"] < 0.02) & (f["n_words"] >= 20))
        + ((f["end_punct_share"] == 0) & (f["punct_ratio"] < 0.005) & ~listed)
    )
    junk = (
        ((strange >= 2) & ~table)
        | (f["_wordy"] + f["digit_ratio"] * f["_shown"] < 1)
        | (f["broken_ratio"] > 0.02)
        | (f["mojibake_ratio"] > 0.008)
        | (f["machine_line_share"] > 0.5)
        | (f["rule_line_share"] > 0.5)
        | (f["long_word_share"] > 0.4)
        | (f["inner_punct_ratio"] > 0.012)
        | (f["_scattered"] > 0.03)
        | (f["marker_ratio"] > 0.1)
        | (f["code_ratio"] > 0.06)
        | ((f["repeated_line_share"] > 0.5) & ~table & ~listed)
        | f["_monotonous"]
    )
    return np.where(junk, 3, np.where(table, 2, np.where(listed, 1, 0)))


def signals(f: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(f[name], float) for name in SIGNALS], axis=1)


def classify(f: dict[str, np.ndarray], model: boosting.Model | None = None) -> np.ndarray:
    """prose, list, table or junk by the figures; without a model by rules."""
    scores = np.eye(len(KINDS))[first_guess(f)] * GUESS
    if model is not None:
        scores = model.scores(signals(f), scores)
    return np.array(KINDS)[scores.argmax(axis=1)]


def _slices(batch):
    ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
    start = 0
    while start < len(texts):
        stop, chars = start + 1, len(texts[start])
        while stop < len(texts) and chars + len(texts[stop]) <= SLICE_CHARS:
            chars += len(texts[stop])
            stop += 1
        yield ids.slice(start, stop - start), texts[start:stop]
        start = stop


def fit_kinds(documents: DataFrame, labels: DataFrame, common_words: list[str], max_labels: int = MAX_LABELS) -> boosting.Model:
    """Trees fitted on the labelled documents (doc_id, text_kind), at most ``max_labels`` of them.

    Of several labels of a document the commonest counts, of equally common ones
    the first by name; labels of other names and of unknown documents are left
    out.  Without labels the rules decide.
    """
    counted = labels.filter(F.col("doc_id").isNotNull() & F.col("text_kind").isin(*KINDS)).groupBy("doc_id", "text_kind").agg(F.count(F.lit(1)).alias("n"))
    single = counted.groupBy("doc_id").agg(F.min_by("text_kind", F.struct(-F.col("n"), "text_kind")).alias("text_kind"))
    sample = single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    # The sample's size is bounded by max_labels, that of its figures with it.
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("text_kind", "text")

    def rows(batches):
        words = Vocabulary(common_words)
        for batch in batches:
            for kinds, texts in _slices(batch):
                f = measure(texts, words)
                yield pa.RecordBatch.from_arrays([kinds, pa.array(first_guess(f), pa.int32()), pa.array([r.tobytes() for r in signals(f)], pa.binary())], ["kind", "guess", "signals"])

    found = texts.mapInArrow(rows, "kind string, guess int, signals binary").collect()
    found.sort(key=lambda r: (r.signals, r.kind))
    x = np.array([np.frombuffer(r.signals) for r in found]).reshape(len(found), len(SIGNALS))
    wanted = np.array([KINDS.index(r.kind) for r in found], np.int64)
    return boosting.fit(x, wanted, len(KINDS), np.eye(len(KINDS))[np.array([r.guess for r in found], np.int64)] * GUESS)


def document_figures(documents: DataFrame, common_words: list[str], model: boosting.Model | None = None) -> DataFrame:
    """(doc_id, the figures, text_kind) for every row of ``documents`` (doc_id, text).

    A null text counts as empty; rows are neither lost nor doubled.
    ``common_words`` is a list of bounded size (a fixed table); ``model`` comes
    from ``fit_kinds``, and without it rules name the kind.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        words = Vocabulary(common_words)
        for batch in batches:
            for ids, texts in _slices(batch):
                figures = measure(texts, words)
                arrays = [pa.array(figures[name], pa.int64() if name.startswith("n_") else pa.float64()) for name in FIGURES]
                kind = pa.array(classify(figures, shared.value).tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([ids, *arrays, kind], ["doc_id", *FIGURES, "text_kind"])

    return documents.select("doc_id", "text").mapInArrow(rows, SCHEMA)
