"""The main body of web pages, by differencing pages of near URLs.

All pages are put in one order of (host, URL path) and cut into blocks that
overlap by ``NEAREST`` pages at their ends, so that every page meets the same
neighbours wherever the cuts fall.  Each page is aligned with its neighbours by
longest common subsequence of lines.  Lines that neighbours share are the
site's.  What differencing says of a wording, of a frame (``Next: ...``,
``... →``) and of a label (``Home``), summed over all hosts, judges pages
without neighbours and lines that differ on every page; lines that name another
page are links to it.  No list of wordings is used.

Only hashes of lines travel; texts are read once and never shuffled.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage

#: Neighbours on either side, and pages of one block.
NEAREST, BLOCK_PAGES = 4, 256

#: Share of neighbours that have a line, from which it is the site's; the same over all hosts (of list items, which bodies have too, more); and occurrences needed for that.
LEAST_SHARE, LEAST_RATIO, ITEM_MORE, LEAST_LINES = 0.5, 0.22, 0.1, 4

#: Learned keys that are sent to every task as one table (16 bytes each); more of them are joined.
KEYS_SENT = 1_000_000

#: A line that a page repeats more often than this is aligned by the number of its repetition.
REPEATS = 64

_DIGITS = re.compile(r"\d+")
#: Characters that show nothing and are no spaces.
_HIDDEN = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb\U000e0001-\U000e007f]")
_NAME = re.compile(r"\s(?:[·|–—\-•»:])\s([^·|–—•»]{2,40})$")
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’»」』）)]*$")
_ITEM = re.compile(r"^(?:[-*•·‣▪◦–+]|\d{1,3}[.)、])\s*")
_HEADING = re.compile(r"^#{1,6} ")
_LEAD = re.compile(r"^([^:：。，,.!?]{1,30})[:：]\s*\S")
_SEPARATED = re.compile(r"\s*(?:\||·|/|•|»|>|›|\s{2,}|\t|、|[,，。！？；]|[.!?;](?=\s|$))\s*")
_OWNER = regex.compile(r"^(?:©|\(c\)|copyright)\s*(?:\d{4}(?:\s*[-–]\s*\d{4})?)?\s*(.{2,40}?)(?:\s+\p{Han}{4}|[.,].*)?$", regex.I)
_HAN, _LETTER = re.compile("[\u3400-\u9fff\U00020000-\U0003ffff]"), re.compile(r"[^\W\d_]")
_WRITING = re.compile(r"[，,;；]")

HEADING, ITEM, SENTENCE, WRITING, WIDE, SUBJECT, MARKED = 1, 2, 4, 8, 16, 32, 64

#: Kinds of the other keys of a line: a frame, a label, and the words before its colon (looked up as a wording).
FRAME, LABEL, LEAD = 0, 1, 2

_NARROW = np.uint64((1 << 48) - 1)


def plain(line: str) -> str:
    if not line.isascii():
        line = _HIDDEN.sub(" ", unicodedata.normalize("NFKC", line))
    return " ".join(line.split())


def key_of(kind: str, words: str) -> int:
    """48 bits; ``kind`` keeps wordings, frames and labels apart."""
    return xxhash.xxh64_intdigest(f"{kind}\u0000{words}") & int(_NARROW)


def wording(text: str, name: str) -> str:
    """A line (as ``plain`` gives it) without case, digits and the site's name."""
    text = text.casefold()
    return _DIGITS.sub("0", text.replace(name, "\u0001") if name else text)


def page_name(title: str | None, lines: list[str]) -> str:
    """What a page calls its site: the ending of its title, else the owner in a copyright line."""
    found = _NAME.search(plain(title or ""))
    if found:
        return found.group(1).strip().casefold()
    for line in lines:
        owner = _OWNER.match(line)
        if owner:
            return owner.group(1).strip().casefold()
    return ""


def labels_of(words: str) -> list[str]:
    """The parts of a menu, a trail, a row of tags, the phrases of a sentence; of a short line, the line."""
    if len(words) > 160:
        return []
    parts = [p for p in _SEPARATED.split(words) if p]
    if len(parts) < 2 or max(map(len, parts)) > 40:
        parts = [words] if len(words) <= 24 else []
        spaced = words.split(" ")
        if 2 <= len(spaced) <= 8 and len(words) <= 60 and _HAN.search(words):
            parts = spaced
    return [p for p in parts if _LETTER.search(p)]


def frames_of(words: str, heading: bool) -> list[str]:
    """What a line has around its varying part: words before a colon, a sign at either end."""
    found = []
    lead = _LEAD.match(words)
    if lead and len(words) < 120:
        found.append(lead.group(1).strip() + ":")
    first, last = words[0], words[-1]
    if not heading and (first in "«»‹›#" or unicodedata.category(first)[0] == "S"):
        found.append("^" + first)
    if last in "«»‹›" or unicodedata.category(last)[0] == "S":
        found.append("$" + last)
    return found


@dataclass
class Page:
    """The non-blank lines of a page: numbers from 1, keys of wordings, flags, marks; and other keys as (line, kind, key)."""

    numbers: np.ndarray
    keys: np.ndarray
    flags: np.ndarray
    others: np.ndarray

    def packed(self) -> tuple[bytes, bytes]:
        lines = np.zeros(len(self.keys), [("n", "<u4"), ("lo", "<u4"), ("hi", "<u2"), ("f", "u1")])
        lines["n"], lines["lo"], lines["hi"], lines["f"] = self.numbers, self.keys & 0xFFFFFFFF, self.keys >> 32, self.flags
        # Numbers as steps, which compress.
        lines["n"][1:] = np.diff(self.numbers)
        return lines.tobytes(), self.others.tobytes()


OTHER = np.dtype([("line", "<u4"), ("kind", "u1"), ("lo", "<u4"), ("hi", "<u2")])


def unpacked(lines: bytes, others: bytes) -> Page:
    a = np.frombuffer(lines, [("n", "<u4"), ("lo", "<u4"), ("hi", "<u2"), ("f", "u1")])
    return Page(np.cumsum(a["n"].astype(np.int64)), a["lo"].astype(np.int64) | (a["hi"].astype(np.int64) << 32), a["f"].copy(), np.frombuffer(others, OTHER))


def other_keys(others: np.ndarray) -> np.ndarray:
    return others["lo"].astype(np.int64) | (others["hi"].astype(np.int64) << 32)


class Reader:
    """Reads pages; wordings of lines that come again are kept for the batch."""

    def __init__(self):
        self.seen: dict[str, tuple] = {}

    def line(self, text: str, name: str) -> tuple:
        """(key, flags without SUBJECT, other keys) of a plain line."""
        known = (text, name if name and name in text.casefold() else "")
        found = self.seen.get(known)
        if found is not None:
            return found
        heading = bool(_HEADING.match(text))
        mark = None if heading else _ITEM.match(text)
        words = wording(text[mark.end() :] if mark else text, known[1])
        flags = HEADING * heading | ITEM * bool(mark) | SENTENCE * bool(_SENTENCE.search(text)) | WIDE * (len(text) > 90)
        flags |= WRITING * bool(flags & (SENTENCE | HEADING | ITEM) or " --" in text or len(text) > 60 or _WRITING.search(text))
        flags |= MARKED * (" --" in text)
        others = []
        if words and not heading:
            for frame in frames_of(words, heading):
                others.append((FRAME, key_of("f", frame)))
                if frame.endswith(":"):
                    others.append((LEAD, key_of("w", frame[:-1])))
            others.extend((LABEL, key_of("l", label)) for label in labels_of(words))
        found = key_of("w", words), flags, others
        if len(self.seen) > 50_000:
            self.seen.clear()
        self.seen[known] = found
        return found

    def page(self, title: str | None, content: str | None) -> tuple[Page, int]:
        """The page, and the key of its title as a line of another page would have it (0 without one)."""
        shown = [(n, text) for n, text in enumerate(map(plain, (content or "").split("\n")), 1) if text]
        name = page_name(title, [text for _, text in shown])
        named = plain(title or "")
        headings = [i for i, (_, text) in enumerate(shown) if text.startswith("# ")]
        own = [i for i in headings if named and named.startswith(shown[i][1][2:].strip())]
        alike = [i for i, (_, text) in enumerate(shown) if named and len(text) > 8 and named.startswith(text)]
        head = (own or headings or alike or [-1])[0]
        rows = [self.line(text, name) for _, text in shown]
        flags = [r[1] for r in rows]
        others = [(i, *k) for i, r in enumerate(rows) for k in r[2]]
        subject = wording(shown[head][1].lstrip("# "), "") if head >= 0 else ""
        if head >= 0:
            flags[head] |= SUBJECT
            # Where a line ends in the page's own subject, that part is no label.
            own_label = key_of("l", subject)
            others = [(i, kind, k) for i, kind, k in others if not (kind == LABEL and k == own_label and i != head)]
        packed = np.zeros(len(others), OTHER)
        if others:
            keys = np.array([k for _, _, k in others], np.int64)
            packed["line"], packed["kind"] = [i for i, _, _ in others], [kind for _, kind, _ in others]
            packed["lo"], packed["hi"] = keys & 0xFFFFFFFF, keys >> 32
        ending = _NAME.search(named)
        title_words = wording(named[: ending.start()] if ending else named, "")
        page = Page(np.array([n for n, _ in shown], np.int64), np.array([r[0] for r in rows], np.int64), np.array(flags, np.uint8), packed)
        return page, key_of("w", title_words) if title_words else 0


def url_order(url: str | None) -> str:
    """The path of a URL as a text whose order puts neighbours together, numbers by value."""
    path = re.sub(r"^[a-z][a-z0-9+.\-]*://[^/?#]*", "", url or "", flags=re.I)
    parts = re.split(r"[/?#&=_.\-]", path)
    return "\u0001".join(f"1{len(p.lstrip('0')):04}{p.lstrip('0')}" if p.isascii() and p.isdigit() else f"0{p}" for p in parts)


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of ``a`` and ``b``."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    places: dict = {}
    for j in range(start, len(b)):
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    nodes: list[tuple] = []
    for i in range(start, len(a)):
        for j in reversed(places.get(a[i], ())):
            at = bisect.bisect_left(tails, j)
            node = (i, j, nodes[at - 1] if at else None)
            if at == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[at] = j
                nodes[at] = node
    found, node = [], nodes[-1] if nodes else None
    while node:
        found.append(node[:2])
        node = node[2]
    return [(k, k) for k in range(start)] + found[::-1]


def _sequence(keys: np.ndarray) -> list:
    counts: dict = {}
    out = []
    for k in keys.tolist():
        n = counts[k] = counts.get(k, 0) + 1
        # Only a line repeated very often would make the alignment quadratic.
        out.append(k if n <= REPEATS else (k, n))
    return out


def compare(pages: list[Page], sites: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For pages in order: how many neighbours share each line and each other key, and how many neighbours there are."""
    sequences = [_sequence(p.keys) for p in pages]
    sets = [set(zip(p.others["kind"].tolist(), other_keys(p.others).tolist())) for p in pages]
    shared = [np.zeros(len(p.keys), np.int32) for p in pages]
    shared_others = [np.zeros(len(p.others), np.int32) for p in pages]
    near = [0] * len(pages)
    others = [list(zip(p.others["kind"].tolist(), other_keys(p.others).tolist())) for p in pages]
    for i in range(len(pages)):
        for j in range(i + 1, min(i + 1 + NEAREST, len(pages))):
            # Repeated fetches of one page say nothing about the site.
            if sites[i] != sites[j] or sequences[i] == sequences[j]:
                continue
            near[i] += 1
            near[j] += 1
            for x, y in common_lines(sequences[i], sequences[j]):
                shared[i][x] += 1
                shared[j][y] += 1
            for one, two in ((i, j), (j, i)):
                shared_others[one] += np.fromiter((k in sets[two] for k in others[one]), np.int32, len(others[one]))
    return list(zip(shared, shared_others, near))


def judge(page: Page, shared: np.ndarray, shared_others: np.ndarray, near: int, known: dict[int, int]) -> dict[int, str]:
    """Line numbers that are not main body, each with what tells so.

    ``known`` has the learned keys: 1 the site's even as a list item, 2 the site's otherwise, 3 the title of another page.
    """
    n = len(page.keys)
    heading, item = (page.flags & HEADING) > 0, (page.flags & ITEM) > 0
    subject = np.flatnonzero(page.flags & SUBJECT)
    head = int(subject[0]) if len(subject) else -1
    reason: dict[int, str] = {}
    keys = page.keys.tolist()
    by_line: dict[int, list[tuple[int, int, int]]] = {}
    for line, kind, key, count in zip(page.others["line"].tolist(), page.others["kind"].tolist(), other_keys(page.others).tolist(), shared_others.tolist()):
        by_line.setdefault(line, []).append((kind, key, count))
    titled = []
    for i in range(n):
        if heading[i] or i == head:
            continue
        learned = known.get(keys[i])
        others = by_line.get(i, ())
        if near >= 2 and shared[i] >= LEAST_SHARE * near:
            reason[i] = "neighbours"
        elif learned == 1 or (learned == 2 and not item[i]):
            reason[i] = "wording"
        elif not item[i] and any(kind == FRAME and near >= 2 and count >= LEAST_SHARE * near for kind, _, count in others):
            reason[i] = "frame of neighbours"
        elif not item[i] and any(kind != LABEL and known.get(key) in (1, 2) for kind, key, _ in others):
            reason[i] = "frame"
        else:
            labels = [known.get(key) in (1, 2) or (near >= 2 and count >= LEAST_SHARE * near) for kind, key, count in others if kind == LABEL]
            # One label of a menu may be unknown; a sentence must consist of known phrases.
            spare = len(labels) > 2 and not page.flags[i] & SENTENCE
            if labels and not item[i] and sum(labels) >= len(labels) - spare:
                reason[i] = "labels"
            elif learned == 3:
                titled.append(i)
    # A title among the page's own lines may be chance; one beside the site's lines or another title is a link.
    beside = set(reason) | set(titled)
    for i in titled:
        if i < head or i - 1 in beside or i + 1 in beside:
            reason[i] = "title"
    # A block: lines of one style between lines of the site.
    run: list[int] = []
    style, opened = None, False
    for i in range(max(head + 1, 0), n + 1):
        if i == n or i in reason:
            if opened:
                reason |= {k: "block" for k in run}
            run = []
            # A title inside a block goes on with it.
            if i == n or reason[i] != "title":
                style, opened = None, True
        elif opened:
            style = bool(item[i]) if style is None else style
            if heading[i] or bool(item[i]) != style or page.flags[i] & (SENTENCE | WIDE | MARKED):
                opened = False
            else:
                run.append(i)
    # Before the heading and after the last line of own writing everything is the site's.
    for i in range(head):
        reason.setdefault(i, "place")
    last = max((i for i in range(max(head, 0), n) if i not in reason and (i == head or page.flags[i] & WRITING)), default=head)
    for i in range(last + 1, n):
        reason.setdefault(i, "place")
    return {int(page.numbers[i]): why for i, why in reason.items()}


_READ = "page_id bigint, version bigint, fetched_at timestamp, site string, place string, title_key bigint, lines binary, others binary"
_COMPARED = "page_id bigint, version bigint, title_key bigint, lines binary, others binary, shared binary, near int"


def _read(batches):
    for batch in batches:
        reader, out = Reader(), []
        for page_id, version, url, site, title, content in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))):
            page, title_key = reader.page(title, content)
            # A page without site stands alone.
            out.append((page_id, version, f"\u0001{page_id}" if site is None else site, url_order(url), title_key, *page.packed()))
        ids, versions, sites, places, titles, lines, others = zip(*out) if out else ((),) * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), batch.column(2), pa.array(sites, pa.string()), pa.array(places, pa.string()), pa.array(titles, pa.int64()), pa.array(lines, pa.binary()), pa.array(others, pa.binary())],
            ["page_id", "version", "fetched_at", "site", "place", "title_key", "lines", "others"],
        )


def _compare_blocks(batches):
    """Rows by block and place; one block is held at a time."""

    def done(rows):
        pages = [unpacked(r[6], r[7]) for r in rows]
        out = []
        for row, (shared, others, near) in zip(rows, compare(pages, [r[5] for r in rows])):
            if row[1]:
                counts = np.concatenate((shared, others)).astype(np.uint8)
                out.append((row[2], row[3], row[4], row[6], row[7], counts.tobytes(), near))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        columns = zip(*out) if out else ((),) * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["page_id", "version", "title_key", "lines", "others", "shared", "near"])

    current, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if rows and row[0] != current:
                yield done(rows)
                rows = []
            current = row[0]
            rows.append(row)
    if rows:
        yield done(rows)


def _tally(batches):
    """(key, shared, compared, lines, titles) summed over a batch, for keys of wordings, frames and labels."""
    for batch in batches:
        keys, shares, nears, ones, titles = [], [], [], [], []
        for title_key, lines, others, shared, near in zip(*(batch.column(i).to_pylist() for i in range(5))):
            page, counts = unpacked(lines, others), np.frombuffer(shared, np.uint8)
            counted = page.others["kind"] != LEAD
            own = np.concatenate((page.keys, other_keys(page.others)[counted]))
            keys.append(np.concatenate((own, [title_key])))
            shares.append(np.concatenate((counts[: len(page.keys)], counts[len(page.keys) :][counted], [0])))
            nears.append(np.append(np.full(len(own), near), 0))
            ones.append(np.append(np.ones(len(own), np.int64), 0))
            titles.append(np.append(np.zeros(len(own), np.int64), 1))
        if not keys:
            continue
        key, index = np.unique(np.concatenate(keys), return_inverse=True)
        total = lambda parts: pa.array(np.bincount(index, weights=np.concatenate(parts), minlength=len(key)).astype(np.int64))
        compared = np.concatenate(nears)
        # An occurrence counts where its page had neighbours to compare with.
        seen = np.where(compared > 0, np.concatenate(ones), 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), total(shares), total([compared]), total([seen]), total(ones), total(titles)], ["key", "shared", "compared", "seen", "lines", "titles"]
        )


def learned_keys(compared: DataFrame) -> DataFrame:
    """(key, verdict) of wordings, frames and labels that are the site's, and of lines that name a page (see ``judge``)."""
    tally = compared.select("title_key", "lines", "others", "shared", "near").mapInArrow(_tally, "key bigint, shared bigint, compared bigint, seen bigint, lines bigint, titles bigint")
    sums = tally.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("shared", "compared", "seen", "lines", "titles")])
    ratio = F.when((F.col("compared") > 0) & (F.col("seen") >= LEAST_LINES), F.col("shared") / F.col("compared"))
    verdict = F.when(ratio >= LEAST_RATIO + ITEM_MORE, 1).when(ratio >= LEAST_RATIO, 2).when((F.col("titles") > 0) & (F.col("lines") > 0), 3)
    return sums.filter("key != 0").select("key", verdict.alias("verdict")).filter("verdict is not null")


def _verdicts(known: dict[int, int] | None, with_reasons: bool):
    def run(batches):
        for batch in batches:
            out = []
            for page_id, version, lines, others, shared, near, given in zip(*(batch.column(i).to_pylist() for i in range(7))):
                page, counts = unpacked(lines, others), np.frombuffer(shared, np.uint8)
                facts = known if known is not None else {g["key"]: g["verdict"] for g in given or ()}
                found = judge(page, counts[: len(page.keys)], counts[len(page.keys) :], near, facts)
                out.extend((page_id, version, n, why) for n, why in sorted(found.items()))
            ids, versions, numbers, reasons = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(numbers, pa.int32()), pa.array(reasons, pa.string())], ["page_id", "version", "line_no", "reason"]
            )

    return run


def _every_key(batches):
    for batch in batches:
        ids, keys = [], []
        for page_id, lines, others in zip(*(batch.column(i).to_pylist() for i in range(3))):
            page = unpacked(lines, others)
            own = np.unique(np.concatenate((page.keys, other_keys(page.others))))
            ids.append(np.full(len(own), page_id))
            keys.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64())], ["page_id", "key"])


def with_version(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_version", F.xxhash64("url", "site", "title", "content", "fetched_at"))


def marked_lines(pages: DataFrame, block_pages: int = BLOCK_PAGES, keys_sent: int = KEYS_SENT) -> DataFrame:
    """(page_id, version, line_no, reason) for every non-blank line that is not main body; see ``site_lines``."""
    spark = pages.sparkSession
    raw = with_version(pages.filter("page_id is not null")).select("page_id", "_version", "fetched_at", "url", "site", "title", "content")
    read = raw.mapInArrow(_read, _READ)
    slim = [c.split()[0] for c in _READ.split(", ") if not c.startswith(("page_id", "fetched_at"))]
    latest = F.max_by(F.struct(*slim), F.struct("fetched_at", "version"))
    single = read.groupBy("page_id").agg(latest.alias("p")).select("page_id", "p.*")
    # The cuts of a range depend on a sample, so places are numbered from what was written.
    ordered = single.repartitionByRange("site", "place", "page_id").sortWithinPartitions("site", "place", "page_id").drop("place")
    ordered = cut_lineage(ordered.withColumn("_n", F.monotonically_increasing_id()))
    part, inner = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    # One row per partition.
    before, offsets = 0, []
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):
        offsets.append((r[0], before))
        before += r[1]
    if not offsets:
        return spark.createDataFrame([], "page_id bigint, version bigint, line_no int, reason string")
    numbered = ordered.withColumns({"part": part, "inner": inner}).join(F.broadcast(spark.createDataFrame(offsets, "part bigint, before bigint")), "part")
    place = F.col("before") + F.col("inner")
    block, rest = F.floor(place / block_pages), place % block_pages
    copies = F.array_compact(F.array(block, F.when(rest < NEAREST, block - 1), F.when(rest >= block_pages - NEAREST, block + 1)))
    blocks = numbered.select(F.explode(copies).alias("block"), block.alias("home"), place.alias("place"), "page_id", "version", "title_key", "site", "lines", "others")
    blocks = blocks.select("block", (F.col("block") == F.col("home")).alias("own"), "page_id", "version", "title_key", "site", "lines", "others", "place")
    compared = blocks.repartition("block").sortWithinPartitions("block", "place").drop("place").mapInArrow(_compare_blocks, _COMPARED)
    compared = cut_lineage(compared)
    known = cut_lineage(learned_keys(compared))
    columns = ["page_id", "version", "lines", "others", "shared", "near"]
    schema = "page_id bigint, version bigint, line_no int, reason string"
    if known.count() <= keys_sent:
        table = {r.key: r.verdict for r in known.collect()}
        return compared.select(*columns, F.lit(None).cast("string").alias("known")).mapInArrow(_verdicts(table, True), schema)
    met = compared.select("page_id", "lines", "others").mapInArrow(_every_key, "page_id bigint, key bigint").join(known, "key")
    given = met.groupBy("page_id").agg(F.collect_list(F.struct("key", "verdict")).alias("known"))
    return compared.join(given, "page_id", "left").select(*columns, "known").mapInArrow(_verdicts(None, True), schema)


def site_lines(pages: DataFrame, block_pages: int = BLOCK_PAGES, keys_sent: int = KEYS_SENT) -> DataFrame:
    """(page_id, line_no) for every non-blank line that is not main body.

    ``pages`` has page_id, url, site, title, content, fetched_at.  Lines count
    from 1, split at newlines.  Of several fetches of a page_id the last counts,
    and of equal times the one with the greatest hash.  Null content has no
    lines; a page without site stands alone; rows without page_id are left out;
    empty tables give no rows.  A host's pages are spread over blocks of
    ``block_pages``, so no task holds a host, and the result is the same for
    every size of block.
    """
    return marked_lines(pages, block_pages, keys_sent).select("page_id", "line_no")


def main_bodies(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """(page_id, title, body): every page with the lines that are left."""
    marked = marked_lines(pages, block_pages)
    removed = marked.groupBy("page_id").agg(F.collect_set("line_no").alias("removed"))
    fetched = with_version(pages.filter("page_id is not null"))
    latest = F.max_by(F.struct("title", "content"), F.struct("fetched_at", "_version"))
    joined = fetched.groupBy("page_id").agg(latest.alias("p")).select("page_id", "p.*").join(removed, "page_id", "left")
    lines = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), r"\r(?=\n|$)", ""), "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce("removed", F.array().cast("array<int>")), i + 1))
    return joined.select("page_id", "title", F.btrim(F.array_join(kept, "\n"), F.lit(" \n")).alias("body"))
