"""Passages: stretches of a text that a citation can name by lines.

Lengths are UTF-16 units, so that a passage's limits are the same wherever the
text is shown.  A block is a heading or a run of non-blank lines; passages are
blocks packed up to a target length under one heading path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

TARGET = 1200
_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*")
_UNIT = re.compile(r"[^。！？.!?\n]+[。！？.!?]?")
_EDGE = "﻿ \t\n\r\v\f                 　"

SCHEMA = "hash string, ordinal int, start_line int, end_line int, content string, heading_path array<string>"


@dataclass(frozen=True)
class Block:
    start: int
    end: int
    text: str
    path: tuple[str, ...]


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def _cut(text: str, size: int) -> list[str]:
    raw = text.encode("utf-16-le", "surrogatepass")
    return [raw[i : i + 2 * size].decode("utf-16-le", "replace") for i in range(0, len(raw), 2 * size)]


def _fit(block: Block, target: int) -> Iterator[Block]:
    """A block as pieces of at most the target: whole sentences where possible; all keep its lines."""
    if units(block.text) <= target:
        yield block
        return
    held, size = [], 0
    for sentence in _UNIT.findall(block.text):
        length = units(sentence)
        if held and size + length > target:
            yield replace(block, text="".join(held))
            held, size = [], 0
        if length > target:
            yield from (replace(block, text=piece) for piece in _cut(sentence, target))
        else:
            held.append(sentence)
            size += length
    if held:
        yield replace(block, text="".join(held))


def blocks(text: str) -> Iterator[Block]:
    lines = [line.strip(_EDGE) for line in re.sub(r"\r\n?", "\n", text).split("\n")]
    raw = re.sub(r"\r\n?", "\n", text).split("\n")
    titles: list[str] = []
    path: tuple[str, ...] = ()
    run: list[int] = []

    def close() -> Iterator[Block]:
        if run:
            yield Block(run[0] + 1, run[-1] + 1, "\n".join(raw[run[0] : run[-1] + 1]).strip(_EDGE), path)
            run.clear()

    for number, line in enumerate(lines):
        heading = _HEADING.fullmatch(line) if line.startswith("#") else None
        opens = bool(re.match(r"#{1,6}\s+", line))
        if not line or heading or (opens and run):
            yield from close()
        if heading:
            level = len(heading[1])
            titles[level - 1 :] = [*[""] * (level - 1 - len(titles)), heading[2].strip(_EDGE)]
            # A level that repeats the one above it says nothing.
            path = tuple(t for i, t in enumerate(titles) if t and (i == 0 or t != titles[i - 1]))
            yield Block(number + 1, number + 1, line, path)
        elif line:
            run.append(number)
    yield from close()


def chunk(text: str | None, target: int = TARGET) -> list[Block]:
    """Passages in order; none for null or blank text."""
    out: list[Block] = []
    size = 0
    for block in (piece for b in blocks(text or "") for piece in _fit(b, target)):
        length = units(block.text)
        if out and out[-1].path == block.path and size + 2 + length <= target:
            out[-1] = replace(out[-1], end=block.end, text=f"{out[-1].text}\n\n{block.text}")
            size += 2 + length
        else:
            out.append(block)
            size = length
    return out


def chunk_rows(objects: DataFrame, target: int = TARGET) -> DataFrame:
    """(hash, ordinal, start_line, end_line, content, heading_path) from (hash, content); each text stays in one task."""

    def rows(batches):
        for batch in batches:
            found = [(h, n, b) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, b in enumerate(chunk(text, target))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _, _ in found], pa.string()),
                    pa.array([n for _, n, _ in found], pa.int32()),
                    pa.array([b.start for _, _, b in found], pa.int32()),
                    pa.array([b.end for _, _, b in found], pa.int32()),
                    pa.array([b.text for _, _, b in found], pa.string()),
                    pa.array([list(b.path) for _, _, b in found], pa.list_(pa.string())),
                ],
                ["hash", "ordinal", "start_line", "end_line", "content", "heading_path"],
            )

    return objects.select("hash", "content").mapInArrow(rows, SCHEMA)
