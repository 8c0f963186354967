"""Documents packed into containers of fixed capacity.

The plan is made from the histogram of lengths, which the capacity bounds
whatever the corpus: best fit, longest first, over counts instead of
documents.  It says of each length which ranks go into which containers;
documents take their slots by joining on their rank within their length.
"""

from __future__ import annotations

import base64
import bisect
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import MOST_SENT, cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SALTS = 64


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``documents``; a null text has no tokens."""

    def rows(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(tokenizer).open("rb"))}
        encoding = tiktoken.Encoding(Path(tokenizer).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n_tokens bigint")


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, end rank, first container, items per container) and the number of containers.

    Each length takes the open containers with the least sufficient room first,
    as many items of it as fit into each; what is left opens new containers.
    """
    rooms: list[int] = []  # distinct rooms in order
    ranges: dict[int, list[tuple[int, int]]] = {}  # room: ranges of containers
    slots, opened = [], 0

    def give_back(room: int, first: int, end: int) -> None:
        if end > first and room > 0:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, end))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, end = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first = capacity, opened
                end = opened = opened + -(-left // (capacity // length))
            each = room // length
            full = min(end - first, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each))
                give_back(room - each * length, first, first + full)
                rank, left, first = rank + full * each, left - full * each, first + full
            if left and left < each and first < end:
                slots.append((length, rank, rank + left, first, left))
                give_back(room - left * length, first, first + 1)
                rank, left, first = rank + left, 0, first + 1
            give_back(room, first, end)
    if histogram.get(0):
        # Documents without tokens take no room.
        slots.append((0, 0, histogram[0], 0, histogram[0]))
        opened = max(opened, 1)
    return slots, opened


def pack(counts: DataFrame, sizes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(size_id, container_no, doc_id, piece_no, first_token, n_tokens): the container of every document or piece.

    ``counts`` has doc_id and n_tokens, ``sizes`` size_id and capacity_tokens (a
    small fixed table).  Only a document longer than the capacity is cut, into
    full pieces and a rest.  Documents without tokens take a container, too.
    Rows with null doc_id or n_tokens are left out; empty tables give no rows.
    """
    spark = counts.sparkSession
    capacities = {r.size_id: r.capacity_tokens for r in sizes.select("size_id", "capacity_tokens").distinct().collect() if r.capacity_tokens and r.capacity_tokens > 0}
    counts = cut_lineage(counts.filter("doc_id is not null and n_tokens is not null"))
    schema = "size_id int, container_no bigint, doc_id bigint, piece_no int, first_token bigint, n_tokens int"
    if not capacities:
        return spark.createDataFrame([], schema)
    kinds = F.array(*[F.struct(F.lit(s).alias("size_id"), F.lit(c).alias("capacity")) for s, c in sorted(capacities.items())])
    sized = counts.select("doc_id", "n_tokens", F.inline(kinds))
    whole = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    rest = (F.col("n_tokens") - whole * F.col("capacity")).cast("int")
    # A document that fills its pieces exactly has no rest; one without tokens has only it.
    last = whole - F.when((rest == 0) & (whole > 0), 1).otherwise(0)
    pieces = sized.select("size_id", "doc_id", "capacity", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "size_id",
        "doc_id",
        "piece_no",
        (F.col("piece_no") * F.col("capacity")).cast("bigint").alias("first_token"),
        F.least(F.col("capacity").cast("bigint"), F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).cast("int").alias("n_tokens"),
    )
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int"))

    # At most capacity times salts rows per size; the histogram has at most capacity.
    parts = pieces.groupBy("size_id", "n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("size_id", "n_tokens").agg(F.sum("n").alias("n")).collect():
        histogram.setdefault(r.size_id, {})[r.n_tokens] = r.n
    slots = [(size_id, *slot) for size_id, lengths in histogram.items() for slot in plan(lengths, capacities[size_id])[0]]
    planned = spark.createDataFrame(slots, "size_id int, n_tokens int, first_rank bigint, end_rank bigint, first_container bigint, each bigint")

    by_salt = Window.partitionBy("size_id", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("size_id", "n_tokens", "salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias("before"))
    order = Window.partitionBy("size_id", "n_tokens", "salt").orderBy("doc_id", "piece_no")
    ranked = pieces.withColumn("n", F.row_number().over(order) - 1).join(offsets, ["size_id", "n_tokens", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("n"))
    # The plan's size follows from the capacities alone; very large ones would need a shuffle.
    found = ranked.join(F.broadcast(planned) if len(slots) <= MOST_SENT else planned, ["size_id", "n_tokens"]).filter((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each"))
    return found.select("size_id", container.cast("bigint").alias("container_no"), "doc_id", "piece_no", "first_token", "n_tokens")


def usage(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(size_id, n_containers, n_tokens, fill): how full the containers of each size are."""
    used = packed.groupBy("size_id").agg((F.max("container_no") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    joined = used.join(sizes.select("size_id", "capacity_tokens").distinct(), "size_id")
    return joined.select("size_id", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"))
