"""Records that differ only in formatting, collapsed into one each.

Every body gets a canonical key: letters and digits without case, with the
fields of JSON objects and of a leading ``---`` block in sorted order.  Keys
that hold very many rows are found by exact counts, of which each partition
sends one partial count per key; their rows are aggregated in two levels, first
by key and salt, then by key.  All other keys need one shuffle.
"""

from __future__ import annotations

import json

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import cut_lineage, sent_if_small

_FORMATTING = r"[^\p{L}\p{N}\p{M}]+"
_FORMATTING_PY = regex.compile(_FORMATTING)
_BLOCK = r"^\s*---[ \t]*\r?\n(?s:(.*?))\r?\n[ \t]*---[ \t]*(?:\r?\n|$)"


def folded(text: Column) -> Column:
    """Letters, digits and marks without case; sharp s is the one letter in use whose upper form is longer."""
    return F.lower(F.upper(F.regexp_replace(F.regexp_replace(text, _FORMATTING, ""), "[ßẞ]", "ss")))


def _fold(text: str) -> str:
    return _FORMATTING_PY.sub("", text).replace("ß", "ss").replace("ẞ", "ss").upper().lower()


def _canonical(value) -> str:
    if isinstance(value, dict):
        fields = sorted(f"{_fold(k)}\u0003{_canonical(v)}" for k, v in value.items())
        return "\u0001{" + "\u0002".join(fields) + "}\u0001"
    if isinstance(value, list):
        return "\u0001[" + "\u0002".join(map(_canonical, value)) + "]\u0001"
    if isinstance(value, str):
        return _fold(value)
    return _fold(json.dumps(value))


def _object(pairs):
    """A JSON object whose repeated names are all kept."""
    seen: dict = {}
    for name, value in pairs:
        seen[name if name not in seen else f"{name}\u0000{len(seen)}"] = value
    return seen


@F.pandas_udf(T.StringType())
def _json_key(bodies: pd.Series) -> pd.Series:
    def key(body):
        if body is None:
            return None
        try:
            return _canonical(json.loads(body, object_pairs_hook=_object))
        except (ValueError, RecursionError):
            return None

    return bodies.map(key)


def canonical_key(body: Column) -> Column:
    """16 bytes, equal for bodies that differ only in formatting; NULL for a null body.

    A body of JSON or with a leading block is compared by fields; a JSON body
    that does not parse is compared as text.  All bodies without letters and
    digits have one key.
    """
    body_json = F.when(body.rlike(r"^\s*[{\[]"), body)
    block = F.regexp_extract(body, _BLOCK, 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda line: line.rlike(r"\S"))
    fields = F.transform(
        lines, lambda line: F.concat_ws("\u0003", folded(F.regexp_replace(line, r"[:：].*$", "")), folded(F.regexp_extract(line, r"[:：](.*)$", 1)))
    )
    rest = folded(F.when(block != "", F.regexp_replace(body, _BLOCK, "")).otherwise(body))
    text = F.concat(F.when(block != "", F.concat(F.array_join(F.array_sort(fields), "\u0002"), F.lit("\u0001"))).otherwise(""), rest)
    return F.unhex(F.md5(F.coalesce(_json_key(body_json), text)))


def collapse(objects: DataFrame, identifier: str, body: str, hot_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """(rep_hash, hash, n_rows): every distinct identifier with the smallest identifier of its group and its number of rows.

    Rows with null identifier or body are left out.  Groups of ``hot_rows`` rows
    or more are salted ``salts``-fold.
    """
    keyed = objects.filter(F.col(identifier).isNotNull() & F.col(body).isNotNull()).select(F.col(identifier).alias("hash"), canonical_key(F.col(body)).alias("key"))
    # Keys are much smaller than bodies, and the bodies are read once.
    members = cut_lineage(keyed.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n_rows")))
    # At most one hot key for every hot_rows rows; few enough to be sent, no row moves to learn that its key is not hot.
    hot = sent_if_small(cut_lineage(members.groupBy("key").agg(F.sum("n_rows").alias("n")).filter(F.col("n") >= hot_rows).select("key")))
    some = members.join(hot, "key", "left_anti").withColumn("rep_hash", F.min("hash").over(Window.partitionBy("key")))
    salted = members.join(hot, "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(salts)))
    representatives = salted.groupBy("key", "salt").agg(F.min("hash").alias("low")).groupBy("key").agg(F.min("low").alias("rep_hash"))
    # Each representative goes to every salt, so that no task holds a whole hot group.
    spread = representatives.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    many = salted.join(spread, ["key", "salt"])
    columns = ["rep_hash", "hash", "n_rows"]
    return some.select(*columns).unionByName(many.select(*columns))


def copies(collapsed: DataFrame) -> DataFrame:
    """(rep_hash, n_copies, n_rows): one row per group."""
    return collapsed.groupBy("rep_hash").agg(F.count(F.lit(1)).alias("n_copies"), F.sum("n_rows").alias("n_rows"))
