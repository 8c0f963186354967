"""The inverted index: postings of passages in buckets of tokens, totals of the corpus, and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text

K1, B, HEADING_WEIGHT, BODY_WEIGHT = 1.2, 0.75, 5.0, 1.0

#: Buckets that postings are stored in by token; a search reads those of its terms.
BUCKETS = 64


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, token, in_heading, in_body, dl, bucket): one row per passage and distinct token.

    ``dl`` is the passage's length, its tokens of heading and body counted
    apart; passages never change, so it is stored with each of them.
    """
    spread = chunks.select(
        F.col("id").alias("chunk_id"),
        text.index_tokens(F.array_join("heading_path", " ")).alias("heading"),
        text.index_tokens(F.col("content")).alias("body"),
    )
    token = F.explode(F.array_union("heading", "body"))
    dl = F.size("heading") + F.size("body")
    return spread.select("chunk_id", "heading", "body", dl.alias("dl"), token.alias("token")).select(
        "chunk_id",
        "token",
        F.array_contains("heading", F.col("token")).alias("in_heading"),
        F.array_contains("body", F.col("token")).alias("in_body"),
        "dl",
        bucket_of(F.col("token")).alias("bucket"),
    )


def totals(index: DataFrame) -> DataFrame:
    """One row (n, tokens): passages in the index and their lengths' sum, by one row of each passage.

    An import adds the totals of its new passages to the stored ones, so no
    search reads the whole index.
    """
    lengths = index.groupBy("chunk_id").agg(F.max("dl").alias("dl"))
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))


def added_totals(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))


def corpus_statistics(stored: DataFrame) -> DataFrame:
    """One row (n, avgdl) over all indexed passages, removed and superseded ones included."""
    return stored.select("n", (F.col("tokens") / F.nullif("n", F.lit(0))).alias("avgdl"))


def bm25(index: DataFrame, stored: DataFrame, terms: list[tuple[int, str]]) -> DataFrame:
    """(query_no, chunk_id, bm25), the higher the better, for passages with any of a query's terms.

    ``terms`` are pairs of query_no and token, as few as typed queries have;
    only their buckets of the postings are read.  ``stored`` has the totals.
    Terms in at least half of all passages keep a weight of one millionth.
    """
    spark = index.sparkSession
    asked = spark.createDataFrame(terms, "query_no int, token string")
    tokens = sorted({t for _, t in terms})
    # The buckets of literals are known when the plan is made, so they reach the scan.
    hits = index.filter(F.col("bucket").isin(*[bucket_of(F.lit(t)) for t in tokens]) & F.col("token").isin(tokens)) if tokens else index.limit(0)
    frequency = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # One row per term, and one row of totals.
    weighted = hits.join(F.broadcast(asked.join(frequency, "token")), "token").join(F.broadcast(corpus_statistics(stored)))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(F.lit(1e-6))
    f = HEADING_WEIGHT * F.col("in_heading").cast("int") + BODY_WEIGHT * F.col("in_body").cast("int")
    part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return weighted.groupBy("query_no", "chunk_id").agg(F.sum(part).alias("bm25"))
