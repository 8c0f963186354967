"""Search: candidates, lexical score, fusion of several queries, recall by mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata import schema
from lodestrata.functions import text
from lodestrata.operators import index as inverted
from lodestrata.operators.store import Tables, live

#: How many candidates each route gives, and a query keeps.
FULL_TEXT, SUBSTRING, PER_QUERY, MAX_HITS, MAX_QUERIES = 300, 200, 30, 30, 6

#: What a hit in each place is worth.
EXACT, COVERAGE, TITLE, HEADING, BODY, BM25_MOST = 12.0, 8.0, 2.5, 1.5, 0.25, 3.0
RRF_K, FIRST_QUERY, LEXICAL_SHARE = 60, 1.25, 10_000.0

HIT = ["source_id", "chunk_id", "title", "origin", "object_hash", "start_line", "end_line", "heading_path", "coverage", "exact", "score", "purpose", "authorship", "occurred_at", "subject", "content_scope"]


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clamp(limit: int) -> int:
    return max(1, min(MAX_HITS, int(limit)))


def clean_queries(queries: list[str]) -> list[str]:
    """At most six different non-empty queries, the first occurrence of each."""
    seen = dict.fromkeys(q for q in (text.fold_query(x) for x in queries) if q)
    return list(seen)[:MAX_QUERIES]


def _live_of(tables: Tables, purpose: str | None) -> DataFrame:
    sources = live(tables.sources)
    return sources.filter(F.col("purpose") == purpose) if schema.check("purpose", purpose, schema.PURPOSES) else sources


def _with_fields(found: DataFrame, tables: Tables) -> DataFrame:
    """Candidates (source_id, chunk_id, ...) with the fields of their source and passage; the few candidates go to the tables."""
    sources = tables.sources.select(
        F.col("id").alias("source_id"), "title", "origin", "purpose", "authorship", "subject", "content_scope",
        F.when(F.col("occurred_at").eqNullSafe(F.col("occurred_end")), F.col("occurred_at")).alias("source_date"),
    )
    chunks = tables.chunks.select(F.col("id").alias("chunk_id"), "object_hash", "start_line", "end_line", "content", "heading_path", F.col("occurred_at").alias("chunk_date"))
    # At most MAX_QUERIES times the routes' limits.
    rows = chunks.join(F.broadcast(found), "chunk_id")
    # These rows are as many; the sources are met in the same way.
    return sources.join(F.broadcast(rows), "source_id").withColumn("occurred_at", F.coalesce("chunk_date", "source_date"))


def query_table(spark: SparkSession, queries: list[str]) -> DataFrame:
    """(query_no, query, terms) of the cleaned queries that have a term of meaning; at most MAX_QUERIES rows."""
    rows = [(n, q, text.meaningful_terms(q)) for n, q in enumerate(queries)]
    return spark.createDataFrame([r for r in rows if r[2]], "query_no int, query string, terms array<string>")


def candidates(tables: Tables, queries: list[str], purpose: str | None = None) -> DataFrame:
    """(query_no, source_id, chunk_id, ordinal, route, bm25): passages for every query by three routes.

    Full text gives the best by BM25; a passage that holds the whole query, or
    whose title does, replaces its full-text row and has no BM25 then.  All
    queries share one scan of the postings' buckets and one of the passages.
    Only ids are joined and ranked; texts stay where they are.
    """
    asked = [(n, q, text.meaningful_terms(q)) for n, q in enumerate(queries)]
    asked = [x for x in asked if x[2]]
    order = [F.asc("source_id"), F.asc("ordinal")]
    sources = _live_of(tables, purpose).select(F.col("id").alias("source_id"), "object_hash", "title")
    ids = sources.select("source_id", "object_hash")
    # A lone character is looked for literally only.
    indexed = [(n, t) for n, _, terms in asked if not (len(terms) == 1 and len(terms[0]) == 1) for t in terms]
    ranked = inverted.bm25(tables.postings, tables.totals, indexed)
    full_text = ranked.join(tables.chunks.select(F.col("id").alias("chunk_id"), "object_hash", "ordinal"), "chunk_id").join(ids, "object_hash")
    best = Window.partitionBy("query_no").orderBy(F.desc("bm25"), *order)
    full_text = full_text.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= FULL_TEXT).withColumn("route", F.lit(0))

    needles = F.array(*[F.struct(F.lit(n).alias("query_no"), F.lit(q.translate(_LOWER)).alias("needle")) for n, q, _ in asked])
    inside = lambda column: F.transform(F.filter(needles, lambda x: column.contains(x["needle"])), lambda x: x["query_no"])
    holding = tables.chunks.select(F.col("id").alias("chunk_id"), "object_hash", "ordinal", F.explode(inside(text.ascii_lower(F.col("content")))).alias("query_no"))
    named = sources.select("source_id", "object_hash", F.explode(inside(text.ascii_lower(F.col("title")))).alias("query_no"))
    starts = tables.chunks.filter("ordinal = 0").select(F.col("id").alias("chunk_id"), "object_hash", "ordinal")
    columns = ["query_no", "source_id", "chunk_id", "ordinal", "route", "bm25"]
    literal = holding.join(ids, "object_hash").withColumns({"route": F.lit(1), "bm25": F.lit(0.0)}).select(*columns)
    literal = literal.unionByName(named.join(starts, "object_hash").withColumns({"route": F.lit(2), "bm25": F.lit(0.0)}).select(*columns))
    first = Window.partitionBy("query_no", "route").orderBy(*order)
    literal = literal.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= SUBSTRING).select(*columns)

    last = Window.partitionBy("query_no", "source_id", "chunk_id").orderBy(F.desc("route"))
    return full_text.select(*columns).unionByName(literal).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def score(rows: DataFrame, queries: list[str]) -> DataFrame:
    """Adds query, exact, coverage and score to candidates, and drops those that match too little.

    Up to four terms must all match, more by six tenths, unless the query occurs
    literally.  Where two or more ASCII terms only name the title, the other
    terms must be found in heading or body.
    """
    rows = rows.join(F.broadcast(query_table(rows.sparkSession, queries)), "query_no")
    heading = F.array_join("heading_path", " ")
    rows = rows.withColumns({"_title": text.folded(F.col("title")), "_heading": text.folded(heading), "_body": text.folded(F.col("content"))})
    for name in ("title", "heading", "body"):
        rows = rows.withColumn(f"_in_{name}", F.array_intersect("terms", text.index_tokens(F.col(f"_{name}"), compatible=False)))
    n = F.size("terms")
    in_content = F.col("_heading").contains(F.col("query")) | F.col("_body").contains(F.col("query"))
    in_text = F.array_union("_in_heading", "_in_body")
    rest = F.array_except("terms", "_in_title")
    named = F.filter("_in_title", lambda t: t.rlike(r"^[a-z0-9][a-z0-9._\-]*$"))
    about = F.size(F.array_intersect(rest, in_text)) / F.size(rest)
    off_subject = (F.size(named) >= 2) & (F.size(rest) > 0) & ~in_content & (about < F.when(F.size(rest) <= 3, 1.0).otherwise(0.6))
    rows = rows.withColumn("exact", F.col("_title").contains(F.col("query")) | in_content)
    rows = rows.withColumn("coverage", F.when(F.col("exact"), 1.0).otherwise(F.size(F.array_union("_in_title", in_text)) / n))
    rows = rows.filter((F.col("exact") | (F.col("coverage") >= F.when(n <= 4, 1.0).otherwise(0.6))) & ~off_subject)
    bonus = F.least(F.lit(BM25_MOST), F.log1p(F.greatest(F.lit(0.0), F.col("bm25")) * 1_000_000))
    total = (
        EXACT * F.col("exact").cast("int") + COVERAGE * F.col("coverage") + TITLE * F.size("_in_title") + HEADING * F.size("_in_heading") + BODY * F.size("_in_body") + bonus
    )
    return rows.withColumn("score", total).drop("_title", "_heading", "_in_title", "_in_heading", "_in_body")


def by_score() -> list[Column]:
    return [F.desc("score"), F.collate("title", "zh").asc(), F.asc("source_id"), F.asc("ordinal")]


def search_each(tables: Tables, queries: list[str], limit: int = 8, purpose: str | None = None) -> DataFrame:
    """The best passages for every query (query_no, query, rank and the fields of a hit); none for a query without a term of meaning."""
    none = tables.sources.sparkSession.createDataFrame([], "query_no int, source_id string, chunk_id string, ordinal int, route int, bm25 double")
    found = candidates(tables, queries, purpose) if any(map(text.meaningful_terms, queries)) else none
    rows = score(_with_fields(found, tables), queries)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_no").orderBy(*by_score()))).filter(F.col("rank") <= clamp(limit))
    # Excerpts are cut for the few rows that are left.
    return rows.select("query_no", "query", "rank", *HIT, text.excerpt_of(F.col("content"), F.col("_body"), F.col("query"), F.col("terms")).alias("excerpt"), "ordinal")


def search(tables: Tables, query: str, limit: int = 8, purpose: str | None = None) -> DataFrame:
    """The best passages for one query, best first."""
    return search_each(tables, [text.fold_query(query)], limit, purpose).orderBy("rank").drop("query_no", "query", "rank")


def fuse(hits: DataFrame) -> DataFrame:
    """One row per passage from the hits of several queries (query_no, query, source_id, chunk_id, score, ...).

    Reciprocal rank fusion with a slightly heavier first query; the lexical
    score only breaks near ties.  Other fields are those of the first query.  ``rank`` counts from 1 within a query.
    """
    part = F.when(F.col("query_no") == 0, FIRST_QUERY).otherwise(1.0) / (RRF_K + F.col("rank"))
    others = [c for c in hits.columns if c not in ("source_id", "chunk_id", "query_no", "query", "rank", "score", "coverage", "exact")]
    fused = hits.groupBy("source_id", "chunk_id").agg(
        F.sum(part).alias("rrf"),
        F.max("score").alias("best"),
        F.max("coverage").alias("coverage"),
        F.bool_or("exact").alias("exact"),
        F.transform(F.array_sort(F.collect_list(F.struct("query_no", "query"))), lambda x: x.query).alias("matched_queries"),
        F.min_by(F.struct(*others), "query_no").alias("first"),
    )
    return fused.select(
        "source_id", "chunk_id", *[F.col(f"first.{c}") for c in others], "coverage", "exact", "matched_queries", (F.col("rrf") + F.col("best") / LEXICAL_SHARE).alias("score")
    )


def by_fusion() -> list[Column]:
    return [F.desc("score"), F.desc("coverage"), F.collate("title", "zh").asc(), F.asc("source_id"), F.asc("ordinal")]


def per_source(fused: DataFrame, most: int) -> DataFrame:
    """At most so many passages of one source, the best."""
    return fused.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy(*by_fusion()))).filter(F.col("_n") <= most).drop("_n")


def query(tables: Tables, queries: list[str], limit: int = 8, purpose: str | None = None, max_per_source: int = 2) -> DataFrame:
    """The best passages for up to six queries together."""
    hits = search_each(tables, clean_queries(queries), PER_QUERY, purpose)
    return per_source(fuse(hits), max_per_source).orderBy(*by_fusion()).limit(clamp(limit))


@dataclass
class Recall:
    """What the archive can say: passages, the periods they are from, and whether they carry a personal claim."""

    mode: str
    hits: DataFrame
    summary: DataFrame


#: Different periods of claimable passages that a mode needs; other modes need one passage.
PERIODS_NEEDED = {"change": 2, "pattern": 3}


def choose(hits: DataFrame, mode: str, limit: int) -> DataFrame:
    """The passages of a recall out of ranked ones (with ``place``, 1 is the best).

    Fiction and quotations of others are left out; a quote must be literal.
    Change and pattern take the best passage of every period first, then fill up
    by rank, in order of time (undated last); never more than ``limit``.
    """
    kept = hits.filter(~F.coalesce(F.col("content_scope").isin("fictional", "sourced"), F.lit(False)))
    if mode == "quote":
        kept = kept.filter("exact")
    if mode not in PERIODS_NEEDED:
        return kept.orderBy("place").limit(limit)
    turn = F.row_number().over(Window.partitionBy("occurred_at").orderBy("place"))
    first = (F.col("occurred_at").isNotNull()) & (turn == 1)
    chosen = kept.withColumn("_later", F.when(first, 0).otherwise(1)).orderBy("_later", "place").limit(limit).drop("_later")
    return chosen.orderBy(F.asc_nulls_last("occurred_at"), "place")


def summarize(hits: DataFrame, mode: str) -> DataFrame:
    """One row: periods of all passages, number of claimable passages and of their periods, sufficient, reason."""
    claimable = (F.col("content_scope") == "personal") & (F.col("subject") == "user")
    counted = hits.agg(
        F.array_sort(F.collect_set("occurred_at")).alias("distinct_periods"),
        F.count_if(claimable).alias("claimable"),
        F.count_distinct(F.when(claimable, F.col("occurred_at"))).alias("claimable_periods"),
        F.count(F.lit(1)).alias("n"),
    )
    needed = PERIODS_NEEDED.get(mode)
    enough = F.col("claimable_periods") >= needed if needed else F.col("claimable") > 0
    reason = F.when(enough, "SUFFICIENT").when(F.col("n") == 0, "NOTHING_FOUND").when(F.col("claimable") == 0, "NOT_PERSONAL").otherwise("TOO_FEW_PERIODS")
    return counted.select(F.lit(mode).alias("mode"), "distinct_periods", "claimable", "claimable_periods", enough.alias("sufficient"), reason.alias("reason"))


def recall(tables: Tables, queries: list[str], mode: str, limit: int = 8, include_references: bool = False) -> Recall:
    """Evidence for an answer about the user's own past."""
    schema.check("mode", mode, schema.MODES)
    ranked = query(tables, queries, PER_QUERY, None if include_references else "memory", 8 if mode in PERIODS_NEEDED else 2)
    # At most thirty rows, so the order is cheap to number.
    placed = ranked.withColumn("place", F.row_number().over(Window.orderBy(*by_fusion())))
    hits = choose(placed, mode, clamp(limit))
    return Recall(mode, hits, summarize(hits, mode))
