"""The p5_ and p6_ queries over the archive's tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import timestamps, versions
from lodestrata.plans import sql
from lodestrata.session import cut_lineage, table

SOURCE_TIMES = ("occurred_at", "published_at", "modified_at")

VERSIONED = ["title", "object_hash", "purpose", "authorship", "author", "subject", "content_scope"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legible times of sources and wiki documents whose stored text is not its normal form."""
    connections = table(spark, sf_dir, "connections").select("connection_id", "time_zone")
    sources = table(spark, sf_dir, "sources").select(
        F.col("id").alias("record_key"),
        "connection_id",
        F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in SOURCE_TIMES])).alias("f"),
    )
    docs = table(spark, sf_dir, "yuque_docs").select(
        F.col("id").cast("string").alias("record_key"), "connection_id", F.lit("updated_at").alias("field_name"), F.col("updated_at").alias("value")
    )
    values = sources.select("record_key", "connection_id", "f.field_name", "f.value").unionByName(docs)
    return timestamps.changed_forms(timestamps.with_zone(values, connections))


#: Snapshots imported in this time before the last one are the batch that is merged into the versions of all earlier ones.
LAST_BATCH = timedelta(days=365)


def p6_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every origin with its number and period: a year's snapshots merged into the versions of those before."""
    connections = table(spark, sf_dir, "connections").select("connection_id", "time_zone")
    columns = ["origin", "connection_id", "modified_at", "imported_at", "id", "deleted_at", *VERSIONED]
    sources = timestamps.with_zone(table(spark, sf_dir, "sources").select(*columns), connections)
    dated = timestamps.normalize_times(sources, "modified_at", "_zone", "at")
    dated = dated.filter("at is not null").withColumn("removed", timestamps.instant_text("deleted_at"))
    # Read by the first load and by the batch; hashes stand for the attributes.
    dated = cut_lineage(dated.select("origin", "at", "imported_at", "id", "removed", versions.attribute_hash(VERSIONED).alias("attributes")))
    (latest,) = dated.agg(F.max("imported_at")).first()
    before = F.coalesce(F.col("imported_at") < F.lit(latest).cast("timestamp") - F.lit(LAST_BATCH), F.lit(True))
    rules = ("origin", ["attributes"], "at", ["imported_at", "id"], "removed")
    earlier, batch = dated.filter(before), dated.filter(~before)
    nothing = versions.empty_dimension(spark, "origin")
    first = cut_lineage(versions.merge_versions(nothing, earlier, dated.limit(0), *rules))
    merged = versions.merge_versions(first, batch, earlier, *rules)
    return merged.select("origin", "valid_from", "valid_to", "version_no", "is_current")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the origins that have two or more: all but the first ones that are still current."""
    return p6_history(spark, sf_dir).filter("NOT (version_no = 1 AND is_current)").select("origin", "valid_from", "valid_to")


_ZONED = "(SELECT connection_id, min(time_zone) AS zone FROM connections GROUP BY connection_id)"

_P5_FOUND = f"""WITH given AS (
  SELECT id AS record_key, connection_id, unnest(['occurred_at', 'published_at', 'modified_at']) AS field_name, unnest([occurred_at, published_at, modified_at]) AS value FROM sources
  UNION ALL SELECT CAST(id AS VARCHAR), connection_id, 'updated_at', updated_at FROM yuque_docs),
given_zones AS (SELECT g.*, z.zone FROM (SELECT DISTINCT * FROM given WHERE value IS NOT NULL) g LEFT JOIN {_ZONED} z USING (connection_id)), {sql.normal_times('given_zones')}
SELECT DISTINCT record_key, field_name, normal_form FROM timed WHERE normal_form IS NOT NULL AND normal_form <> value"""

_P6 = f"""WITH given AS (SELECT s.*, z.zone FROM (SELECT DISTINCT * FROM sources) s LEFT JOIN {_ZONED} z USING (connection_id)), {sql.normal_times('given', 'modified_at', 'zone', 'ts')},
single AS (SELECT *, 1 AS one FROM timed WHERE ts IS NOT NULL AND origin IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY origin, ts ORDER BY imported_at DESC NULLS LAST, id DESC) = 1),
told AS (SELECT *, row_number() OVER w = 1 OR title IS DISTINCT FROM lag(title) OVER w OR object_hash IS DISTINCT FROM lag(object_hash) OVER w OR purpose IS DISTINCT FROM lag(purpose) OVER w OR authorship IS DISTINCT FROM lag(authorship) OVER w
    OR author IS DISTINCT FROM lag(author) OVER w OR subject IS DISTINCT FROM lag(subject) OVER w OR content_scope IS DISTINCT FROM lag(content_scope) OVER w AS opens,
  last_value(strftime(timezone('UTC', deleted_at), '%Y-%m-%dT%H:%M:%S.%gZ')) OVER (PARTITION BY origin ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS removed FROM single WINDOW w AS (PARTITION BY origin ORDER BY ts)),
versions AS (SELECT origin, ts AS valid_from, coalesce(lead(ts) OVER w, removed, 'open') AS valid_to, row_number() OVER w AS version_no, lead(ts) OVER w IS NULL AS is_current FROM told WHERE opens WINDOW w AS (PARTITION BY origin ORDER BY ts))"""

ORACLE_SQL = {
    "p5_found": _P5_FOUND,
    "p6_history": f"{_P6} SELECT origin, valid_from, valid_to, version_no, is_current FROM versions",
    "p6_found": f"{_P6} SELECT origin, valid_from, valid_to FROM versions WHERE origin IN (SELECT origin FROM versions GROUP BY origin HAVING count(*) >= 2)",
}

QUERIES = {"p5_found": p5_found, "p6_found": p6_found, "p6_history": p6_history}
