"""Version histories (type-two dimensions) from snapshots.

A dimension holds one row per version of an entity, of which one is current.  A
batch of snapshots is merged into it: the hash of each snapshot's attributes is
compared with that of the version then current; a changed one closes it with an
end and opens the next.  Closed versions are not read again, but for entities
with late snapshots, whose versions are made anew of their stored snapshots.

An entity may hold a large share of all rows, so the comparison has two levels:
inside (entity, month), and between an entity's months, of which the calendar
has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage

#: The columns of a dimension beside the entity's.
DIMENSION = "valid_from string, valid_to string, version_no bigint, is_current boolean, state binary, last_at string"


def attribute_hash(attributes: list[str]) -> Column:
    """16 bytes; a separator and a mark for null keep (null, 'a') and ('a', null) apart."""
    return F.unhex(F.md5(F.concat_ws("\u0002", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in attributes])))


def _slim(snapshots: DataFrame, entity: str, attributes: list[str], time: str, arrival: list[str], removed: str) -> DataFrame:
    """(entity, at, row): of snapshots with one entity and time the greatest by arrival."""
    kept = snapshots.filter(F.col(time).isNotNull() & F.col(entity).isNotNull()).select(
        F.col(entity).alias("entity"),
        F.col(time).alias("at"),
        F.struct(*[F.col(c) for c in arrival], attribute_hash(attributes).alias("state"), F.col(removed).alias("removed"), F.lit(0).cast("bigint").alias("base")).alias("row"),
    )
    # Partial maxima are formed before the shuffle.
    return kept.groupBy("entity", "at").agg(F.max("row").alias("row")).select("entity", "at", F.col("row.state").alias("state"), F.col("row.removed").alias("removed"), F.col("row.base").alias("base"))


def _versions(single: DataFrame, bucket_chars: int) -> DataFrame:
    """Versions of rows (entity, at, state, removed, base), one per entity and time; ``base`` versions of the entity come before them."""
    # Two steps read this, of columns far narrower than the snapshots.
    single = cut_lineage(single.withColumn("bucket", F.substring("at", 1, bucket_chars)))
    within = Window.partitionBy("entity", "bucket").orderBy("at")
    marked = single.withColumns({"previous": F.lag("state").over(within)})
    marked = marked.withColumns({"leads": F.col("previous").isNull(), "turns": F.coalesce(F.col("state") != F.col("previous"), F.lit(False))})
    # Whether the first row of a bucket opens a version, the bucket before decides.
    # A frame that ends at the last row costs the square of the rows; the same frame backwards doesn't.
    after = Window.partitionBy("entity", "bucket").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    rows = marked.withColumns(
        {
            "inner_no": F.sum(F.col("turns").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)),
            "inner_next": F.min(F.when(F.col("turns"), F.col("at"))).over(after),
        }
    ).filter(F.col("leads") | F.col("turns"))
    buckets = marked.groupBy("entity", "bucket").agg(
        F.min_by("state", "at").alias("first_state"),
        F.max_by("state", "at").alias("last_state"),
        F.min("at").alias("first_at"),
        F.max(F.struct("at", "removed")).alias("last_row"),
        F.sum(F.col("turns").cast("int")).alias("n_turns"),
        F.min(F.when(F.col("turns"), F.col("at"))).alias("first_turn"),
        F.max("base").alias("base"),
    )
    across, whole = Window.partitionBy("entity").orderBy("bucket"), Window.partitionBy("entity")
    buckets = buckets.withColumn("before", F.lag("last_state").over(across))
    buckets = buckets.withColumn("opened", F.col("before").isNull() | (F.col("before") != F.col("first_state")))
    buckets = buckets.withColumns(
        {
            "starts": F.col("n_turns") + F.col("opened").cast("int"),
            "first_start": F.when(F.col("opened"), F.col("first_at")).otherwise(F.col("first_turn")),
        }
    )
    buckets = buckets.select(
        "entity",
        "bucket",
        "opened",
        F.sum("starts").over(whole).alias("n_versions"),
        (F.coalesce(F.sum("starts").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.max("base").over(whole)).alias("done"),
        F.min("first_start").over(whole.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("next_start"),
        F.max("last_row").over(whole).alias("last_row"),
    )
    versions = rows.join(buckets, ["entity", "bucket"]).filter(F.col("turns") | F.col("opened"))
    following = F.coalesce("inner_next", "next_start")
    return versions.select(
        "entity",
        F.col("at").alias("valid_from"),
        F.coalesce(following, F.col("last_row.removed"), F.lit("open")).alias("valid_to"),
        (F.col("done") + F.col("opened").cast("int") + F.col("inner_no")).cast("bigint").alias("version_no"),
        following.isNull().alias("is_current"),
        "state",
        F.col("last_row.at").alias("last_at"),
        F.col("n_versions").cast("bigint").alias("n_versions"),
    )


def version_history(
    snapshots: DataFrame,
    entity: str,
    attributes: list[str],
    time: str,
    arrival: list[str],
    removed: str,
    bucket_chars: int = 7,
) -> DataFrame:
    """(entity, valid_from, valid_to, version_no, n_versions), one row per version, of all snapshots at once.

    ``time`` is a text that sorts in time order; rows without it or without an
    entity are left out.  Of rows with one entity and time the greatest by the
    ``arrival`` columns counts.  Neighbours with equal attributes (null equals
    null) form one version; the last one ends with the ``removed`` text of the
    entity's last snapshot, or ``open``.  ``bucket_chars`` is the length of the
    prefix of ``time`` that names a bucket.  Empty input gives no rows.
    """
    versions = _versions(_slim(snapshots, entity, attributes, time, arrival, removed), bucket_chars)
    return versions.select(F.col("entity").alias(entity), "valid_from", "valid_to", "version_no", "n_versions")


def empty_dimension(spark: SparkSession, entity: str, kind: str = "string") -> DataFrame:
    return spark.createDataFrame([], f"{entity} {kind}, {DIMENSION}")


def merge_versions(
    dimension: DataFrame,
    batch: DataFrame,
    snapshots: DataFrame,
    entity: str,
    attributes: list[str],
    time: str,
    arrival: list[str],
    removed: str,
    bucket_chars: int = 7,
) -> DataFrame:
    """The ``dimension`` (the entity's column and ``DIMENSION``) after a ``batch`` of snapshots; rules as in ``version_history``.

    Each entity's current version stands before its snapshots of the batch: they
    leave it as it is, extend it, or close it and open others.  Entities that
    the batch doesn't name keep their rows.  ``snapshots`` are those that the
    dimension was made of; only those of entities with late ones are read: a
    snapshot that isn't later than the current version's last one may split any
    version at snapshots that a version doesn't tell.
    """
    names = [c.split()[0] for c in DIMENSION.split(", ")]
    columns = (entity, attributes, time, arrival, removed)
    # Written once: the batch is asked for its entities and for its rows.
    fresh = cut_lineage(_slim(batch, *columns))
    touched = fresh.groupBy("entity").agg(F.min("at").alias("first"))
    held = dimension.withColumnRenamed(entity, "entity")
    current = held.filter("is_current").join(touched, "entity").withColumn("late", F.col("first") <= F.col("last_at"))
    current = cut_lineage(current.select("entity", "valid_from", "valid_to", "version_no", "state", "late"))
    late, kept = current.filter("late").select("entity"), current.filter("NOT late")
    seeds = kept.select("entity", F.col("valid_from").alias("at"), "state", F.lit(None).cast("string").alias("removed"), (F.col("version_no") - 1).alias("base"))
    width = [entity, *attributes, time, *arrival, removed]
    again = snapshots.select(list(dict.fromkeys(width))).join(late.withColumnRenamed("entity", entity), entity, "left_semi")
    again = again.unionByName(batch.select(list(dict.fromkeys(width))).join(late.withColumnRenamed("entity", entity), entity, "left_semi"))
    rows = fresh.join(late, "entity", "left_anti").unionByName(seeds).unionByName(_slim(again, *columns))
    merged = _versions(rows, bucket_chars).select("entity", *names)
    untouched = held.join(touched, "entity", "left_anti").select("entity", *names)
    closed = held.filter("NOT is_current").join(kept.select("entity"), "entity", "left_semi").select("entity", *names)
    return untouched.unionByName(closed).unionByName(merged).withColumnRenamed("entity", entity)
