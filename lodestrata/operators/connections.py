"""The registry of connections: what an archive is fed from, and the attribution its documents get."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata import schema
from lodestrata.functions import text, urls

SCHEMA = schema.CONNECTIONS


def normalized_input(value: Column) -> Column:
    """A connection's identity: the canonical URL without a closing slash, or the path as it is."""
    web = value.rlike(r"(?i)^https?://")
    return F.when(web, F.regexp_replace(urls.canonical_url(F.trim(value)), r"/$", "")).otherwise(F.trim(value))


def with_defaults(connections: DataFrame) -> DataFrame:
    """Kind and attribution of (input): repositories are references by others, all else is the user's own."""
    kind = urls.connection_kind(F.col("input"))
    code = kind == "github"
    wiki_page = urls.wiki_of(F.col("input"))["slug"].isNotNull()
    return connections.withColumns(
        {
            "kind": kind,
            "purpose": F.when(code, "reference").otherwise("memory"),
            "authorship": F.when(code, "other").otherwise("user"),
            "content_scope": F.when(code, "sourced").otherwise("personal"),
            "crawl_scope": F.when(wiki_page, "page").when(kind.isin("web", "yuque"), "site"),
        }
    )


def connect(registry: DataFrame, inputs: DataFrame, now: datetime | None = None) -> DataFrame:
    """The registry with the connections of (input) that it does not hold yet, once each; empty inputs are left out."""
    fresh = inputs.select(normalized_input(text.tidy(F.col("input"))).alias("input")).filter("input is not null").distinct()
    fresh = fresh.join(registry.select("input"), "input", "left_anti").withColumn("connection_id", F.substring(F.sha2("input", 256), 1, 16))
    fresh = with_defaults(fresh).withColumns({"created_at": F.lit(now or datetime.now(timezone.utc)), "last_synced_at": F.lit(None).cast("timestamp")})
    return registry.unionByName(fresh)


def attributed(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents with the attribution of their connection where they state none."""
    names = ("purpose", "authorship", "content_scope")
    given = registry.select("connection_id", *[F.col(n).alias(f"_{n}") for n in names])
    joined = documents.join(given, "connection_id", "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.col(f"_{n}")) for n in names}).drop(*[f"_{n}" for n in names])
