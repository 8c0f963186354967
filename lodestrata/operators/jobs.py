"""The ledger of imports: an append-only table whose newest row per job holds."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata import schema

OPEN_STATES = ("pending", "running")


def latest(ledger: DataFrame) -> DataFrame:
    """One row per job, the one updated last."""
    fields = [c for c in ledger.columns if c not in ("job_id", "updated_at")]
    row = F.max_by(F.struct(*fields), F.struct("updated_at", "completed"))
    return ledger.groupBy("job_id").agg(F.max("updated_at").alias("updated_at"), row.alias("r")).select("job_id", "updated_at", "r.*")


def active(ledger: DataFrame, connection: str | None = None) -> DataFrame:
    """The newest job of each connection that is still pending or running."""
    rows = latest(ledger).filter(F.col("state").isin(*OPEN_STATES))
    if connection is not None:
        rows = rows.filter(F.col("connection_id") == connection)
    newest = F.max_by(F.struct("job_id", "state", "created_at"), F.struct("created_at", "job_id"))
    return rows.groupBy("connection_id").agg(newest.alias("j")).select("connection_id", "j.*")


def append(ledger: DataFrame, change: dict) -> DataFrame:
    schema.check("state", change.get("state"), schema.JOB_STATES)
    names = [f.split()[0] for f in schema.JOBS.split(", ")]
    row = ledger.sparkSession.createDataFrame([tuple(change.get(n) for n in names)], schema.JOBS)
    return ledger.unionByName(row)


def progress(outcomes: DataFrame) -> DataFrame:
    """One row (total, completed, imported, unchanged, skipped) of outcomes (source_created, skip_code)."""
    skipped = F.col("skip_code").isNotNull()
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(skipped | F.col("source_created").isNotNull()).alias("completed"),
        F.count_if(~skipped & F.col("source_created")).alias("imported"),
        F.count_if(~skipped & ~F.col("source_created")).alias("unchanged"),
        F.count_if(skipped).alias("skipped"),
    )


def run(archive, ledger: DataFrame, job: str, connection: str | None, documents: DataFrame, skipped: int = 0, now: datetime | None = None) -> DataFrame:
    """Imports documents under a job: the ledger goes from pending over running to completed or failed.

    A connection with an open job is not imported twice.  What is imported can
    be imported again without effect, so a failed job is simply run anew.
    """
    now = now or datetime.now(timezone.utc)
    if connection is not None and not active(ledger, connection).isEmpty():
        return ledger
    total = documents.count()
    base = {"job_id": job, "connection_id": connection, "created_at": now, "total": total + skipped, "skipped": skipped}
    for n, state in enumerate(("pending", "running")):
        ledger = append(ledger, base | {"state": state, "completed": 0, "updated_at": now + timedelta(milliseconds=n)})
    last = {"updated_at": datetime.now(timezone.utc)}
    try:
        before = archive.tables().sources.count()
        archive.add(documents, now)
        imported = archive.tables().sources.count() - before
        last |= {"state": "completed", "completed": total + skipped, "imported": imported, "unchanged": total - imported}
    except Exception as error:  # whatever ends an import is what the ledger is for
        last |= {"state": "failed", "completed": 0, "error": str(error)[:500]}
    return append(ledger, base | last)
