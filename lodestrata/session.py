"""Sessions, table reading and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestrata")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and go on from there.

    The folder is the cluster's own (``spark.checkpoint.dir``).  Where it is
    unset, a session in one process (tests, the bench) takes a folder of this
    machine; on a cluster that would lose data, so it is an error there.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lodestrata-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Rows that are sent to every task at most; narrow ones, so some tens of megabytes.
MOST_SENT = 1_000_000


def sent_if_small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df`` (narrow, and cheap to count) marked for a broadcast if it has at most ``most`` rows; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.count() <= most else df
