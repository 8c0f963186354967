"""Files that keep arriving, imported in micro-batches.

An addition to the batch imports: the same documents, the same archive.  An
import is idempotent (ids follow from kind, origin and body), so a batch that
is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.functions import urls
from lodestrata.operators.store import Archive
from lodestrata.sources import readers

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Supported files of a folder as they appear."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(path)
    return files.filter(urls.is_supported_file(F.col("path")))


def follow(archive: Archive, path: str, checkpoint: str) -> StreamingQuery:
    """Imports what is there and then ends; started again, it goes on from its checkpoint.

    Files that are too large or too many are named with their code in the
    archive's folder ``skipped``.
    """

    def add(batch: DataFrame, _: int) -> None:
        coded = readers.limited(batch.withColumnRenamed("modificationTime", "modified_at"))
        archive.add(readers.read_documents(coded.filter("skip_code is null").select("path", "modified_at", "content")))
        skipped = coded.filter("skip_code is not null").select("path", "skip_code")
        if not skipped.isEmpty():
            skipped.write.mode("append").json(f"{archive.path}/skipped")

    return file_stream(archive.spark, path).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
