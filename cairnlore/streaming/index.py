"""Incremental indexing: a file stream of records upserted into a versioned table, batch by batch."""

from __future__ import annotations

from cairnlore.sources.versions import VersionedTable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def upsert_into(target: str, key: str, order: str, stream: str, buckets: int = 64):
    """A foreachBatch function: each batch is one new version of the table, with its newest rows in place.

    Only the buckets that the batch touches are read and written. The table knows the last batch of the stream, so a
    batch that is repeated after a crash is left out.
    """

    def write(batch: DataFrame, n: int) -> None:
        VersionedTable(batch.sparkSession, target, [key], buckets).upsert(batch, order, stream, n)

    return write


def watch(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "path", order: str = "indexed_at", files: int = 100, buckets: int = 64) -> StreamingQuery:
    """Indexes all files that a folder has got since the last run, so many in a batch. The stream's checkpoint knows the
    seen ones, and names the stream."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(upsert_into(target, key, order, checkpoint, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of an indexed table."""
    return VersionedTable(spark, target).read()
