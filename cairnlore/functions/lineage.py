"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, one in the warehouse, which
    they share too. A warehouse on a local disk is refused on a cluster, as executors don't share that."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
            if folder.startswith(("file:", "/")) and not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df materialised in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Spark's setting that a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
ENDS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_packed(df: DataFrame, folder: str) -> None:
    """df as Parquet in a folder, compressed well; the shuffle files behind it are of no use then and go at once."""
    conf = df.sparkSession.conf
    before = conf.get(ENDS_SHUFFLES)
    conf.set(ENDS_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        conf.set(ENDS_SHUFFLES, before)


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """df, computed once and held as Parquet in the shared checkpoint folder until the block ends. For rows that are
    read more than once and not needed later: a checkpoint is larger and stays until the driver collects its garbage."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/staged-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        write_packed(df, folder)
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
