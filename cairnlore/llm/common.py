"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words are runs of anything but ASCII blanks: bytes.split() in Python, this pattern in Java.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, one in the warehouse, which
    they share too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return sc.getCheckpointDir()


#: Spark's setting that a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
ENDS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df materialised in the shared checkpoint folder, so that a lost executor costs no recomputation. The shuffle files
    behind it are of no use then and go at once."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(ENDS_SHUFFLES)
    spark.conf.set(ENDS_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint()  # a query made now, as each keeps the setting it was made under
    finally:
        spark.conf.set(ENDS_SHUFFLES, before)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared checkpoint folder and read again, so that later passes read the columns
    they need only."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def quoted(name: str) -> str:
    """A column name as an expression takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def row_of(df: DataFrame) -> Column:
    """All columns of df in one struct."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def mapped(df: DataFrame, keep: list[str], column: str, fields: dict[str, T.DataType], made: Callable[[list], list], rows: int = 256, field: int | None = None) -> DataFrame:
    """keep and new fields: made gets the values of `column` of at most `rows` rows and gives a list of values, or an
    array, for each field. Columns are told apart by place, so that names may clash. field: the values are this field,
    by place, of the structs in `column`; those that are kept are sent to Python once."""
    kept = df.select(*[F.col(quoted(k)) for k in keep], *([] if field is not None and column in keep else [F.col(quoted(column)).alias("__value")]))
    n, names = len(keep), [*keep, *fields]
    schema = T.StructType([*kept.schema.fields[:n], *(T.StructField(n, t) for n, t in fields.items())])
    types = [to_arrow_type(t) for t in fields.values()]
    at = keep.index(column) if len(kept.columns) == n else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                values = batch.column(at) if field is None else batch.column(at).field(field)
                found = [pa.array(x, type=t) for x, t in zip(made(values.to_pylist()), types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *found], names=names)

    return kept.mapInArrow(run, schema)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row: a lambda variable, which Catalyst can't inline again."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Rows up to which a counted table of small columns is broadcast.
BROADCAST = 50_000


def small(df: DataFrame, rows: int, bound: int = BROADCAST) -> DataFrame:
    """df marked for broadcast if its counted rows are within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= bound else df


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many small rows, in no more partitions than these need. What lies in one is grouped further
    without a shuffle, so that steps over few rows don't run, log and write files for hundreds of empty tasks."""
    return df.coalesce(-(-max(rows, 1) // BROADCAST))


#: A key is heavy if it has more than one of so many rows; there are never more heavy keys than this.
HEAVY = 1000


def meet(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left joined with right, which has one row for each key and, in column n, how many of left's `total` rows have it.
    If these are few, right is broadcast, which can't have more. Else only the heavy keys are, at most HEAVY of them; so no
    task of the other, shuffled join gets a hot key."""
    if total <= BROADCAST:
        return left.join(F.broadcast(right.drop(n)), key)
    heavy = F.broadcast(right.filter(F.col(n) * HEAVY > total).drop(n))
    rest = left.join(heavy.select(key), key, "left_anti").join(right.filter(F.col(n) * HEAVY <= total).drop(n), key)
    return left.join(heavy, key).unionByName(rest)


def prefix_sums(values: Column, block: int = 128) -> Column:
    """Sums of the elements before each element. Two levels of blocks keep the array copies well below quadratic."""
    zero = F.lit(0).cast("bigint")

    def running(start, xs):
        return F.aggregate(
            xs,
            F.array(start),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
            lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        )

    def over(vs):
        n = F.ceil(F.size(vs) / F.lit(block)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(vs, i * block + 1, F.lit(block)))

        def with_starts(bs):
            starts = running(zero, F.transform(bs, lambda b: F.aggregate(b, zero, lambda a, x: a + x)))
            return F.flatten(F.zip_with(starts, bs, running))

        return F.when(F.size(vs) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks, with_starts))

    return let(F.transform(values, lambda x: x.cast("bigint")), over)
