"""Tables in key buckets, changed by whole versions.

    FOLDER/data/ID/bucket=K/...     rows, written once and never changed
    FOLDER/versions/N.json          the manifest of version N: its schema, keys and the folder of each bucket

A write puts its rows into a fresh data folder and then makes its manifest by renaming one small file, which fails if
another writer was first. So readers see the version before or the one after, a failed write leaves no trace in the
table, a table may be read and replaced by the same job, and an upsert writes the buckets that its batch touches and
no others. Two versions are kept: what only older ones used is removed after each write. Streams name themselves and
number their batches; a batch that the newest version has already is not written again.

A table whose rows add up (merge) holds its batches as parts, data/ID/..., and adds them up when it is read. A write
makes one part of many small ones, so parts stay few and a batch doesn't write the whole table again.

The file system must rename atomically (HDFS and local ones do).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from cairnlore.functions.lineage import cut_lineage, write_packed
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column of the bucket in data folders.
BUCKET = "__bucket"

#: So many parts of one level (0: one batch) become a part of the next.
PARTS = 8


class Conflict(RuntimeError):
    """Another writer made the version that this one was going to make; read again and repeat the change."""


class _Files:
    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, file: str) -> str:
        stream = self.fs.open(self.path(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, file: str, text: str) -> None:
        """The file with its whole text, or Conflict if it is there."""
        temporary = f"{file}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(temporary), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self.path(file)) or not self.fs.rename(self.path(temporary), self.path(file)):
            self.remove(temporary)
            raise Conflict(file)

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class VersionedTable:
    """A table in FOLDER whose rows are dealt to `buckets` buckets by `keys` (no keys: one bucket)."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str] = (), buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.keys, self.buckets = list(keys), buckets if keys else 1
        self.files = _Files(spark, self.folder)

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.folder}/versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or of the newest one; None for a table that was never written."""
        known = self._versions()
        if not known:
            return None
        return json.loads(self.files.text(f"{self.folder}/versions/{known[-1] if version is None else version}.json"))

    def has(self, stream: str, batch: int) -> bool:
        """Whether the newest version holds a stream's batch."""
        found = self.manifest()
        return found is not None and found["streams"].get(stream, -1) >= batch

    def _rows(self, found: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(found["schema"])
        return self._read(schema, [place for b, place in found["parts"].items() if buckets is None or int(b) in buckets])

    def _read(self, schema: T.StructType, places: list[str]) -> DataFrame:
        paths = sorted({f"{self.folder}/data/{place}" for place in places})
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, dealt_by: list[str] = ()) -> DataFrame:
        """The rows of a version, or of the newest one. dealt_by: keys by which parts that are added up are dealt to
        tasks, for what groups by them next (none: all keys)."""
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(self.folder)
        rows = self._rows(found)
        if len(found["parts"]) < 2 or "how" not in found:
            return rows
        return self._added(rows.repartition(*dealt_by) if dealt_by else rows, found["how"], rows.schema)

    def _added(self, rows: DataFrame, how: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
        """The keys' rows added up, with the types of a schema."""
        typed = lambda c, x: x if schema is None else x.cast(schema[c].dataType)
        return rows.groupBy(*self.keys).agg(*[typed(c, getattr(F, f)(c)).alias(c) for c, f in how.items()])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def _write(self, rows: DataFrame, before: dict | None, kept: Callable[[set[int]], dict], stream: str | None, batch: int | None, level: int = 0, how: dict[str, str] | None = None) -> int:
        """Writes rows (with BUCKET) into a fresh folder and makes the next version of it and of the parts that kept
        gives for the buckets written. how: the rows (without BUCKET) are a part, of this level, of a table that adds
        them up so."""
        folder = uuid.uuid4().hex
        version = 0 if before is None else before["version"] + 1
        schema = json.loads(rows.drop(BUCKET).schema.json())
        try:
            if how:
                write_packed(rows, f"{self.folder}/data/{folder}")
                written, parts = set(), {f"{level}.{version}": folder}
            else:
                # A bucket is written by one task, unless there is but one bucket.
                dealt = rows.repartition(BUCKET) if self.buckets > 1 else rows
                dealt.write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{folder}")
                written = {int(n.split("=")[1]) for n in self.files.names(f"{self.folder}/data/{folder}") if n.startswith(f"{BUCKET}=")}
                parts = {str(b): f"{folder}/{BUCKET}={b}" for b in written}
            streams = dict(before["streams"]) if before else {}
            if stream is not None:
                streams[stream] = batch
            manifest = {"version": version, "schema": schema, "keys": self.keys, "buckets": self.buckets, "parts": kept(written) | parts, "streams": streams} | ({"how": how} if how else {})
            self.files.create(f"{self.folder}/versions/{version}.json", json.dumps(manifest))
        except BaseException:
            self.files.remove(f"{self.folder}/data/{folder}")
            raise
        self._clean(version)
        return version

    def _clean(self, newest: int) -> None:
        """Removes versions before the last two, and the data that only they used."""
        kept = [v for v in self._versions() if v >= newest - 1]
        used = {place.split("/")[0] for v in kept for place in self.manifest(v)["parts"].values()}
        places = {place for v in kept for place in self.manifest(v)["parts"].values()}
        for v in self._versions():
            if v < newest - 1:
                for place in self.manifest(v)["parts"].values():
                    if place not in places:
                        self.files.remove(f"{self.folder}/data/{place}")
                    if place.split("/")[0] not in used:
                        self.files.remove(f"{self.folder}/data/{place.split('/')[0]}")
                self.files.remove(f"{self.folder}/versions/{v}.json")

    def replace(self, rows: DataFrame) -> int:
        """All rows anew; returns the version."""
        return self._write(rows.withColumn(BUCKET, self._bucket()), self.manifest(), lambda _: {}, None, None)

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """More rows; the new version reads them beside the old ones, each append in a part of its own until the table is
        replaced. Only for tables without keys. A stream's batch that is in the table already changes nothing."""
        before = self.manifest()
        if self.keys:
            raise ValueError("rows of a table with keys are upserted")
        if before is not None and "how" in before:
            raise ValueError("rows of a table that adds up are merged")
        if before is not None and stream is not None and before["streams"].get(stream, -1) >= batch:
            return before["version"]
        older = {f"v{before['version']}" if k == "0" else k: p for k, p in before["parts"].items()} if before else {}
        return self._write(rows.withColumn(BUCKET, F.lit(0)), before, lambda _: older, stream, batch)

    def upsert(self, rows: DataFrame, order: str, stream: str | None = None, batch: int | None = None, deleted: str | None = None) -> int:
        """rows in place of those with the same keys, of several the last by `order`; rows whose column `deleted` is
        true take theirs away. A stream's batch that is in the table already changes nothing."""
        columns = [c for c in rows.columns if c != deleted]
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        new = rows.select(*columns, gone.alias("__gone"), F.lit(1).alias("__new"))
        last = W.partitionBy(BUCKET, *self.keys).orderBy(F.desc(order), F.desc("__new"), F.to_json(F.struct(*columns)))

        def newest(merged: DataFrame) -> DataFrame:
            return merged.withColumn("__r", F.row_number().over(last)).filter("__r = 1 AND NOT __gone").select(*columns, BUCKET)

        return self._change(new, lambda old: old.select(*columns, F.lit(False).alias("__gone"), F.lit(0).alias("__new")), newest, stream, batch)

    def merge(self, rows: DataFrame, how: dict[str, Callable[[str], Column]], stream: str | None = None, batch: int | None = None) -> int:
        """rows added to those with the same keys, column by column: how gives each column's aggregate, F.sum, F.min or
        F.max. A stream's batch that is in the table already changes nothing.

        The batch becomes a part of its own, together with the parts of a level that has PARTS of them then: a row is
        written again a few times (by the logarithm of the batches), and never because another batch has its bucket."""
        before, names = self.manifest(), {c: f.__name__ for c, f in how.items()}
        if self._is_in(before, stream, batch):
            return before["version"]
        self._check(before)
        if before is not None and before.get("how", names) != names:
            raise ValueError(f"the table adds up by {before['how']}")
        added = self._added(rows.select(*self.keys, *how), names)
        parts, level, joined = dict(before["parts"]) if before else {}, 0, []
        # Buckets of a table that was written otherwise have no level; they count as batches.
        while len(same := [k for k in parts if int(k.split(".")[0] if "." in k else 0) == level]) >= PARTS - 1:
            joined += [parts.pop(k) for k in same]
            level += 1
        if before is not None:
            schema = T.StructType([f for f in T.StructType.fromJson(before["schema"]) if f.name in added.columns])
            if joined:
                added = self._added(rows.select(*added.columns).unionByName(self._read(schema, joined)), names)
            added = added.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        return self._write(added, before, lambda _: parts, stream, batch, level, names)

    def _change(self, new: DataFrame, as_new: Callable[[DataFrame], DataFrame], settled: Callable[[DataFrame], DataFrame], stream: str | None, batch: int | None) -> int:
        """settled gives the rows that stay (with BUCKET) of the new ones and the old ones of the buckets touched."""
        before = self.manifest()
        if self._is_in(before, stream, batch):
            return before["version"]
        self._check(before)
        merged = cut_lineage(new.withColumn(BUCKET, self._bucket()))  # read twice
        touched = [r[0] for r in merged.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
        parts = before["parts"] if before else {}
        if parts and "how" in before:  # parts hold rows of all buckets
            old, parts = self.read(before["version"]), {}
            merged = merged.unionByName(as_new(old).withColumn(BUCKET, self._bucket()))
        elif parts and touched:
            merged = merged.unionByName(as_new(self._rows(before, touched)).withColumn(BUCKET, self._bucket()))
        return self._write(settled(merged), before, lambda _: {b: p for b, p in parts.items() if int(b) not in touched}, stream, batch)

    def _is_in(self, found: dict | None, stream: str | None, batch: int | None) -> bool:
        return found is not None and stream is not None and found["streams"].get(stream, -1) >= batch

    def _check(self, found: dict | None) -> None:
        if found is not None and (found["keys"], found["buckets"]) != (self.keys, self.buckets):
            raise ValueError(f"the table has the keys {found['keys']} in {found['buckets']} buckets")
