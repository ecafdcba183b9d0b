"""Line dedup: hashes of lines are range-partitioned and streamed in the order of hash, document and position.

Every line is keyed by the 128-bit hash of its stripped, lower-cased text. The keys are dealt out by ranges of (hash,
document), so that a key that holds a third of all lines lies in as many tasks as it needs; each task streams its
sorted lines once. A run of equal hashes is settled within its task unless it is the task's first or last one: of
these, a summary goes to a table of at most two rows a task, which settles what is left open. No text is shuffled for
this, and what comes back are bitmaps: for each document that loses lines, one bit a line, compressed.

A document is named by its id and the hash of its text, so that rows that share an id each keep their own lines. In
counts of documents, rows of one id are one document; null is an id like any other.

Defined results: a null or empty text is one empty line; lines shorter than `least` code points never go; repeated
lines of one document count once; repeated rows get equal bitmaps; an empty table gives no rows; other columns are
not read, and `dedup` keeps them in its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import quoted, row_of, stored

BLANKS = b" \t\n\x0b\x0c\r"
#: Lines of one Arrow batch that a task writes.
STEP = 1 << 16

GOES, OPEN, RUN = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """A line without blanks at its ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def _lines(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """doc, t (hash of the text), n (lines of the text), pos, h1, h2 of each line that has a key."""
    named = docs.select(F.col(quoted(doc_id)).alias("doc"), F.xxhash64(F.col(quoted(text))).alias("t"), F.col(quoted(text)).cast("binary").alias("text")).filter("text is not null")
    kind = to_arrow_type(named.schema["doc"].dataType)
    names = ["doc", "t", "n", "pos", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts, places, digests = [], [], [], []

            def out() -> pa.RecordBatch:
                at = pa.array(rows, type=pa.int64())
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at).cast(kind), batch.column(1).take(at), pa.array(counts, type=pa.int32()), pa.array(places, type=pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=names
                )

            for i in range(batch.num_rows):
                lines = batch.column(2)[i].as_py().split(b"\n")
                for p, line in enumerate(lines):
                    key = line_key(line)
                    if len(key) < least or (least > 1 and len(key.decode()) < least):
                        continue
                    rows.append(i)
                    counts.append(len(lines))
                    places.append(p)
                    digests.append(xxhash.xxh3_128_digest(key))
                    if len(rows) == STEP:
                        yield out()
                        rows, counts, places, digests = [], [], [], []
            if rows:
                yield out()

    schema = f"doc {named.schema['doc'].dataType.simpleString()}, t bigint, n int, pos int, h1 bigint, h2 bigint"
    return named.mapInArrow(run, schema)


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first is another than the one before it; null equals null."""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    other = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
    return other.to_numpy(zero_copy_only=False).astype(bool)


class _Runs:
    """Streams sorted lines. `held` are the rows of the open run; the first `ghost` of them (0 or 1) are out already and
    stand for the `before` + 1 documents of the run up to them."""

    def __init__(self, documents: int, keep_first: bool):
        self.documents, self.keep_first = documents, keep_first
        self.held: pa.RecordBatch | None = None
        self.head: pa.RecordBatch | None = None
        self.ghost, self.before, self.opening = 0, 0, True

    def _tagged(self, rows: pa.RecordBatch, kind: int, docs: int = 0) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, docs, dtype=np.int64)), pa.array(np.full(n, kind, dtype=np.int8))], names=[*rows.schema.names, "docs", "kind"])

    def _counted(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        new_key = np.ones(rows.num_rows, dtype=bool)
        new_key[1:] = _differs(rows.column(4)) | _differs(rows.column(5))
        new_doc = new_key.copy()
        new_doc[1:] |= _differs(rows.column(0))
        return new_key, new_doc

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = batch if self.held is None else pa.concat_batches([self.held, batch])
        new = np.ones(rows.num_rows, dtype=bool)  # copies of a row are one
        new[1:] = np.logical_or.reduce([_differs(rows.column(c)) for c in range(6)])
        rows = rows if new.all() else rows.take(pa.array(np.flatnonzero(new)))
        new_key, new_doc = self._counted(rows)
        starts = np.flatnonzero(new_key)
        docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        docs[0] += self.before
        last = int(starts[-1])
        if len(starts) > 1:  # all runs but the last are complete
            if self.opening:
                yield from self._boundary(rows.slice(0, int(starts[1])), int(docs[0]))
            first = int(starts[1]) if self.opening else 0
            goes = np.repeat(docs >= self.documents, np.diff([*starts, rows.num_rows]))
            goes[:first] = goes[last:] = False
            if not self.opening and self.ghost:
                goes[0] = False
            elif self.keep_first and not self.opening:
                goes[0] = False
            if self.keep_first:
                goes[starts[1:]] = False
            if goes.any():
                yield self._tagged(rows.take(pa.array(np.flatnonzero(goes))), GOES)
            self.opening, self.ghost, self.before, self.head = False, 0, 0, None
        self.held = rows.slice(last)
        n = int(docs[-1])
        if n >= self.documents and self.held.num_rows > self.ghost + (self.keep_first and self.head is None):  # settled: only what it started with stays here
            out = self.held.slice(self.ghost)
            if self.head is None:
                self.head = out.slice(0, 1)
                out = out.slice(1) if self.keep_first else out
            if out.num_rows:
                yield self._tagged(out, GOES)
            self.held, self.ghost, self.before = self.held.slice(self.held.num_rows - 1), 1, n - 1

    def _boundary(self, run: pa.RecordBatch, docs: int) -> Iterator[pa.RecordBatch]:
        """The task's first or last run: other tasks may have more of it."""
        rows = run.slice(self.ghost)
        head = self.head if self.head is not None else rows.slice(0, 1)
        yield self._tagged(head, RUN, docs)
        if self.keep_first:
            yield self._tagged(head, OPEN)
            rows = rows if self.head is not None else rows.slice(1)
        if rows.num_rows:
            yield self._tagged(rows, GOES if docs >= self.documents else OPEN)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            _, new_doc = self._counted(self.held)
            yield from self._boundary(self.held, int(new_doc.sum()) + self.before)


def bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = 2, least: int = 1, keep_first: bool = True) -> DataFrame:
    """doc, t, n (lines), dropped, keep of each document that loses lines. Lines whose key is found in at least
    `documents` documents go; with keep_first the first of them, by document and position, stays.

    t is xxhash64 of the text. keep holds one bit a line, the first line in the highest bit of the first byte, by zlib.
    """
    lines = stored(_lines(docs, doc_id, text, least))
    dealt = lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "t", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(documents, keep_first)
        for batch in batches:
            if batch.num_rows:
                yield from runs.take(batch)
        yield from runs.end()

    kind = lines.schema["doc"].dataType.simpleString()
    found = stored(dealt.mapInArrow(run, f"doc {kind}, t bigint, n int, pos int, h1 bigint, h2 bigint, docs bigint, kind tinyint"))
    # Two rows a task at most.
    whole = found.filter(F.col("kind") == RUN).groupBy("h1", "h2").agg(F.sum("docs").alias("all"), F.min(F.struct("doc", "t", "pos")).alias("first")).filter(F.col("all") >= documents)
    settled = found.filter(F.col("kind") == OPEN).join(F.broadcast(whole), ["h1", "h2"])
    if keep_first:
        settled = settled.filter(~F.struct("doc", "t", "pos").eqNullSafe(F.col("first")))
    gone = found.filter(F.col("kind") == GOES).select("doc", "t", "n", "pos").unionByName(settled.select("doc", "t", "n", "pos"))
    per_doc = gone.groupBy("doc", "t").agg(F.first("n").alias("n"), F.collect_list("pos").alias("gone"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, dropped = [], []
            for i in range(batch.num_rows):
                bits = np.ones(batch.column(2)[i].as_py(), dtype=bool)
                gone = batch.column(3)[i].values.to_numpy()
                bits[gone] = False
                dropped.append(len(gone))
                kept.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dropped, type=pa.int32()), pa.array(kept, type=pa.binary())], names=["doc", "t", "n", "dropped", "keep"])

    return per_doc.mapInArrow(pack, f"doc {kind}, t bigint, n int, dropped int, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> bytes:
    """The lines of a text that its bitmap keeps."""
    if keep is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    return b"\n".join(lines[i] for i in np.flatnonzero(bits).tolist())


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """row (all columns of the document in a struct, the text with the lines that stay; null stays null), n_lines and
    n_dropped of each document."""
    maps = bitmaps(docs, doc_id, text, **how).select(F.col("doc").alias("m_doc"), F.col("t").alias("m_t"), "dropped", "keep")
    # All columns travel in one struct, so that names may clash; the text travels once, in it.
    rows = docs.select(row_of(docs).alias("row"), F.col(quoted(doc_id)).alias("doc"), F.xxhash64(F.col(quoted(text))).alias("t"))
    met = rows.join(maps, F.col("doc").eqNullSafe(F.col("m_doc")) & (F.col("t") == F.col("m_t")), "left").select("row", "dropped", "keep")
    at = docs.columns.index(text)
    schema = T.StructType([met.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, kept = batch.column(0), [], []
            texts = row.field(at).cast(pa.binary())
            for t, k in zip(texts, batch.column(2)):
                whole = t.as_py()
                n.append(1 if whole is None else whole.count(b"\n") + 1)
                kept.append(None if whole is None else kept_lines(whole, k.as_py()))
            fields = [pa.array(kept, type=pa.binary()).cast(pa.string()) if i == at else row.field(i) for i in range(row.type.num_fields)]
            new = pa.StructArray.from_arrays(fields, fields=[row.type.field(i).with_type(f.type) for i, f in enumerate(fields)])
            yield pa.RecordBatch.from_arrays([new, pa.array(n, type=pa.int64()), pc.fill_null(batch.column(1), 0).cast(pa.int64())], names=["row", "n_lines", "n_dropped"])

    return met.mapInArrow(run, schema)
