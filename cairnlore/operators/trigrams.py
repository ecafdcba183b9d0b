"""A trigram index of texts in Parquet, and regular-expression search that reads only the texts that can match.

Texts are written once, without a shuffle, with the number that their task gives them; 4,096 numbers are a block. From
what was written each block's trigrams (three bytes, ASCII letters in lower case) are taken with numpy and kept as
posting rows: gram, block and the sorted numbers of the documents that have it, in folders by `bucket` of the gram. A
gram that every text has is as many rows as there are blocks.

A pattern is read for the strings that each of its matches must hold: all of a sequence, any of the branches of an
alternation. Their trigrams are met block by block with array operations; the texts that are left are read from the
folders that hold any (at most `FOLDERS`) and tried with the pattern itself, so the index decides what is read and never
what is found. A pattern that demands no three letters in a row, or that isn't understood alike by both kinds of regular
expressions, is tried on all texts.

Defined results: a null text has no lines; rows of one key are searched by themselves; null keys are kept; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import re
import uuid
import warnings
from collections.abc import Iterator
from functools import reduce
from re import _parser as parser

import numpy as np
import pyarrow as pa
from cairnlore.functions.columns import token_estimate
from cairnlore.operators import text as ops
from cairnlore.sources.versions import VersionedTable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Bits of a number within its block, folders of texts, folders of postings.
BITS, FOLDERS, BUCKETS = 12, 1024, 64
#: Trigrams of documents that a task holds before it writes posting rows; a block may have several rows of one gram.
HELD = 1 << 22

#: What every match must hold: a string, or ("all" | "any", parts).
Need = bytes | tuple
EVERYTHING: Need = ("all", ())


def needs(pattern: str) -> Need:
    """The strings that a match of the pattern holds, in lower case."""
    # Forms that Java and Python read differently: back references and octals, case folding beyond ASCII.
    if re.search(r"\\[0-9]|\(\?[a-zA-Z]*[uU]", pattern):
        return EVERYTHING
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # nested and intersected classes
            return _sequence(parser.parse(pattern))
    except (re.error, FutureWarning, DeprecationWarning, OverflowError):
        return EVERYTHING


def _sequence(items) -> Need:
    parts: list[Need] = []
    run = b""

    def closed(rest: bytes = b"") -> bytes:
        if len(run) > 2:
            parts.append(run)
        return rest

    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and 32 <= arg < 127:
            run += chr(arg).lower().encode()
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            pass  # of no width
        elif name == "SUBPATTERN":
            run = closed()
            parts.append(_sequence(arg[3]))
        elif name == "ATOMIC_GROUP":
            run = closed()
            parts.append(_sequence(arg))
        elif name == "BRANCH":
            run = closed()
            parts.append(("any", tuple(_sequence(b) for b in arg[1])))
        elif name.endswith("REPEAT") and arg[0] > 0:
            run = closed()
            parts.append(_sequence(arg[2]))
        else:
            run = closed()
    closed()
    return ("all", tuple(parts))


def grams(need: Need) -> list[int]:
    """The trigrams of a need, each once."""
    if isinstance(need, bytes):
        return list(dict.fromkeys(need[k] << 16 | need[k + 1] << 8 | need[k + 2] for k in range(len(need) - 2)))
    return list(dict.fromkeys(g for part in need[1] for g in grams(part)))


def settled(need: Need, of: dict[int, Column]) -> Column | None:
    """The numbers of a block's documents that may meet a need; None for all of them."""
    if isinstance(need, bytes):
        return reduce(F.array_intersect, [of[g] for g in grams(need)])
    found = [settled(part, of) for part in need[1]]
    if need[0] == "any":
        return None if any(f is None for f in found) else reduce(F.array_union, found)
    found = [f for f in found if f is not None]
    return reduce(F.array_intersect, found) if found else None


def postings(texts: DataFrame) -> DataFrame:
    """gram, block, at of texts (block, number, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        numbers: list[int] = []
        held, own = 0, None

        def closed() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            gram = np.concatenate(found)
            at = np.repeat(np.array(numbers, dtype=np.int32), [len(f) for f in found])
            order = np.lexsort((at, gram))
            gram, at = gram[order], at[order]
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gram)).astype(np.int32)), pa.array(at))
            rows = pa.RecordBatch.from_arrays([pa.array(gram[starts]), pa.array(np.full(len(starts), own)), lists], names=["gram", "block", "at"])
            for lo in range(0, rows.num_rows, 4096):
                yield rows.slice(lo, 4096)

        for batch in batches:
            for block, number, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if block != own or held > HELD:
                    yield from closed()
                    found, numbers, held, own = [], [], 0, block
                b = np.frombuffer(said.as_py().lower(), dtype=np.uint8).astype(np.int32)
                if len(b) > 2:
                    found.append(np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]))
                    numbers.append(number)
                    held += len(found[-1])
        yield from closed()

    return texts.filter("text is not null").select("block", "number", F.col("text").cast("binary")).mapInArrow(run, "gram int, block bigint, at array<int>")


class TrigramIndex:
    """An index in FOLDER: texts/ID/part=P, postings/ID/bucket=B, and the ID in use (a versioned table)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, bits: int = BITS):
        self.spark, self.folder, self.buckets, self.bits = spark, folder.rstrip("/"), buckets, bits
        self.current = VersionedTable(spark, f"{self.folder}/current")

    def _part(self, block: Column) -> Column:
        """The folder of a block: numbers have their task in the bits from 33 on."""
        return F.pmod(F.shiftright(block, 33 - self.bits), F.lit(FOLDERS)).cast("int")

    def build(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> TrigramIndex:
        """Indexes a table anew. Readers use the index before until the new one is whole."""
        made = uuid.uuid4().hex
        before = None if self.current.manifest() is None else self.current.read().first()
        named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        block = F.shiftright("n", self.bits)
        numbered = named.withColumn("n", F.monotonically_increasing_id()).select("key", "text", block.alias("block"), (F.col("n") - F.shiftleft(block, self.bits)).cast("int").alias("number"))
        numbered.withColumn("part", self._part(F.col("block"))).write.partitionBy("part").parquet(f"{self.folder}/texts/{made}")
        schema = StructType([*numbered.schema.fields, StructField("part", IntegerType())])
        rows = postings(self.spark.read.schema(schema).parquet(f"{self.folder}/texts/{made}"))
        rows = rows.withColumn("bucket", F.pmod("gram", F.lit(self.buckets)))
        parts = max(16, docs.rdd.getNumPartitions() // 8)
        rows.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(parts))).sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{self.folder}/postings/{made}")
        self.current.replace(self.spark.createDataFrame([(made, schema.json(), before and before["id"])], "id string, schema string, before string"))
        if before and before["before"]:
            for kind in ("texts", "postings"):
                self.current.files.remove(f"{self.folder}/{kind}/{before['before']}")
        return self

    def texts(self) -> DataFrame:
        """key, text, block, number, part."""
        now = self.current.read().first()
        return self.spark.read.schema(StructType.fromJson(json.loads(now["schema"]))).parquet(f"{self.folder}/texts/{now['id']}")

    def postings(self) -> DataFrame:
        """gram, block, at, bucket."""
        return self.spark.read.schema("gram int, block bigint, at array<int>, bucket int").parquet(f"{self.folder}/postings/{self.current.read().first()['id']}")

    def numbers(self, pattern: str) -> DataFrame | None:
        """part, block, number of the texts that may match; None if the pattern tells nothing."""
        need = needs(pattern)
        asked = grams(need)
        of = {g: F.col(f"g{g}") for g in asked}
        left = settled(need, of) if asked else None
        if left is None:
            return None
        read = self.postings().filter(F.col("bucket").isin(*{g % self.buckets for g in asked}) & F.col("gram").isin(*asked))
        met = read.groupBy("block").agg(*[F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("at")))).alias(f"g{g}") for g in asked])
        return met.select("block", F.explode(left).alias("number")).select(self._part(F.col("block")).alias("part"), "block", "number")

    def candidates(self, pattern: str) -> DataFrame:
        """key, text of the texts that may match."""
        numbers = self.numbers(pattern)
        if numbers is None:
            return self.texts().select("key", "text")
        parts = [r.part for r in numbers.select("part").distinct().collect()]  # at most FOLDERS
        return self.texts().filter(F.col("part").isin(*parts)).join(numbers, ["part", "block", "number"], "left_semi").select("key", "text")

    def grep(self, pattern: str) -> DataFrame:
        """key, line (from 1), content of the lines that match, trimmed."""
        return ops.grep(self.candidates(pattern), pattern, "key")

    def search(self, pattern: str, glob: str = "", limit: int = 50) -> DataFrame:
        """key, line, content: of each text whose key is in the glob its first `limit` matching lines, and of all these
        the first `limit` by key and line."""
        found = self.grep(pattern)
        if glob:
            found = found.filter(F.col("key").rlike(glob_pattern(glob)))
        of_file = W.partitionBy("key").orderBy("line", "content")
        return found.withColumn("r", F.row_number().over(of_file)).filter(F.col("r") <= limit).drop("r").orderBy("key", "line", "content").limit(limit)

    def share(self, pattern: str) -> tuple[int, int]:
        """Texts that a pattern is tried on, and all there are."""
        return self.candidates(pattern).count(), self.texts().count()


def glob_pattern(glob: str) -> str:
    """A glob as a pattern of whole names: `*` and `?` stay within a folder, `**` doesn't; one without a slash is of the
    name's last part."""
    parts = re.split(r"(\*\*/?|\*|\?)", glob)
    signs = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return ("^" if "/" in glob else "^(?:.*/)?") + "".join(signs[p] if p in signs else re.escape(p) for p in parts) + "$"


def snippets(index: TrigramIndex, chunks: DataFrame, query: str, language: str = "", glob: str = "", most: int = 50, limit: int = 5) -> DataFrame:
    """path, first, last, content, context, tokens, rank: the first `limit` chunks (path, language, kind, name, first,
    last, content) of a language that match the full-text query; only where none does, the first `limit` lines of texts
    in the glob that hold a match of the query as a pattern, each from 5 lines above on for `most` lines."""
    wanted = chunks.filter(F.col("language") == language) if language else chunks
    hits = ops.full_text(wanted, query, "content")
    best = hits.select("path", F.col("first").alias("line"), "first", "last", "content", F.concat_ws(": ", "kind", "name").alias("context")).orderBy("path", "line", "context", "content").limit(limit)
    if best.isEmpty():
        texts = index.candidates(query)
        if glob:
            texts = texts.filter(F.col("key").rlike(glob_pattern(glob)))
        windows = ops.snippet_windows(texts, query, 5, most, "key")
        context = F.concat(F.lit(f"Match for '{query}' at line "), F.col("line").cast("string")).alias("context")
        best = windows.select(F.col("key").alias("path"), "line", "first", "last", F.col("snippet").alias("content"), context).orderBy("path", "line", "content").limit(limit)
    rank = F.row_number().over(W.orderBy("path", "line", "context", "content")).cast("bigint").alias("rank")  # of at most `limit` rows
    bounds = [F.col(c).cast("bigint").alias(c) for c in ("first", "last")]
    return best.select("path", *bounds, "content", "context", token_estimate(F.col("content")).alias("tokens"), rank)
