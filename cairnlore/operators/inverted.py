"""A positional inverted index in Parquet, and full-text queries that read postings instead of texts.

A task that reads texts numbers its documents in blocks of at most `BLOCK` and of about `WORDS` words, and writes each
block's postings at once: neither texts nor single occurrences are shuffled. A posting row holds one term's occurrences
in one block, as a sorted array of number * 2^32 + position, so a term that is in every document is as many rows as
there are blocks, none of them larger than its block's texts. Posting rows lie in Parquet folders by `bucket`, the hash
of the term's first two letters, sorted by term; a query reads the folders of its words, and of those the row groups
that can hold them.

A query is settled block by block: the occurrences of its words meet in one row, phrases are intersections of
occurrences shifted by their place in the phrase, words and prefixes are sets of document numbers, and AND, OR and NOT
are set operations on these. Nothing but numbers is shuffled, and texts aren't read.

Defined results: a null text has no words; a query without words matches nothing; NOT alone matches every document
without the word; of rows that share a key each is searched by itself, and the key comes once for each that matches; a
null key can't be searched for and is left out.
"""

from __future__ import annotations

import shlex
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from cairnlore.operators.text import normal_words, search_form
from cairnlore.sources.versions import VersionedTable
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Documents and words of a block, and folders of terms.
BLOCK, WORDS, BUCKETS = 4096, 1 << 20, 64
#: The folder of the blocks' keys.
KEYS = -1
#: Highest code point, behind all terms that begin with a prefix.
LAST = "\U0010ffff"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(buckets)).cast("int")


def _number(at: Column) -> Column:
    """The document of an occurrence."""
    return F.shiftright(at, 32)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """bucket, term, block, at (occurrences), n (documents) of each term in each block; and for each block a row of
    bucket KEYS with its documents' keys, in the order of their numbers."""
    named = docs.select(F.col(key).alias("key"), search_form(F.col(text)).cast("binary").alias("form")).filter("key is not null")
    kind = to_arrow_type(named.schema["key"].dataType)
    schema = f"term string, block bigint, at array<bigint>, n bigint, keys array<{named.schema['key'].dataType.simpleString()}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ids: dict[bytes, int] = {}
        words: list[np.ndarray] = []
        keys: list = []
        held = made = 0

        def closed() -> Iterator[pa.RecordBatch]:
            number = np.repeat(np.arange(len(words), dtype=np.int64), [len(w) for w in words])
            seq = np.concatenate(words)
            first = np.cumsum([0, *(len(w) for w in words[:-1])])
            at = number << 32 | np.arange(len(seq), dtype=np.int64) - first[number]
            order = np.argsort(seq, kind="stable")
            counts = np.bincount(seq, minlength=len(ids))
            starts = np.concatenate([[0], np.cumsum(counts)])
            number = number[order]
            new = np.ones(len(number), dtype=np.int64)
            new[1:] = (number[1:] != number[:-1]) | (seq[order][1:] != seq[order][:-1])
            n = np.add.reduceat(new, starts[:-1]) if len(ids) else np.zeros(0, dtype=np.int64)
            own = task << 32 | made
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(ids), type=pa.binary()).cast(pa.string()), pa.array(np.full(len(ids), own)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(at[order])), pa.array(n), pa.nulls(len(ids), pa.list_(kind))],
                names=["term", "block", "at", "n", "keys"],
            )
            for lo in range(0, rows.num_rows, 4096):
                yield rows.slice(lo, 4096)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([own]), pa.array([None], pa.list_(pa.int64())), pa.array([len(keys)]), pa.array([keys], pa.list_(kind))], names=["term", "block", "at", "n", "keys"])

        for batch in batches:
            for k, form in zip(batch.column(0), batch.column(1)):
                said = form.as_py().split(b" ")[1:-1]
                said = [w for w in said if w]
                for w in said:
                    if w not in ids:
                        ids[w] = len(ids)
                words.append(np.fromiter(map(ids.__getitem__, said), dtype=np.int64, count=len(said)))
                keys.append(k.as_py())
                held += len(said)
                if len(keys) == block or held >= WORDS:
                    yield from closed()
                    made += 1
                    ids, words, keys, held = {}, [], [], 0
        if keys:
            yield from closed()

    rows = named.mapInArrow(run, schema)
    return rows.select(F.when(F.col("term").isNull(), F.lit(KEYS)).otherwise(_bucket(F.col("term"), buckets)).alias("bucket"), "term", "block", "at", "n", "keys")


class InvertedIndex:
    """An index in FOLDER: documents (a versioned table) and postings/VERSION/bucket=B."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.documents = VersionedTable(spark, f"{self.folder}/documents")

    def build(self, docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> InvertedIndex:
        """Indexes a table anew. Readers use the index before until the documents have changed over."""
        found = self.documents.manifest()
        version = 0 if found is None else found["version"] + 1
        folder = f"{self.folder}/postings/{version}"
        rows = postings(docs, key, text, block, self.buckets)
        # A folder's terms are written in parts by block, as many as the table is large, so that no folder and no term
        # is left to one task.
        parts = max(16, docs.rdd.getNumPartitions() // 8)
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(parts))).sortWithinPartitions("bucket", "term", "block")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        known = self.spark.read.schema(rows.schema).parquet(folder)
        self.documents.replace(known.filter(F.col("bucket") == KEYS).select("block", "keys"))
        self.documents.files.remove(f"{self.folder}/postings/{version - 2}")
        return self

    def terms(self) -> DataFrame:
        """bucket, term, block, at, n."""
        schema = "term string, block bigint, at array<bigint>, n bigint, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/postings/{self.documents.manifest()['version']}").filter(F.col("bucket") != KEYS)

    def search(self, query: str) -> DataFrame:
        """key: the documents that match a query of words, "phrases", prefix*, AND, OR and NOT."""
        alternatives = parse(query)
        items = list(dict.fromkeys(i for tests in alternatives for i, _ in tests))
        if not items:
            return self.documents.read().select(F.explode("keys").alias("key")).limit(0)
        asked = list(dict.fromkeys(w for i in items for w in i.words()))
        read = self._read(asked)
        # One row a block: each word's occurrences, those of a prefix from all its terms.
        found = read.groupBy("block").agg(*[F.flatten(F.collect_list(F.when(w.matches(F.col("term")), F.col("at")))).alias(f"w{k}") for k, w in enumerate(asked)])
        none = F.array().cast("array<bigint>")
        of = {w: F.coalesce(F.col(f"w{k}"), none) for k, w in enumerate(asked)}
        met = self.documents.read().join(found, "block", "left")
        for k, item in enumerate(items):
            met = met.withColumn(f"i{k}", item.documents(of))
        column = {item: F.col(f"i{k}") for k, item in enumerate(items)}
        everything = F.transform(F.sequence(F.lit(0), F.size("keys") - 1), lambda n: n.cast("bigint"))

        def conjunction(tests: list[tuple[Item, bool]]) -> Column:
            wanted = [column[i] for i, negated in tests if not negated]
            out = reduce(F.array_intersect, wanted) if wanted else everything
            return reduce(F.array_except, [column[i] for i, negated in tests if negated], out)

        numbers = reduce(F.array_union, [conjunction(tests) for tests in alternatives])
        return met.select("keys", F.explode(numbers).alias("number")).select(F.get("keys", F.col("number").cast("int")).alias("key"))

    def _read(self, words: list[Word]) -> DataFrame:
        """The posting rows of words: folders are pruned by the terms' first letters, row groups by the terms. A prefix
        of one letter may be in any folder."""
        rows = self.terms()
        if all(len(w.text) > 1 or not w.prefix for w in words):
            numbers = self.spark.range(1).select(*[_bucket(F.lit(w.text), self.buckets).alias(f"b{k}") for k, w in enumerate(words)]).first()
            rows = rows.filter(F.col("bucket").isin(*set(numbers)))
        return rows.filter(reduce(lambda a, b: a | b, [w.matches(F.col("term")) for w in words]))

    def share(self, query: str) -> tuple[int, int]:
        """Posting rows that a query reads, and all there are."""
        asked = list(dict.fromkeys(w for tests in parse(query) for i, _ in tests for w in i.words()))
        return self._read(asked).count() if asked else 0, self.terms().count()


@dataclass(frozen=True)
class Word:
    """A term, or all that begin with it."""

    text: str
    prefix: bool = False

    def matches(self, term: Column) -> Column:
        return (term >= self.text) & (term < F.lit(self.text + LAST)) if self.prefix else term == F.lit(self.text)


@dataclass(frozen=True)
class Item:
    """A word or phrase; with prefix, its last word stands for all that begin with it."""

    text: str
    prefix: bool = False

    def words(self) -> list[Word]:
        *first, last = self.text.split(" ")
        return [*map(Word, first), Word(last, self.prefix)]

    def documents(self, of: dict[Word, Column]) -> Column:
        """The numbers of the documents that have it, each once."""
        back = lambda k: lambda x: x - k
        shifted = [F.transform(of[w], back(k)) if k else of[w] for k, w in enumerate(self.words())]
        starts = reduce(F.array_intersect, shifted)
        return F.array_distinct(F.transform(starts, _number))


def parse(query: str) -> list[list[tuple[Item, bool]]]:
    """Alternatives of (item, negated); OR binds weakest, AND may be left out."""
    alternatives: list[list[tuple[Item, bool]]] = [[]]
    negated = False
    for part in shlex.split(query.replace("'", " "), posix=False):
        if part == "OR":
            alternatives.append([])
        elif part == "NOT":
            negated = True
        elif part != "AND" and (words := normal_words(part)):
            alternatives[-1].append((Item(words, part.endswith("*")), negated))
            negated = False
    return [tests for tests in alternatives if tests]
