"""An impact index of sparse vectors in Parquet: exact top-k by cosine from the blocks that can hold one of the k.

A document's impacts are its weights over its norm, so a cosine is a sum of products. Documents are sorted by kind and
by the term of their greatest impact before they are numbered, so that a block of `BLOCK` numbers holds documents that
are alike, and a block's greatest impact of a term says much about all of them. Two tables are written: rows of block,
kind and term with the impacts and numbers of its documents, and the greatest impact of each such row.

A search sums each block's greatest impacts into a bound that none of its documents exceeds. It first scores the few
blocks with the greatest bounds; their k-th best similarity is a floor, and then it scores every block whose bound
reaches the floor. A block that is left out holds no document of the k, so the result equals a full scan's; how much is
read depends on the data alone.

Defined results: only documents that share a term with the query are found; one whose weights are all zero is similar to
nothing; ties go to the smaller
id; similarities are rounded to six places before they are compared; of rows with one id and one term the weights are
added up; a null kind is a kind of its own that no filter names; an empty index gives no rows.
"""

from __future__ import annotations

import uuid

from cairnlore.sources.versions import VersionedTable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of a block, folders of blocks, and blocks whose scores give the floor.
BLOCK, FOLDERS, FIRST = 64, 256, 16
#: Below a floor by this much a bound still counts: sums of doubles and the rounding to six places.
SLACK = 2e-6


class ImpactIndex:
    """An index in FOLDER: postings/ID/part=P, maxima/ID, documents/ID, and the ID in use (a versioned table)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.current = VersionedTable(spark, f"{self.folder}/current")

    def build(self, vectors: DataFrame, kinds: DataFrame | None = None, block: int = BLOCK) -> ImpactIndex:
        """Indexes vectors (doc_id, idx, weight) anew; kinds are (doc_id, kind), one row for each document."""
        made = uuid.uuid4().hex
        before = None if self.current.manifest() is None else self.current.read().first()
        entry = F.struct("idx", "weight")
        added = vectors.groupBy("doc_id", "idx").agg(F.sum("weight").alias("weight"))
        docs = added.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # at most the vocabulary
        docs = docs.join(kinds.select("doc_id", "kind"), "doc_id", "left") if kinds is not None else docs.withColumn("kind", F.lit(None).cast("string"))
        norm = F.sqrt(F.aggregate("entries", F.lit(0.0), lambda s, e: s + e.weight * e.weight))
        unit = docs.withColumn("norm", norm).filter("norm > 0").select("doc_id", "kind", F.transform("entries", lambda e: F.struct(e.idx.alias("idx"), (e.weight / F.col("norm")).alias("impact"))).alias("entries"))
        heaviest = F.array_max(F.transform("entries", lambda e: F.struct(e.impact, -e.idx)))["col2"]
        parts = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = unit.withColumn("top", -heaviest).repartitionByRange(parts, "kind", "top", "doc_id").sortWithinPartitions("kind", "top", "doc_id")
        n = F.monotonically_increasing_id()
        ordered.withColumn("n", n).select("doc_id", "kind", F.expr(f"n div {block}").alias("block"), F.shiftright("n", 33).alias("task"), "entries").write.parquet(f"{self.folder}/documents/{made}")
        # From here on what was written is read, so numbers don't change with a task that runs again.
        each = self._table("documents", made).select("block", "kind", (F.col("task") % FOLDERS).cast("int").alias("part"), "doc_id", F.explode("entries").alias("e")).select("block", "kind", "part", "doc_id", "e.*")
        rows = each.groupBy("part", "block", "kind", "idx").agg(F.sort_array(F.collect_list(F.struct("impact", "doc_id")), asc=False).alias("docs"))  # at most a block
        rows = rows.withColumn("most", F.col("docs")[0]["impact"]).withColumn("least", F.element_at("docs", -1)["impact"])
        rows.repartition("part", F.pmod(F.xxhash64("block"), F.lit(max(1, parts // FOLDERS)))).sortWithinPartitions("part", "block", "idx").write.partitionBy("part").parquet(f"{self.folder}/postings/{made}")
        self._table("postings", made).select("part", "block", "kind", "idx", "most", "least").sortWithinPartitions("idx").write.parquet(f"{self.folder}/maxima/{made}")
        self.current.replace(self.spark.createDataFrame([(made, before and before["id"])], "id string, before string"))
        if before and before["before"]:
            for table in ("documents", "postings", "maxima"):
                self.current.files.remove(f"{self.folder}/{table}/{before['before']}")
        return self

    def _table(self, name: str, made: str | None = None) -> DataFrame:
        schema = {
            "documents": "doc_id bigint, kind string, block bigint, task bigint, entries array<struct<idx: bigint, impact: double>>",
            "postings": "block bigint, kind string, idx bigint, docs array<struct<impact: double, doc_id: bigint>>, most double, least double, part int",
            "maxima": "part int, block bigint, kind string, idx bigint, most double, least double",
        }[name]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{made or self.current.read().first()['id']}")

    def vector(self, doc_id: int) -> dict[int, float]:
        """The impacts of a document: at most the vocabulary."""
        row = self._table("documents").filter(F.col("doc_id") == doc_id).select("entries").first()
        return {e.idx: e.impact for e in row.entries} if row else {}

    def richest(self) -> tuple[int | None, str | None]:
        """The document with the most terms, and its kind."""
        row = self._table("documents").select("doc_id", "kind", F.size("entries").alias("n")).orderBy(F.desc("n"), "doc_id").first()
        return (row.doc_id, row.kind) if row else (None, None)

    def bounds(self, query: dict[int, float], kind: str | None = None) -> DataFrame:
        """part, block, bound: what no document of the block exceeds."""
        maxima = self._of(self._table("maxima"), query, kind)
        reach = F.when(F.col("q") > 0, F.col("q") * F.greatest(F.col("most"), F.lit(0.0))).otherwise(F.col("q") * F.least(F.col("least"), F.lit(0.0)))
        return maxima.groupBy("part", "block", "kind").agg(F.sum(reach).alias("bound"))

    def _of(self, rows: DataFrame, query: dict[int, float], kind: str | None) -> DataFrame:
        """The rows of a kind and of the query's terms, with the query's impact q."""
        terms = self.spark.createDataFrame(sorted(query.items()), "idx bigint, q double")
        rows = rows if kind is None else rows.filter(F.col("kind") == kind)
        return rows.join(F.broadcast(terms), "idx")

    def _scored(self, blocks: DataFrame, query: dict[int, float], kind: str | None) -> DataFrame:
        """doc_id, similarity of the documents of blocks (part, block)."""
        parts = [r.part for r in blocks.select("part").distinct().collect()]  # at most FOLDERS
        rows = self._table("postings").filter(F.col("part").isin(*parts)).join(blocks.select("part", "block").distinct(), ["part", "block"], "left_semi")
        dots = self._of(rows, query, kind).select(F.explode("docs").alias("d"), "q").groupBy(F.col("d.doc_id").alias("doc_id")).agg(F.sum(F.col("d.impact") * F.col("q")).alias("dot"))
        return dots.select("doc_id", F.round("dot", 6).alias("similarity"))

    def floor(self, query: dict[int, float], kind: str | None = None, least: float = 0.15, k: int = 10, without: int | None = None, first: int = FIRST) -> float:
        """The k-th best similarity of the blocks with the greatest bounds, or `least` if that is more."""
        best = self.bounds(query, kind).orderBy(F.desc("bound"), "block").limit(first)
        found = self._best(self._scored(best, query, kind), least, k, without).agg(F.count("*").alias("n"), F.min("similarity").alias("s")).first()
        return max(least, found.s) if found.n == k else least

    @staticmethod
    def _best(scored: DataFrame, least: float, k: int, without: int | None) -> DataFrame:
        own: Column = F.lit(True) if without is None else F.col("doc_id") != without
        return scored.filter((F.col("similarity") > least) & own).orderBy(F.desc("similarity"), "doc_id").limit(k)

    def search(self, query: dict[int, float], kind: str | None = None, least: float = 0.15, k: int = 10, without: int | None = None, first: int = FIRST) -> DataFrame:
        """doc_id, similarity: the k documents of a kind with the greatest cosine to a query of unit length, above
        `least`, but for one document."""
        floor = self.floor(query, kind, least, k, without, first)
        wanted = self.bounds(query, kind).filter(F.col("bound") >= floor - SLACK)
        return self._best(self._scored(wanted, query, kind), least, k, without)

    def similar(self, doc_id: int, kind: str | None = None, least: float = 0.15, k: int = 10) -> DataFrame:
        """The k documents of a kind like a document."""
        return self.search(self.vector(doc_id), kind, least, k, doc_id)

    def share(self, query: dict[int, float], **how) -> tuple[int, int]:
        """Blocks that a search scores, and all there are."""
        floor = self.floor(query, **how)
        return self.bounds(query, how.get("kind")).filter(F.col("bound") >= floor - SLACK).count(), self._table("maxima").select("block", "kind").distinct().count()


def unit(weights: dict[int, float]) -> dict[int, float]:
    """A query's weights over their norm."""
    norm = sum(w * w for w in weights.values()) ** 0.5
    return {i: w / norm for i, w in weights.items()} if norm else {}
