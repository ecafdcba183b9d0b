"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket; where the running sum crosses a source's budget, only that bucket is
summed again by finer hash bits, level by level, until one hash value is left. The threshold found then filters
documents by comparing hashes: nothing is sorted, and a smaller budget always takes a subset of a larger one.

Targets: sources in code-point order (null last) have the weights 5, 2, 1, repeating, and share all words; a target
stops at 3 times its source's words and the excess is shared again by weight, until none is above. A target above
the source's words takes whole copies first, and the threshold selects the rest.

Defined results: a null text has size 0; a null source is a source of its own; documents of size 0 are counted in
their source and take 0 words; repeated rows (equal id and text) have equal hashes, and of those at a boundary as many
are taken as the target wants; a null id hashes as null does; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, quoted, row_of, small

#: Fixed values of the mix: weights by rank of the source, and the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: Hash bits in use, and bits of a histogram level.
BITS, LEVEL = 48, 12


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> with weight and target. One row per source comes in; the shares are a closed form:
    ordered by cap over weight, the first sources are capped and the rest share what is left by weight."""
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.pmod(F.col("k") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = sources.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w.cast("double"))
    by_ratio = W.orderBy(F.col("source_size") / F.col("weight"), "k")
    before, after, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (F.sum("source_size").over(everything) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    # A source is open if its own cap lies above the level at which all from it on would share; the first open one sets the level.
    found = ranked.withColumn("level", level).withColumn("open", MOST * F.col("source_size") / F.col("weight") >= F.col("level"))
    water = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "k", "level"))).over(everything)["level"]
    return found.withColumn("water", water).select("source", "source_size", "weight", F.least(F.col("water") * F.col("weight"), MOST * F.col("source_size").cast("double")).alias("target"))


def _hash(doc_id: str, text: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(quoted(doc_id)), F.col(quoted(text))), 64 - BITS)


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> tuple[DataFrame, DataFrame, int]:
    """The small columns of all documents (doc_id, source, h, size), one row for each source (source_size, target,
    whole copies, budget beyond these, and the hash below which a document is in it), and the number of sources."""
    base = cut_lineage(docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).alias("source"), _hash(doc_id, text, seed).alias("h"), words(F.col(quoted(text))).alias("size")))
    sources = cut_lineage(
        targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    n = sources.count()
    # For each source: the bucket path so far, and what of the budget is left at its start.
    edge = sources.select("source", F.lit(0).cast("bigint").alias("path"), F.col("budget").alias("left"))
    for level in range(BITS // LEVEL):
        shift = BITS - LEVEL * (level + 1)
        inside = base.alias("b").join(small(edge, n).alias("e"), F.col("b.source").eqNullSafe(F.col("e.source")) & (F.shiftrightunsigned("b.h", shift + LEVEL) == F.col("e.path")))
        sums = inside.groupBy(F.col("b.source").alias("source"), "e.left", F.shiftrightunsigned("b.h", shift).alias("path")).agg(F.sum("size").alias("size"))
        before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        crossed = sums.withColumn("before", before).filter(F.col("before") + F.col("size") > F.col("left"))
        edge = cut_lineage(crossed.groupBy("source").agg(F.min_by(F.struct("path", (F.col("left") - F.col("before")).alias("left")), "path").alias("m")).select("source", "m.*"))
    # The last bucket holds rows of one hash, the copies of one row: as many of them are taken as come nearest to the
    # budget. Sources whose budget was never crossed (the whole source fits) have no edge.
    last = base.alias("b").join(small(edge, n).alias("e"), F.col("b.source").eqNullSafe(F.col("e.source")) & (F.col("b.h") == F.col("e.path")))
    last = last.groupBy(F.col("e.source").alias("source"), "e.path", "e.left").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    thresholds = last.select("source", F.col("path").alias("below"), "rows", F.round(F.col("left") / F.col("size") * F.col("rows")).cast("bigint").alias("first"))
    found = sources.alias("s").join(small(thresholds, n).alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
    return base, cut_lineage(found.select("s.source", "source_size", "target", "whole", "budget", "below", "rows", "first")), n


#: Copies of one row that one task writes.
BLOCK = 1 << 16


def _with_copies(rows: DataFrame, columns: list[str], several: bool) -> DataFrame:
    """columns and copies (0 to 3) of rows that have met the plan of their source. several: whether at any boundary
    there is more than one row.

    Rows below the boundary hash are taken once more. Those at the boundary are copies of one row, nothing tells them
    apart: they are counted and written anew, `first` of them with one copy more.
    """
    whole, at = F.col("whole"), F.coalesce(F.col("h") == F.col("below"), F.lit(False)) & (F.col("budget") > 0)
    copies = lambda more: F.least(whole + more, F.lit(MOST)).cast("int").alias("copies")
    split = at & (F.col("rows") > 1)
    alone = F.when(F.col("budget") <= 0, 0).when(at, F.col("first")).otherwise((F.col("h") < F.coalesce(F.col("below"), F.lit(1 << BITS))).cast("int"))
    if not several:
        return rows.select(*columns, copies(alone))
    plain = rows.filter(~split).select(*columns, copies(alone))
    same = rows.filter(split).groupBy(*columns, "whole", "first", "rows").agg(F.count("*").alias("n"))
    blocks = same.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(BLOCK).cast("bigint")))).repartition("start")
    each = blocks.withColumn("i", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + BLOCK, F.col("n")) - 1)))
    # If different rows share the hash, each gets its part of the copies.
    return plain.unionByName(each.select(*columns, copies((F.col("i") < F.round(F.col("first") * F.col("n") / F.col("rows"))).cast("int"))))


def _several(by_source: DataFrame) -> bool:
    return not by_source.filter("rows > 1").isEmpty()


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """doc_id, source, h (hash), size, source_size, target, copies (0 to 3) of each document."""
    base, by_source, n = plan(docs, doc_id, source, text, seed)
    joined = base.join(small(by_source.withColumnRenamed("source", "p_source"), n), F.col("source").eqNullSafe(F.col("p_source")))
    return _with_copies(joined, ["doc_id", "source", "h", "size", "source_size", "target"], _several(by_source))


def take(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """The documents the mix takes, each as many times as it has copies, with their own columns only.

    A row meets the plan of its source and compares its own hash, so texts are not shuffled.
    """
    _, by_source, n = plan(docs, doc_id, source, text, seed)
    rows = docs.select(row_of(docs).alias("row"), _hash(doc_id, text, seed).alias("h"), F.col(quoted(source)).alias("src"))
    found = _with_copies(rows.join(small(by_source, n), F.col("src").eqNullSafe(F.col("source"))), ["row"], _several(by_source)).filter("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
