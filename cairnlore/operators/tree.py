"""A project's tree as text lines, made by relational steps: one row a line, in the order of the tree.

Every file counts for each of its folders, so a folder's totals are one aggregation of (folder, file) pairs whatever
its depth. Folders with a single folder in them and nothing else are one line with it; generated and hidden folders are
a line with a count; so are more than `MOST_FILES` files. Lines are numbered by prefix sums: a line stands behind the
lines of its folders' earlier siblings, which are added up among siblings only. No step sorts all lines.
"""

from __future__ import annotations

from functools import reduce

from cairnlore.functions.lineage import cut_lineage
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders that are counted only, and the most files of a folder that are listed.
GENERATED, MOST_FILES = ["gen", "codegen", "generated", "build", "dist", "node_modules"], 12


def _steps(p: Column) -> Column:
    """The proper prefixes of an array, from the empty one on."""
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.slice(p, F.lit(1), i))


def _parent(p: Column) -> Column:
    """All but the last part."""
    return F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))


def tree_lines(files: DataFrame, path: str = "path") -> DataFrame:
    """number (from 1), indent, label, folder, kind (folder, collapsed, file, files) of each line.

    Folders come before files, both by name (by bytes). label is what the line says without its blanks; folder is the
    folder that the line opens, or lies in. Paths are cut at `/`, empty parts left out; repeated paths are one file.
    """
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    each = files.select(parts.alias("p")).filter("size(p) > 0").distinct()
    held = each.select(_parent(F.col("p")).alias("dir"), F.element_at("p", -1).alias("name"))
    direct = held.groupBy("dir").agg(F.count("*").alias("n"))
    whole = direct.select(F.explode(F.concat(F.when(F.size("dir") > 0, _steps(F.col("dir"))).otherwise(F.array().cast("array<array<string>>")), F.array("dir"))).alias("dir"), "n").groupBy("dir").agg(F.sum("n").alias("below"))
    folders = whole.join(direct, "dir", "left").select("dir", "below", F.coalesce("n", F.lit(0)).alias("n"))
    inside = folders.filter("size(dir) > 0").select(_parent(F.col("dir")).alias("dir")).groupBy("dir").agg(F.count("*").alias("dirs"))
    folders = cut_lineage(folders.join(inside, "dir", "left").withColumn("merged", (F.coalesce("dirs", F.lit(0)) == 1) & (F.col("n") == 0)))
    # A folder that a written folder holds may be counted only; one that its parent is merged with may not.
    above = folders.select(F.col("dir").alias("up"), F.col("merged").alias("up_merged"))
    last = F.element_at("dir", -1)
    why = F.when(F.lower(last).isin(GENERATED), "generated").when(F.startswith(last, F.lit(".")) & ~last.isin(".", ".."), "hidden")
    rest = folders.filter("size(dir) > 0").withColumn("up", _parent(F.col("dir"))).join(above, "up").withColumn("why", F.when(~F.col("up_merged"), why))
    root = folders.filter("size(dir) = 0").select("dir", "below", "n", "merged", F.lit(None).cast("string").alias("why"))
    known = rest.select("dir", "below", "n", "merged", "why").unionByName(root)
    # What each folder's folders say: how many are written with a name, how deep the last written one is, whether one is collapsed.
    ups = known.filter("size(dir) > 0").select("dir", F.explode(_steps(F.col("dir"))).alias("up"))
    said = known.select(F.col("dir").alias("up"), (~F.col("merged")).alias("written"), F.col("why").isNotNull().alias("shut"))
    seen = ups.join(said, "up").groupBy("dir").agg(
        F.count_if(F.col("written") & (F.size("up") > 0)).cast("int").alias("named"), F.coalesce(F.max(F.when(F.col("written"), F.size("up"))), F.lit(0)).alias("from"), F.max("shut").alias("gone")
    )
    open_ = known.join(seen, "dir", "left").filter(~F.coalesce("gone", F.lit(False))).select("dir", "below", "n", "merged", "why", F.coalesce("named", F.lit(0)).alias("named"), F.coalesce("from", F.lit(0)).alias("from"))
    key = lambda p: F.transform(p, lambda x: F.concat(F.lit("0"), x))  # noqa: E731  folders before files
    shown = open_.filter("size(dir) > 0 AND (why IS NOT NULL OR NOT merged)")
    name = F.array_join(F.slice("dir", F.col("from") + 1, F.size("dir")), "/")
    label = F.when(F.col("why").isNotNull(), F.concat(F.element_at("dir", -1), F.lit(": ["), F.col("below").cast("string"), F.lit(" "), "why", F.lit(" files]"))).otherwise(F.concat(name, F.lit(":")))
    lines = [shown.select(key(F.col("dir")).alias("key"), (F.col("named") + 1).alias("indent"), label.alias("label"), F.col("dir").alias("folder"), F.when(F.col("why").isNotNull(), "collapsed").otherwise("folder").alias("kind"))]
    holders = open_.filter("why IS NULL AND n > 0").select("dir", "n", (F.col("named") + (F.size("dir") > 0).cast("int") + 1).alias("indent"))
    many = holders.filter(F.col("n") > MOST_FILES)
    lines.append(many.select(F.concat(key(F.col("dir")), F.array(F.lit("1"))).alias("key"), "indent", F.concat(F.lit("- ["), F.col("n").cast("string"), F.lit(" files...]")).alias("label"), F.col("dir").alias("folder"), F.lit("files").alias("kind")))
    few = holders.filter(F.col("n") <= MOST_FILES).join(held, "dir")
    lines.append(few.select(F.concat(key(F.col("dir")), F.array(F.concat(F.lit("1"), "name"))).alias("key"), "indent", F.concat(F.lit("- "), "name").alias("label"), F.col("dir").alias("folder"), F.lit("file").alias("kind")))
    return _numbered(cut_lineage(reduce(lambda a, b: a.unionByName(b), lines))).select("number", "indent", "label", F.array_join("folder", "/").alias("folder"), "kind")


def _numbered(lines: DataFrame) -> DataFrame:
    """number: the place of each line (key: its path) in depth-first order."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("key")), lambda i: F.slice("key", F.lit(1), i))
    nodes = lines.select("key", F.explode(prefixes).alias("node"))
    sizes = nodes.groupBy("node").agg(F.count("*").alias("lines"), F.max((F.col("key") == F.col("node")).cast("bigint")).alias("own"))
    earlier = F.coalesce(F.sum("lines").over(W.partitionBy(_parent(F.col("node"))).orderBy(F.element_at("node", -1)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("node", earlier.alias("earlier"), "own")
    # Before a line: at each level the lines of earlier siblings, and its folders' own lines.
    found = nodes.join(before, "node").groupBy("key").agg((F.sum("earlier") + F.sum(F.when(F.col("key") != F.col("node"), F.col("own")).otherwise(0)) + 1).alias("number"))
    return lines.join(found, "key")


def tree_view(lines: DataFrame, folder: str = "", depth: int | None = None) -> DataFrame:
    """number, text: the lines of a folder and below, down to `depth` levels (2 for the whole tree, else all). Folders
    at the first level that is left out are kept as `name: [...]`."""
    folder = folder.strip("/")
    levels = depth if depth is not None else (None if folder else 2)
    inside = lines
    if folder:
        inside = lines.filter((F.col("folder") == folder) | F.startswith("folder", F.lit(folder + "/")))
    start = inside.filter((F.col("folder") == folder) & F.col("kind").isin("folder", "collapsed")).agg(F.max("indent").alias("at"))  # one row
    seen = inside.crossJoin(F.broadcast(start)).withColumn("level", F.col("indent") - F.coalesce("at", F.lit(0)))
    text = F.concat(F.repeat(F.lit("  "), F.col("indent")), "label")
    if levels is None:
        return seen.select("number", text.alias("text"))
    shown = seen.filter((F.col("level") < levels) | ((F.col("level") == levels) & (F.col("kind") == "folder")))
    return shown.select("number", F.when(F.col("level") == levels, F.concat(text, F.lit(" [...]"))).otherwise(text).alias("text"))
