"""Answers put together from several operators: search over all kinds, context for a task, onboarding, merges."""

from __future__ import annotations

from functools import reduce

from cairnlore.functions.columns import basename, contains_any
from cairnlore.operators.knowledge import latest
from cairnlore.operators.text import matches, search_form
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def top_of_each(df: DataFrame, group: str, order: list[Column], limits: dict[str, int]) -> DataFrame:
    """The first rows of each group, as many as its limit says; groups without one are left out.

    Each group takes its first rows by a limit of its own, so its rows are never sorted in one task; ranks are given to
    what the limits leave."""
    tops = [df.filter(F.col(group) == g).orderBy(*order).limit(n) for g, n in limits.items()]
    return union_all(tops).withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def search(kinds: dict[str, DataFrame], query: str, limits: dict[str, int]) -> DataFrame:
    """kind, rank, id, title of full-text hits in records of id, title, text, ts; the newest first."""
    hits = union_all([df.filter(matches(search_form(F.col("text")), query)).select(F.lit(k).alias("kind"), F.col("id").cast("string").alias("id"), "title", "ts") for k, df in kinds.items()])
    return top_of_each(hits, "kind", [F.desc("ts"), F.col("id")], limits).select("kind", "rank", "id", "title")


def ask(kinds: dict[str, DataFrame], question: str, limits: dict[str, int]) -> DataFrame:
    """The same by single words of a question, each as part of the text."""
    hits = union_all([df.filter(contains_any(F.col("text"), F.lit(question))).select(F.lit(k).alias("kind"), F.col("id").cast("string").alias("id"), "title", "ts") for k, df in kinds.items()])
    return top_of_each(hits, "kind", [F.desc("ts"), F.col("id")], limits).select("kind", "rank", "id", "title")


def context_scores(records: DataFrame, files: list[str], intent: str, near: DataFrame, inherited: list[str]) -> DataFrame:
    """id, score, why: the best reason for each record (id, feature, text, related_files, critical) to matter.

    A file in common counts 1.0, a word of the intent 0.5 (a critical record 0.5 more), a link in the graph (ids in
    near) 0.7, a feature that is inherited from 0.6.
    """
    common = F.arrays_overlap(F.coalesce("related_files", F.array().cast("array<string>")), F.array(*[F.lit(f) for f in files]) if files else F.array().cast("array<string>"))
    word = contains_any(F.coalesce("text", F.lit("")), F.lit(intent))
    linked = records.join(near.select(F.col("id").alias("near_id")).distinct(), F.col("id") == F.col("near_id"), "left")
    why = F.array_compact(
        F.array(
            F.when(common, F.struct(F.lit(1.0).alias("score"), F.lit("file").alias("why"))),
            F.when(word, F.struct((F.lit(0.5) + F.when(F.col("critical"), 0.5).otherwise(0.0)).alias("score"), F.lit("word").alias("why"))),
            F.when(F.col("near_id").isNotNull(), F.struct(F.lit(0.7).alias("score"), F.lit("graph").alias("why"))),
            F.when(F.col("feature").isin(inherited), F.struct(F.lit(0.6).alias("score"), F.lit("ancestor").alias("why"))),
        )
    )
    return linked.select("id", F.array_max(why).alias("b")).filter("b IS NOT NULL").select("id", "b.score", "b.why")


def onboarding(sections: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """section, rank, text: each section's rows (seq, text) in stored order, up to its cap."""
    rows = union_all([df.select(F.lit(k).alias("section"), F.col("seq"), "text") for k, (df, _) in sections.items()])
    return top_of_each(rows, "section", [F.col("seq"), F.col("text")], {k: n for k, (_, n) in sections.items()}).select("section", "rank", "text")


def page(df: DataFrame, order: list[Column], limit: int, most: int) -> DataFrame:
    """The first rows with the total before the cut, and whether anything was cut."""
    n = min(limit, most)
    total = df.agg(F.count("*").alias("total_count"))  # one row
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_count") > n)


def expert_areas(authors: DataFrame, least: float = 0.1, areas: int = 5) -> DataFrame:
    """author, n_areas, areas (at most five by name) of active authors with enough of a folder."""
    good = authors.filter(F.col("active") & (F.col("ownership") > least)).withColumn("r", F.row_number().over(W.partitionBy("author").orderBy("dir")))
    return good.groupBy("author").agg(F.count("*").alias("n_areas"), F.array_sort(F.collect_list(F.when(F.col("r") <= areas, F.col("dir")))).alias("areas"))


def naming_vote(folders: DataFrame, column: str) -> DataFrame:
    """How many names are plural (end in one s) and singular, and which wins."""
    plural = F.endswith(F.col(column), F.lit("s")) & ~F.endswith(F.col(column), F.lit("ss"))
    return folders.agg(F.sum(plural.cast("bigint")).alias("plural"), F.sum((~plural).cast("bigint")).alias("singular")).withColumn("style", F.when(F.col("plural") > F.col("singular"), "plural").otherwise("singular"))


def named(paths: DataFrame, needle: str, path: str = "path") -> DataFrame:
    """Paths that match a name: with a slash as a part of the path, else by base name, case aside."""
    base = F.lower(basename(F.col(path)))
    return paths.filter(F.contains(path, F.lit(needle)) if "/" in needle else F.contains(base, F.lit(needle.lower())))


def inherit(features: DataFrame) -> DataFrame:
    """id, files, from own and parent's relevant_files, each once (features: id, extends, relevant_files)."""
    parents = features.select(F.col("id").alias("pid"), F.col("relevant_files").alias("inherited"))
    empty = F.array().cast("array<string>")
    return features.join(parents, F.col("extends") == F.col("pid"), "left").select("id", F.array_sort(F.array_distinct(F.concat(F.coalesce("relevant_files", empty), F.coalesce("inherited", empty)))).alias("files"))


def merge(ours: DataFrame, theirs: DataFrame, key: str, ts: str) -> DataFrame:
    """The union of two collections, the newer record of each key; theirs where both are of one time."""
    both = ours.withColumn("__side", F.lit(0)).unionByName(theirs.withColumn("__side", F.lit(1)))
    return latest(both, [key], [F.desc(ts), F.desc("__side")]).drop("__side")


def first_source(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of sources by key, the first source wins."""
    ranked = union_all([s.withColumn("__prio", F.lit(i)) for i, s in enumerate(sources)])
    return latest(ranked, key, [F.col("__prio")]).drop("__prio")


def block_ends(files: DataFrame, starts: DataFrame, most: int = 50) -> DataFrame:
    """path, start, end of brace blocks: from a start line (path, line) to where braces balance again after the first
    one, else over `most` lines."""
    joined = starts.join(files.select("path", F.split("content", "\n").alias("ls")), "path")

    def step(acc, line):
        opened, closed = F.length(line) - F.length(F.replace(line, F.lit("{"), F.lit(""))), F.length(line) - F.length(F.replace(line, F.lit("}"), F.lit("")))
        depth = acc.depth + opened - closed
        started = acc.started | (opened > 0)
        done = acc.done | (started & (depth <= 0))
        return F.struct(depth.alias("depth"), started.alias("started"), done.alias("done"), (acc.n + F.when(acc.done, 0).otherwise(1)).alias("n"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("started"), F.lit(False).alias("done"), F.lit(0).alias("n"))
    n = F.aggregate(F.slice("ls", F.col("line").cast("int"), F.lit(most)), zero, step)["n"]
    return joined.select("path", F.col("line").cast("bigint").alias("start"), (F.col("line") + n - 1).cast("bigint").alias("end"))


def frameworks(manifests: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """path, framework: the first of the ordered (text, name) pairs that a manifest's content holds."""
    found = F.lit(None).cast("string")
    for needle, name in reversed(names):
        found = F.when(F.contains("content", F.lit(needle)), F.lit(name)).otherwise(found)
    return manifests.select("path", found.alias("framework")).filter("framework IS NOT NULL")


def rules_text(project: str, decisions: DataFrame, warnings: DataFrame, most: tuple[int, int] = (30, 20)) -> DataFrame:
    """One row with the rules of a project: its active decisions and first warnings (seq, content, status)."""
    active = decisions.filter(F.coalesce("status", F.lit("")).isin("", "active")).orderBy("seq").limit(most[0])
    listed = lambda df: df.agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("x")).select(F.array_join(F.transform("x", lambda r: F.concat(F.lit("- "), r.content)), "\n").alias("t"))
    a, b = listed(active).withColumnRenamed("t", "a"), listed(warnings.orderBy("seq").limit(most[1])).withColumnRenamed("t", "b")
    return a.crossJoin(b).select(F.concat(F.lit(f"# {project}\n\n## Decisions\n"), "a", F.lit("\n\n## Warnings\n"), "b").alias("text"))


def file_summary(skeletons: DataFrame) -> DataFrame:
    """path, summary from rows of skeletons: classes by name (three, then how many more), else functions, else counts."""
    names = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("line", "name")))), lambda s: s["name"])
    by = skeletons.groupBy("path").agg(names("class").alias("classes"), names("interface").alias("interfaces"), names("function").alias("functions"), F.count("*").alias("n"))

    def told(word, c):
        some = F.array_join(F.slice(c, 1, 3), ", ")
        return F.concat(F.size(c).cast("string"), F.lit(f" {word}(s): "), some, F.when(F.size(c) > 3, F.concat(F.lit(" (+"), (F.size(c) - 3).cast("string"), F.lit(" more)"))).otherwise(""))

    summary = F.when(F.size("classes") > 0, told("class", F.col("classes"))).when(F.size("interfaces") > 0, told("interface", F.col("interfaces"))).when(F.size("functions") > 0, told("function", F.col("functions"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" declarations")))
    return by.select("path", summary.alias("summary"))


def rendered(skeletons: DataFrame) -> DataFrame:
    """path, text: the skeleton of a file as text, members indented below their types."""
    line = F.concat(F.when(F.col("container") != "", F.lit("  ")).otherwise(""), F.col("signature"))
    by = skeletons.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", line.alias("text")))).alias("x"))
    return by.select("path", F.array_join(F.transform("x", lambda r: r.text), "\n").alias("text"))
