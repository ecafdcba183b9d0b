"""Commit-log analytics over rows of commit, author, ts, path, added, removed.

Every share is rounded to six places and every order is total, with ties by name. Aggregations combine before their
shuffle; a commit's files are paired within the commit only, and commits of too many files are left out first, which
bounds the pairs of each.
"""

from __future__ import annotations

from cairnlore.functions.columns import dirname, last_activity, ratio
from cairnlore.functions.lineage import staged
from cairnlore.sources.versions import VersionedTable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _now(as_of: str):
    return F.to_timestamp(F.lit(as_of))


def _cutoff(as_of: str, months: int = 3):
    """Start of the active time. Months are clamped to their last day."""
    return F.add_months(_now(as_of), -months).cast("timestamp")


def contributors(changes: DataFrame, as_of: str) -> DataFrame:
    """author, commits, added, removed, last_commit, active."""
    out = changes.groupBy("author").agg(F.countDistinct("commit").alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max("ts").alias("last_commit"))
    return out.withColumn("active", F.col("last_commit") > _cutoff(as_of))


def file_activity(changes: DataFrame, k: int = 20) -> DataFrame:
    """The k most touched paths."""
    return changes.groupBy("path").agg(F.count("*").alias("touches")).orderBy(F.desc("touches"), "path").limit(k)


def repo_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit"))


def directory_authors(changes: DataFrame, as_of: str) -> DataFrame:
    """dir, author, touches, last_commit, active, total, ownership of every author of every folder."""
    own = changes.groupBy(dirname(F.col("path")).alias("dir"), "author").agg(F.count("*").alias("touches"), F.max("ts").alias("last_commit"))
    own = own.withColumn("total", F.sum("touches").over(W.partitionBy("dir"))).withColumn("ownership", ratio(F.col("touches"), F.col("total")))
    return own.withColumn("active", F.col("last_commit") > _cutoff(as_of))


def directory_experts(changes: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    """The k authors of each folder with the largest shares of its touches."""
    files = changes.groupBy(dirname(F.col("path")).alias("dir")).agg(F.countDistinct("path").alias("file_count"))
    ranked = directory_authors(changes, as_of).withColumn("rank", F.row_number().over(W.partitionBy("dir").orderBy(F.desc("touches"), "author")))
    return ranked.filter(F.col("rank") <= k).join(files, "dir").select("dir", "rank", "author", "touches", "total", "ownership", "active", "file_count")


def knowledge_risk(changes: DataFrame, as_of: str, sole: float = 0.8, few: int = 3, least_files: int = 2) -> DataFrame:
    """dir, level, top_author, ownership, contributors, last_activity of folders at risk (level above LOW).

    The top author counts as active if active in the folder or anywhere.
    """
    anywhere = changes.groupBy("author").agg((F.max("ts") > _cutoff(as_of)).alias("anywhere"))
    files = changes.groupBy(dirname(F.col("path")).alias("dir")).agg(F.countDistinct("path").alias("files")).filter(F.col("files") >= least_files)
    by = directory_authors(changes, as_of).groupBy("dir").agg(
        F.min_by(F.struct("author", "ownership", "active", "last_commit"), F.struct(-F.col("touches"), "author")).alias("top"), F.count("*").alias("contributors")
    )
    top = by.select("dir", "contributors", "top.*").join(files, "dir").join(anywhere, "author", "left")
    active = F.col("active") | F.coalesce("anywhere", F.lit(False))
    level = (
        F.when((F.col("ownership") > sole) & ~active, "CRITICAL")
        .when(F.col("ownership") > sole, "MEDIUM")
        .when(~active & (F.col("contributors") < few), "HIGH")
        .otherwise("LOW")
    )
    out = top.withColumn("level", level).filter("level <> 'LOW'")
    return out.select("dir", "level", F.col("author").alias("top_author"), "ownership", "contributors", last_activity(F.col("last_commit"), _now(as_of)).alias("last_activity"))


def risk_counts(risks: DataFrame) -> DataFrame:
    return risks.groupBy("level").agg(F.count("*").alias("dirs"))


def _correlated(pairs: DataFrame, sizes: DataFrame, least_share: float) -> DataFrame:
    """Pairs (path_a, path_b, together) with their share of the rarer path's commits (sizes: path, n)."""
    pairs = pairs.join(sizes.select(F.col("path").alias("path_a"), F.col("n").alias("na")), "path_a").join(sizes.select(F.col("path").alias("path_b"), F.col("n").alias("nb")), "path_b")
    out = pairs.withColumn("share", ratio(F.col("together"), F.least("na", "nb"))).filter(F.col("share") >= least_share)
    out = out.select("path_a", "path_b", "together", "share", F.when(F.col("together") > 15, "high").when(F.col("together") > 8, "medium").otherwise("low").alias("confidence"))
    return out


def cochange(changes: DataFrame, most_files: int = 30, least_together: int = 9, least_share: float = 0.5, k: int | None = 50) -> DataFrame:
    """path_a < path_b, together, share, confidence of files that change together.

    share: commits of both over the commits of the rarer one. Commits of more than most_files files are left out, and
    before any are paired, files of fewer than least_together of the others: no pair of theirs can be enough.
    """
    touched = changes.select("commit", "path").distinct()
    usable = touched.groupBy("commit").agg(F.count("*").alias("files")).filter(F.col("files") <= most_files)
    kept = touched.join(usable, "commit", "left_semi")
    sizes = kept.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") >= least_together)
    kept = kept.join(sizes.select("path"), "path", "left_semi")
    a, b = kept.select("commit", F.col("path").alias("path_a")), kept.select("commit", F.col("path").alias("path_b"))
    pairs = a.join(b, "commit").filter("path_a < path_b").groupBy("path_a", "path_b").agg(F.count("*").alias("together")).filter(F.col("together") >= least_together)
    out = _correlated(pairs, sizes, least_share)
    return out.orderBy(F.desc("share"), F.desc("together"), "path_a", "path_b").limit(k) if k else out


def file_correlations(changes: DataFrame, path: str, least: float = 0.3, k: int = 10) -> DataFrame:
    """Files that change with one file: shares of its commits."""
    touched = changes.select("commit", "path").distinct()
    own = touched.filter(F.col("path") == path).select("commit")
    others = touched.join(own, "commit", "left_semi").groupBy("path").agg(F.count("*").alias("together"))
    out = others.filter(F.col("path") != path).crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))  # one row
    out = out.withColumn("share", ratio(F.col("together"), F.col("total"))).filter(F.col("share") >= least)
    out = out.withColumn("confidence", F.when(F.col("together") > 10, "high").when(F.col("together") > 3, "medium").otherwise("low"))
    return out.select("path", "together", "share", "confidence").orderBy(F.desc("share"), "path").limit(k)


def file_expertise(changes: DataFrame, as_of: str) -> DataFrame:
    """path, author, commits, added, removed, ownership, active, and of the path: total_commits, total_lines, churn."""
    own = changes.groupBy("path", "author").agg(F.countDistinct("commit").alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return expertise_of(own, as_of)


def expertise_of(own: DataFrame, as_of: str) -> DataFrame:
    """The same from commits, added, removed, first_ts and last_ts of each path and author."""
    all_ = W.partitionBy("path")
    own = own.withColumn("total_commits", F.sum("commits").over(all_)).withColumn("total_lines", F.sum("added").over(all_))
    churn = F.when(F.col("total_commits") > 20, "high").when(F.col("total_commits") > 5, "medium").otherwise("low")
    return own.select("path", "author", "commits", "added", "removed", ratio(F.col("commits"), F.col("total_commits")).alias("ownership"), (F.col("last_ts") > _cutoff(as_of)).alias("active"), "total_commits", "total_lines", churn.alias("churn"))


def find_experts(changes: DataFrame, as_of: str, area: str, k: int = 5) -> DataFrame:
    """The k authors with the largest mean ownership over the files under an area."""
    inside = file_expertise(changes.filter(F.startswith(F.lower("path"), F.lower(F.lit(area)))), as_of)
    n = inside.select(F.countDistinct("path").alias("n"))  # one row
    by = inside.groupBy("author").agg(F.sum("ownership").alias("sum"), F.sum("commits").alias("commits"), F.count("*").alias("files_touched"), F.max("active").alias("active"))
    by = by.crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("sum") / F.col("n"), 6))
    return by.select("author", "score", "commits", "files_touched", "active").orderBy(F.desc("score"), "author").limit(k)


def commit_impact(changes: DataFrame) -> DataFrame:
    """commit, lines, files, impact."""
    by = changes.groupBy("commit").agg(F.sum(F.col("added") + F.col("removed")).alias("lines"), F.countDistinct("path").alias("files"))
    high, medium = (F.col("lines") > 500) | (F.col("files") > 20), (F.col("lines") > 100) | (F.col("files") > 5)
    return by.withColumn("impact", F.when(high, "high").when(medium, "medium").otherwise("low"))


def change_rollup(changes: DataFrame, since: str) -> DataFrame:
    """Totals of the changes since a time."""
    return changes.filter(F.col("ts") >= F.to_timestamp(F.lit(since))).agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.countDistinct("path").alias("files"), F.countDistinct("commit").alias("commits"))


def recent_changes(changes: DataFrame, since: str, k: int = 20) -> DataFrame:
    by = changes.filter(F.col("ts") >= F.to_timestamp(F.lit(since))).groupBy("commit", "author", "ts").agg(F.count("*").alias("changes"))
    return by.orderBy(F.desc("ts"), F.desc("commit")).limit(k)


def commit_context(changes: DataFrame, k: int = 10) -> DataFrame:
    """Of each path's newest k commits: how many, by how many authors, over what span."""
    touched = changes.select("path", "commit", "author", "ts").distinct()
    newest = touched.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("ts"), F.desc("commit")))).filter(F.col("r") <= k)
    by = newest.groupBy("path").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = F.floor((F.unix_timestamp("b") - F.unix_timestamp("a")) / 86400)
    span = (
        F.when(days > 365, F.concat(F.floor(days / 365).cast("string"), F.lit(" years")))
        .when(days > 30, F.concat(F.floor(days / 30).cast("string"), F.lit(" months")))
        .when(days > 0, F.concat(days.cast("string"), F.lit(" days")))
        .otherwise("same day")
    )
    return by.select("path", "commits", "authors", span.alias("span"))


def linked_activity(own: DataFrame, linked: list[tuple[str, DataFrame]], as_of: str) -> DataFrame:
    """Contributors, with those who are active only in a linked repository marked active there (the first in order)."""
    others = None
    for i, (name, changes) in enumerate(linked):
        one = contributors(changes, as_of).filter("active").select("author", F.lit(i).alias("i"), F.lit(name).alias("repo"))
        others = one if others is None else others.unionByName(one)
    first = others.groupBy("author").agg(F.min_by("repo", "i").alias("repo"))
    mine = contributors(own, as_of).join(first, "author", "left")
    via = F.when(~F.col("active"), F.col("repo"))
    return mine.select("author", "commits", (F.col("active") | via.isNotNull()).alias("active"), F.coalesce(via, F.lit("")).alias("active_in"))


class ActivityTables:
    """Shares of files and pairs of files, kept up by batches of new commits: what is stored adds up, so a batch is
    aggregated alone and becomes a part of the tables. A commit's changes come in one batch."""

    OWN = {"commits": F.sum, "added": F.sum, "removed": F.sum, "first_ts": F.min, "last_ts": F.max}

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, most_files: int = 30):
        self.own = VersionedTable(spark, f"{folder}/own", ["path", "author"], buckets)
        self.files = VersionedTable(spark, f"{folder}/files", ["path"], buckets)
        self.pairs = VersionedTable(spark, f"{folder}/pairs", ["path_a", "path_b"], buckets)
        self.most_files = most_files

    def add(self, changes: DataFrame, stream: str, batch: int) -> None:
        """A batch of changes; one that is in the tables already changes nothing."""
        if all(t.has(stream, batch) for t in (self.own, self.files, self.pairs)):
            return
        with staged(changes) as log:
            touched = log.groupBy("commit", "path", "author").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            self.own.merge(touched.withColumn("commits", F.when(F.col("commit").isNull(), 0).otherwise(1).cast("bigint")), self.OWN, stream, batch)
            with staged(self._usable(log)) as usable:
                one = F.lit(1).cast("bigint")
                self.files.merge(usable.select(F.explode("paths").alias("path"), one.alias("n")), {"n": F.sum}, stream, batch)
                a = usable.select("paths", F.posexplode("paths").alias("i", "path_a"))
                later = F.slice("paths", F.col("i") + 2, F.size("paths"))
                self.pairs.merge(a.select("path_a", F.explode(later).alias("path_b"), one.alias("together")), {"together": F.sum}, stream, batch)

    def _usable(self, log: DataFrame) -> DataFrame:
        """paths: the sorted files of each commit of at most most_files. A commit of more gives no more than one file
        too many, so that none is gathered whole."""
        ranked = log.filter("commit IS NOT NULL").select("commit", "path").withColumn("file", F.dense_rank().over(W.partitionBy("commit").orderBy("path")))
        few = ranked.filter(F.col("file") <= self.most_files + 1).groupBy("commit").agg(F.max("file").alias("files"), F.array_sort(F.collect_set("path")).alias("paths"))
        return few.filter(F.col("files") <= self.most_files).select("paths")

    def expertise(self, as_of: str) -> DataFrame:
        """As file_expertise of all changes."""
        return expertise_of(self.own.read(dealt_by=["path"]), as_of)

    def cochange(self, least_together: int = 9, least_share: float = 0.5) -> DataFrame:
        """As cochange of all changes, without its limit."""
        return _correlated(self.pairs.read().filter(F.col("together") >= least_together), self.files.read(), least_share)
