"""Version-control text as DataFrames: logs with numstat, diffs, and short status.

Log text is cut at its headers (a full hash and a bar at the start of a line), so each commit is one row before
anything else happens: no running numbers over lines, and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "[0-9a-fA-F]{40}"
#: Order of the fields between bars in a header; the subject may hold bars itself.
SUBJECT_LAST, SUBJECT_MIDDLE = "%H|%h|%an|%ae|%aI|%s", "%H|%h|%s|%an|%ae|%aI"


def commits(logs: DataFrame, text: str = "value", layout: str = SUBJECT_LAST) -> DataFrame:
    """repo columns and hash, short_hash, author, email, ts, subject, files (path, added, removed; binary: 0)."""
    keep = [c for c in logs.columns if c != text]
    blocks = logs.select(*keep, F.explode(F.split(text, rf"(?m)^(?={HASH}\|)")).alias("b")).filter(F.col("b").rlike(rf"^{HASH}\|"))
    head = F.split(F.col("b"), "\n")[0]
    if layout == SUBJECT_LAST:
        p = F.split(head, r"\|", 6)
        fields = {"hash": p[0], "short_hash": p[1], "author": p[2], "email": p[3], "at": p[4], "subject": p[5]}
        whole = F.size(p) == 6
    else:  # anchored at both ends, as only the subject may hold bars
        p = F.split(head, r"\|")
        n = F.size(p)
        fields = {"hash": F.get(p, 0), "short_hash": F.get(p, 1), "author": F.get(p, n - 3), "email": F.get(p, n - 2), "at": F.get(p, n - 1), "subject": F.array_join(F.slice(p, F.lit(3), F.greatest(n - 5, F.lit(0))), "|")}
        whole = n >= 6
    stat = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    lines = F.filter(F.split("b", "\n"), lambda x: F.regexp_replace(x, r"^(\d+|-)\s+(\d+|-)\s+", "$1\t$2\t").rlike(stat))
    number = lambda x, g: F.coalesce(F.regexp_extract(x, stat, g).try_cast("bigint"), F.lit(0).cast("bigint"))
    files = F.transform(
        F.transform(lines, lambda x: F.regexp_replace(x, r"^(\d+|-)\s+(\d+|-)\s+", "$1\t$2\t")),
        lambda x: F.struct(F.regexp_extract(x, stat, 3).alias("path"), number(x, 1).alias("added"), number(x, 2).alias("removed")),
    )
    out = blocks.filter(whole).select(*keep, *[c.alias(k) for k, c in fields.items()], files.alias("files"))
    return out.withColumn("ts", F.try_to_timestamp("at")).drop("at")


def changes(parsed: DataFrame) -> DataFrame:
    """commit, author, ts, path, added, removed: one row for each file of each commit, authors by e-mail."""
    return parsed.select(F.col("hash").alias("commit"), F.col("email").alias("author"), "ts", F.explode("files").alias("f")).select("commit", "author", "ts", "f.*")


def diff_summary(diffs: DataFrame, text: str = "diff", cut: int = 2000) -> DataFrame:
    """diffs with added, removed and hunks (each cut after so many characters)."""
    lines = F.split(text, "\n")
    count = lambda sign: F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3)))).cast("bigint")
    hunks = F.filter(F.split(text, r"(?m)^(?=@@.+@@)"), lambda h: F.startswith(h, F.lit("@@")))
    return diffs.withColumns({"added": count("+"), "removed": count("-"), "hunks": F.transform(hunks, lambda h: F.substring(h, 1, cut))})


def status(lines: DataFrame, line: str = "value") -> DataFrame:
    """path, old_path, status of short status lines."""
    code, rest = F.substring(line, 1, 2), F.trim(F.substring(line, 4, 1 << 20))
    kind = F.when(code.contains("A"), "added").when(code.contains("M"), "modified").when(code.contains("D"), "deleted").when(code.contains("R"), "renamed").when(code.contains("?"), "untracked").otherwise("unknown")
    moved = F.split(rest, " -> ")
    renamed = (kind == "renamed") & (F.size(moved) == 2)
    return lines.filter(F.length(line) > 3).select(F.when(renamed, F.get(moved, 1)).otherwise(rest).alias("path"), F.when(renamed, F.get(moved, 0)).alias("old_path"), kind.alias("status"))


def newest(parsed: DataFrame, most: int = 2000) -> DataFrame:
    """The newest commits, as many as a scan reads."""
    return parsed.orderBy(F.desc("ts"), "hash").limit(most)
