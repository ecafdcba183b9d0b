"""Which strings lie inside which others, by the rarest piece of the contained one.

Every string enters under one of its pieces of `GRAM` letters only: the one that the fewest of the others have. A
string whose letters all of them share at the front, as paths do, is found by what tells it apart. Strings with a piece
that none of the others has are out at once; what meets is compared as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a piece.
GRAM = 3


def _pieces(text: Column, n: int) -> Column:
    """All pieces of n letters, each once; none if the text is shorter."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _held(longs: DataFrame, sizes: list[int]) -> DataFrame:
    return longs.select("long", F.explode(F.concat(*[_pieces(F.col("long"), n) for n in sizes])).alias("piece"))


def candidates(longs: DataFrame, shorts: DataFrame) -> DataFrame:
    """long, short: pairs of which the long one has the short one's rarest piece."""
    # Lengths below GRAM are their own pieces; there are at most GRAM - 1 of them.
    sizes = [r[0] for r in shorts.select(F.length("short").alias("n")).filter(F.col("n").between(1, GRAM - 1)).distinct().collect()]
    held = _held(longs, [GRAM, *sizes])
    own = F.when(F.length("short") >= GRAM, _pieces(F.col("short"), GRAM)).otherwise(F.array("short"))
    asked = shorts.filter("short <> ''").select("short", F.explode(own).alias("piece"))
    counts = held.join(asked.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "piece", "left").groupBy("short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("m"))
    return held.join(rarest.filter("m.n > 0").select("short", "m.piece"), "piece").select("long", "short")


def contained(longs: DataFrame, shorts: DataFrame) -> DataFrame:
    """long, short: all pairs of which the long string (column long) holds the short one (column short), case kept.
    Both tables have each string once; null and empty strings are in no pair."""
    return candidates(longs, shorts).filter(F.contains("long", F.col("short")))
