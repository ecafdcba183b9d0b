"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(path: Column) -> Column:
    """The folder of a path; '.' at the root."""
    d = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(".")).otherwise(d)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ratio(a: Column, b: Column) -> Column:
    """a / b rounded to six places, so that results compare across engines."""
    return F.round(a.cast("double") / b.cast("double"), 6)


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def last_activity(ts: Column, as_of: Column) -> Column:
    """How long ago, in words."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400)
    return (
        F.when(days <= 7, F.lit("Within the last week"))
        .when(days <= 30, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days <= 365, F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago")))
        .otherwise(F.lit("Over a year ago"))
    )


def age_label(ts: Column, as_of: Column) -> Column:
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    of = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, F.lit("just now")).when(s < 3600, of(60, "m")).when(s < 86400, of(3600, "h")).when(s < 172800, F.lit("yesterday")).otherwise(of(86400, "d"))


def contains_any(text: Column, query: Column) -> Column:
    """Whether any blank-separated word of the query is part of the text, case aside; an empty query is in none."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    return F.exists(words, lambda w: F.contains(F.lower(text), w))
