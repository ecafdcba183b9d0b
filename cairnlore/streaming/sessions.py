"""Session tracking: when to capture a session, as a batch and as a stateful stream.

Every call counts up since the last capture. Capture after `calls` of them; at a knowledge call after `knowledge` of
them; at a lifecycle call after `lifecycle` of them; the later rule overrides the earlier. A capture starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALLS, KNOWLEDGE, LIFECYCLE, ENDING = 25, 5, 3, 5
KNOWLEDGE_TOOLS, LIFECYCLE_TOOLS = ("add_decision", "add_warning"), ("start_feature", "archive_feature")
_OUT = "session string, seq bigint, tool string, reason string, calls bigint"


def advance(count: int, tool: str) -> tuple[int, str | None, int]:
    """The count after a call, the reason of a capture if there is one, and the calls it covers."""
    count += 1
    reason = "checkpoint" if count >= CALLS else None
    if tool in KNOWLEDGE_TOOLS and count >= KNOWLEDGE:
        reason = "knowledge_created"
    if tool in LIFECYCLE_TOOLS and count >= LIFECYCLE:
        reason = "lifecycle"
    return (0, reason, count) if reason else (count, None, count)


def captures(calls: DataFrame) -> DataFrame:
    """session, seq, tool, reason, calls from rows of session, seq, tool. Each task goes through its sorted rows once
    with one counter, so long sessions need no memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, count = None, 0
        for batch in batches:
            out = []
            for s, q, tool in zip(batch["session"], batch["seq"], batch["tool"]):
                session, count = s, count if s == session else 0
                count, reason, covered = advance(count, tool)
                if reason:
                    out.append((s, q, tool, reason, covered))
            yield pd.DataFrame(out, columns=["session", "seq", "tool", "reason", "calls"])

    rows = calls.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("bigint").alias("seq"), "tool")
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(run, _OUT)


def ends(calls: DataFrame) -> DataFrame:
    """session, seq, tool, reason, calls: what the end of a session captures, if ENDING or more calls came after the
    last capture."""
    rows = calls.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("bigint").alias("seq"), "tool")
    saved = captures(calls).groupBy("session").agg(F.max("seq").alias("saved"))
    rest = rows.join(saved, "session", "left").filter(F.col("saved").isNull() | (F.col("seq") > F.col("saved")))
    by = rest.groupBy("session").agg(F.max_by(F.struct("seq", "tool"), "seq").alias("last"), F.count("*").alias("calls"))
    return by.filter(F.col("calls") >= ENDING).select("session", "last.seq", "last.tool", F.lit("end").alias("reason"), "calls")


def capture_stream(calls: DataFrame) -> DataFrame:
    """The same over a stream, with the counter of each session as its state; calls of a batch are taken by seq."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for q, tool in zip(rows["seq"], rows["tool"]):
            count, reason, covered = advance(count, tool)
            if reason:
                out.append((key[0], int(q), tool, reason, covered))
        state.update((count,))
        yield pd.DataFrame(out, columns=["session", "seq", "tool", "reason", "calls"])

    rows = calls.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("bigint").alias("seq"), "tool")
    return rows.groupBy("session").applyInPandasWithState(step, _OUT, "n bigint", "append", "NoTimeout")


def session_summary(calls: DataFrame) -> DataFrame:
    """session, calls, tools, most_used: one row for each session."""
    by = calls.groupBy("session", "tool").agg(F.count("*").alias("n"))
    return by.groupBy("session").agg(F.sum("n").alias("calls"), F.count("*").alias("tools"), F.min_by("tool", F.struct(-F.col("n"), "tool")).alias("most_used"))


def activity_windows(events: DataFrame, size: str = "1 day", kind: str = "event_type") -> DataFrame:
    """start, kind, n per tumbling window. On a stream give events a watermark first."""
    return events.groupBy(F.window("ts", size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def gap_sessions(events: DataFrame, gap_seconds: int = 86400) -> DataFrame:
    """user_id, session, events, first, last: a pause longer than the gap starts a session."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    marked = events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(order)) > gap_seconds * 1_000_000, F.lit(True)).cast("bigint"))
    numbered = marked.withColumn("session", F.sum("new").over(order))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"), ((F.max("t") - F.min("t")) / 1_000_000).cast("bigint").alias("seconds"))
