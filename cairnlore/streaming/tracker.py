"""What a session did: calls, first tools, files, active feature and items made, in a batch and kept up by a stream.

Calls are rows of session, seq, ts, tool, args (JSON text), result_id. A track is rows of session, began, ended, kind, pos,
value, so that no session has to fit in one row:

- `session`: pos is the number of calls, value the feature named last (empty if none);
- `tool`: the first TOOLS calls by time and seq, pos is the call's seq;
- `file`: each file once, pos is 0;
- `made`: tool:id of each item that a call of MAKERS made, pos is the call's seq.

Calls without a session or time take no part. Arguments that aren't a JSON object name nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Tool names kept, argument keys that name a file, tools whose results are items.
TOOLS = 50
FILE_KEYS = ["path", "file", "file_path", "directory"]
MAKERS = ["add_decision", "add_warning", "add_insight", "add_pattern", "start_feature", "archive_feature"]
_ROW = "session string, began bigint, ended bigint, kind string, pos bigint, value string"
_ARGS = ", ".join(f"{k} string" for k in FILE_KEYS) + ", files array<string>, feature string"
#: The provider of state stores that stateful processors need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _read(calls: DataFrame) -> DataFrame:
    """session, at (microseconds), seq, tool, files, feature (or null), made (or null), and ts."""
    a = F.from_json("args", _ARGS)
    named = F.concat(F.array(*[a[k] for k in FILE_KEYS]), F.coalesce(a["files"], F.array().cast("array<string>")))
    made = F.when(F.col("tool").isin(MAKERS) & (F.col("result_id") != ""), F.concat("tool", F.lit(":"), "result_id"))
    return calls.filter("session IS NOT NULL AND ts IS NOT NULL").select(
        F.col("session").cast("string").alias("session"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce(F.col("seq").cast("bigint"), F.lit(0).cast("bigint")).alias("seq"), F.coalesce("tool", F.lit("")).alias("tool"),
        F.array_distinct(F.filter(named, lambda f: F.coalesce(f, F.lit("")) != "")).alias("files"), F.when(a["feature"] != "", a["feature"]).alias("feature"), made.alias("made"),
    )


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"began": F.timestamp_micros("began"), "ended": F.timestamp_micros("ended")})


def tracked(calls: DataFrame) -> DataFrame:
    """The track of every session, whole. Files and counts are combined before they are shuffled; tools go through a
    window that keeps TOOLS rows of each session in every task before."""
    c = _read(calls)
    heads = c.groupBy("session").agg(F.min("at").alias("began"), F.max("at").alias("ended"), F.count("*").alias("pos"), F.coalesce(F.max(F.when(F.col("feature").isNotNull(), F.struct("at", "seq", "feature")))["feature"], F.lit("")).alias("value"))
    first = c.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy("at", "seq", "tool"))).filter(F.col("n") <= TOOLS)
    parts = first.select("session", F.lit("tool").alias("kind"), F.col("seq").alias("pos"), F.col("tool").alias("value"))
    parts = parts.unionByName(c.select("session", F.explode("files").alias("value")).distinct().select("session", F.lit("file").alias("kind"), F.lit(0).cast("bigint").alias("pos"), "value"))
    parts = parts.unionByName(c.filter("made IS NOT NULL").select("session", F.lit("made").alias("kind"), F.col("seq").alias("pos"), F.col("made").alias("value")))
    out = parts.join(heads.select("session", "began", "ended"), "session").select("session", "began", "ended", "kind", "pos", "value")
    return _timed(out.unionByName(heads.select("session", "began", "ended", F.lit("session").alias("kind"), "pos", "value")))


class _Tracker(StatefulProcessor):
    """A session's state: one head, its first tools, a map of files and a list of items, so that a call touches what it
    changes only. The order in which calls of a batch come doesn't matter."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "began bigint, ended bigint, calls bigint, feature_at bigint, feature_seq bigint, feature string")
        self.tools = handle.getListState("tools", "at bigint, seq bigint, tool string")
        self.files = handle.getMapState("files", "file string", "n bigint")
        self.made = handle.getListState("made", "seq bigint, item string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.head.get() if self.head.exists() else None
        began, ended, calls, *feature = before or (None, None, 0, 0, -1, "")
        for f in rows:
            began = int(f["at"].min()) if began is None else min(began, int(f["at"].min()))
            ended = int(f["at"].max()) if ended is None else max(ended, int(f["at"].max()))
            calls += len(f)
            named = f[f["feature"].notna()]
            feature = max([tuple(feature), *zip(named["at"].astype(int), named["seq"].astype(int), named["feature"])])
            first = sorted([*self.tools.get(), *f[["at", "seq", "tool"]].sort_values(["at", "seq", "tool"]).head(TOOLS).itertuples(index=False, name=None)])[:TOOLS]
            self.tools.put([(int(a), int(q), t) for a, q, t in first])
            for file in {x for files in f["files"] for x in files}:
                self.files.updateValue((file,), (1,))
            items = f[f["made"].notna()]
            if len(items):
                self.made.appendList([(int(q), m) for q, m in zip(items["seq"], items["made"])])
        self.head.update((began, ended, calls, int(feature[0]), int(feature[1]), feature[2]))
        if before:
            self.handle.deleteTimer(before[1] // 1000 + self.gap)
        self.handle.registerTimer(ended // 1000 + self.gap)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The track of a session that has ended; its state is dropped."""
        began, ended, calls, _, _, feature = self.head.get()

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame([(key[0], began, ended, *r) for r in rows], columns=[c.split()[0] for c in _ROW.split(", ")])

        yield frame([("session", calls, feature)] + [("tool", q, t) for _, q, t in self.tools.get()])
        for found in (("file", 0, k[0]) for k in self.files.keys()), (("made", q, m) for q, m in self.made.get()):
            some = []
            for row in found:
                some.append(row)
                if len(some) == 10_000:
                    yield frame(some)
                    some = []
            if some:
                yield frame(some)
        for state in (self.head, self.tools, self.files, self.made):
            state.clear()

    def close(self) -> None:
        pass


def track_stream(calls: DataFrame, gap_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """The tracks of sessions as they end: a session ends when the watermark (`late` behind the newest call) is
    gap_seconds past its last call; a call after that begins it anew. Agrees with `tracked` if no session pauses that
    long. The session setting STORE must be set before the stream starts."""
    c = _read(calls.withWatermark("ts", late))
    out = c.groupBy("session").transformWithStateInPandas(_Tracker(gap_seconds), _ROW, "append", "eventTime")
    return _timed(out)
