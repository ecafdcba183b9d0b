"""Tracks of sessions, in a batch and by a stream."""

import datetime
import json
import random

from cairnlore.streaming import tracker
from pyspark.sql import functions as F

SCHEMA = "session string, seq long, ts timestamp, tool string, args string, result_id string"


def call(session, seq, tool="query", args=None, result=None, minute=None):
    return (session, seq, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=seq if minute is None else minute), tool, args if args is None or isinstance(args, str) else json.dumps(args), result)


def plain(calls):
    """Sessions by a loop over their calls in order."""
    out = set()
    for s in {c[0] for c in calls if c[0]}:
        own = sorted((c for c in calls if c[0] == s and c[2]), key=lambda c: (c[2], c[1], c[3]))
        if not own:
            continue
        times, feature, rows = (own[0][2], own[-1][2]), "", []
        for n, (_, seq, _, tool, args, result) in enumerate(own):
            rows += [("tool", seq, tool)] if n < 50 else []
            try:
                given = json.loads(args or "{}")
            except ValueError:
                given = {}
            named = [given[k] for k in tracker.FILE_KEYS if given.get(k)] + [f for f in given.get("files") or [] if f]
            rows += [("file", 0, f) for f in named]
            feature = given.get("feature") or feature
            rows += [("made", seq, f"{tool}:{result}")] if tool in tracker.MAKERS and result else []
        out |= {(s, *times, *r) for r in rows + [("session", len(own), feature)]}
    return out


def sample():
    dice = random.Random(6)
    calls = []
    for s in "abc":
        for seq in range(dice.randrange(60, 90)):
            args = {k: f"src/{dice.randrange(9)}.ts" for k in tracker.FILE_KEYS if dice.random() < 0.2}
            args |= {"files": ["x.go", "", None, f"{seq % 5}.py"]} if dice.random() < 0.2 else {}
            args |= {"feature": dice.choice(["auth", "", "search"])} if dice.random() < 0.1 else {}
            calls.append(call(s, seq, dice.choice(["query", "search", *tracker.MAKERS]), args, dice.choice([None, "", f"id{seq}"])))
    return calls + [call("d", 0, args="not json"), call("d", 1, args=None), call(None, 5), ("e", 1, None, "query", None, None)]


def rows(df):
    return {tuple(r) for r in df.select("session", "began", "ended", "kind", "pos", "value").collect()}


def test_tracks_by_a_plain_loop(spark):
    calls = sample()
    df = spark.createDataFrame(calls, SCHEMA)
    found = tracker.tracked(df).collect()
    assert {tuple(r) for r in found} == plain(calls) and len(found) == len(plain(calls))
    assert tracker.tracked(df.limit(0)).count() == 0


def test_the_stream_tells_the_same_when_sessions_end(spark, tmp_path):
    calls = [c for c in sample() if c[0] != "e"]
    key, store = tracker.STORE
    spark.conf.set(key, store)
    source = str(tmp_path / "calls")
    last = call("z", 0, minute=3000)
    for part in ([c for c in calls if c[1] < 40][::-1], [c for c in calls if c[1] >= 40], [last], [call("z", 1, minute=3001)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    try:
        q = tracker.track_stream(stream, 3600).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    finally:
        spark.conf.unset(key)
    got = spark.table("tracks")
    assert rows(got) == plain(calls)  # z is still open
    assert got.filter(F.col("session") == "z").isEmpty() and got.count() == len(plain(calls))
