import datetime

from cairnlore.streaming import index, sessions
from pyspark.sql import functions as F


def test_captures_batch_and_stream_agree(spark, tmp_path):
    tools = ["x"] * 24 + ["x", "add_decision", "x", "x", "x", "add_decision", "start_feature", "x", "x", "start_feature"]
    rows = [(s, i, t) for s in ("a", "b") for i, t in enumerate(tools[: 30 if s == "b" else None])]
    calls = spark.createDataFrame(rows, "session string, seq long, tool string")
    got = sorted(map(tuple, sessions.captures(calls).collect()))
    assert [g[1:] for g in got if g[0] == "a"] == [(24, "x", "checkpoint", 25), (29, "add_decision", "knowledge_created", 5), (33, "start_feature", "lifecycle", 4)]
    source = str(tmp_path / "calls")
    for lo, hi in ((0, 20), (20, 40)):  # files are read one after another, so each is a batch
        calls.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = sessions.capture_stream(stream).writeStream.format("memory").queryName("captured").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("captured").collect())) == got


def test_incremental_index_keeps_the_newest(spark, tmp_path):
    schema, source, target = "path string, summary string, indexed_at long", str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: index.watch(spark, source, schema, target, str(tmp_path / "state")).awaitTermination(120)
    spark.createDataFrame([("a", "old", 1), ("b", "only", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([("a", "new", 2), ("c", "late", 2), ("b", "older", 0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()  # nothing new: nothing happens
    assert sorted((r.path, r.summary) for r in index.current(spark, target).collect()) == [("a", "new"), ("b", "only"), ("c", "late")]


def test_gap_sessions(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(1, 1, at(0)), (1, 2, at(24)), (1, 3, at(49)), (2, 4, at(0))]
    got = sessions.gap_sessions(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 86400), (1, 2, 1, 0), (2, 1, 1, 0)]
