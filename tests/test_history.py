"""Names over time and containment joins, against plain loops."""

import datetime
import random

from cairnlore.operators import answers, composite, containment, knowledge
from pyspark.sql import functions as F


def at(day):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


def slow_file(path, ts, renames):
    """Follows a change forward through the renames (old, new, day)."""
    moves = sorted(renames, key=lambda r: r[2])
    day = (ts - at(0)).days
    # A change under the new name at the time of the rename comes after it, one under the old name before it.
    start = next((i for i, (o, n, d) in enumerate(moves) if d > day or (d == day and o == path)), len(moves))
    for o, n, d in moves[start:]:
        if o == path:
            path = n
        elif n == path:
            return f"{path}@{at(d):%Y-%m-%d %H:%M:%S}.000000"
    return path


def test_names_count_at_their_time_only(spark):
    rng = random.Random(6)
    names = [f"p{i}" for i in range(8)]
    renames = [(*rng.sample(names, 2), day) for day in range(5, 200, 5)]
    changes = [(f"c{i}", "ann", at(rng.randrange(210)), rng.choice(names)) for i in range(400)]
    df = spark.createDataFrame(changes, "commit string, author string, ts timestamp, path string")
    moved = spark.createDataFrame([(o, n, at(d)) for o, n, d in renames], "old string, new string, ts timestamp")
    got = {r.commit: r.file for r in answers.followed(df, moved).collect()}
    assert got == {c: slow_file(p, ts, renames) for c, _, ts, p in changes}


def test_a_name_that_another_file_had_before(spark):
    df = spark.createDataFrame([("c1", "a", at(1), "util"), ("c2", "a", at(8), "util"), ("c3", "a", at(9), "lib"), ("c4", "a", at(20), "util")], "commit string, author string, ts timestamp, path string")
    moved = spark.createDataFrame([("util", "lib", at(5)), ("tool", "util", at(15))], "old string, new string, ts timestamp")
    commits = lambda p: [r.commit for r in answers.file_history(df, moved, p).collect()]
    assert commits("lib") == ["c3", "c1"] and commits("util") == ["c4"] and commits("tool") == []
    assert [r.commit for r in answers.file_history(df, moved.limit(0), "util").collect()] == ["c4", "c2", "c1"]


def test_long_chains_take_few_rounds(spark):
    n = 100
    moved = spark.createDataFrame([(f"n{i}", f"n{i + 1}", at(i)) for i in range(n)], "old string, new string, ts timestamp")
    assert {r.file for r in answers.stints(moved).filter(F.col("until").isNotNull() & (F.col("path") == "n0")).collect()} == {f"n{n}"}


def test_paths_that_start_alike_meet_few_others(spark):
    front = "src/main/java/com/example/service/"
    paths = [f"{front}module{i:04}/Handler{i * 7 % 1000:04}.java" for i in range(600)]
    files = [f"module{i:04}/Handler{i * 7 % 1000:04}" for i in range(0, 600, 3)] + [front]
    longs = spark.createDataFrame([(p,) for p in paths], "long string")
    shorts = spark.createDataFrame([(f,) for f in files], "short string")
    want = {(p, f) for p in paths for f in files if f in p}
    assert {tuple(r) for r in containment.contained(longs, shorts).collect()} == want
    # All pairs would be 120,600.
    assert containment.candidates(longs, shorts).count() < 12_000


def test_contained_like_a_loop(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abÄ") for _ in range(rng.randrange(n)))
    longs, shorts = {word(14) for _ in range(120)}, {word(6) for _ in range(60)} | {"", "a", "zz"}
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in [*xs, None]], f"{c} string")
    got = {tuple(r) for r in containment.contained(frame(longs, "long"), frame(shorts, "short")).collect()}
    assert got == {(a, b) for a in longs for b in shorts if b and b in a}
    assert containment.contained(frame(longs, "long"), frame([], "short")).isEmpty()


def test_compliance_in_full(spark):
    code = spark.createDataFrame([(1, "src/auth/token.ts", "const x = localStorage.get(token)\nretry forever loops"), (2, None, "nothing here")], "id long, path string, text string")
    decisions = spark.createDataFrame([("d1", "", "Avoid localStorage for tokens", ["src/auth"]), ("d2", "superseded", "avoid localStorage", ["src/auth"]), ("d3", "active", "fine", ["src/auth/token.ts.bak", "lib"])], "rule_id string, status string, text string, related_files array<string>")
    warnings = spark.createDataFrame([("w1", "critical", "token and localStorage leak"), ("w2", "warning", "retry loops"), ("w3", "info", "retry loops"), ("w4", "critical", "get the x")], "rule_id string, severity string, text string")
    patterns = spark.createDataFrame([("p1", ["retry forever", "nothing"]), ("p2", ["retry", "forever"]), ("p3", None)], "rule_id string, anti_patterns array<string>")
    got = sorted(tuple(r) for r in knowledge.compliance_report(code, decisions, warnings, patterns).collect())
    assert got == [("decision", 1, "d1", "blocker"), ("decision", 1, "d1", "info"), ("decision", 1, "d3", "info"), ("pattern", 1, "p1", "warning"), ("warning", 1, "w1", "blocker"), ("warning", 1, "w2", "warning")]


def test_sections_are_limited_before_they_are_ranked(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), "id")
    top = composite.top_of_each(df, "g", [F.desc("id")], {"a": 2, "b": 1, "c": 5})
    assert sorted(map(tuple, top.collect())) == [("a", 996, 2), ("a", 999, 1), ("b", 998, 1)]
    assert top._jdf.queryExecution().sparkPlan().toString().count("TakeOrderedAndProject(limit=") == 2  # none for c
