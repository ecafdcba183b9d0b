"""Tree lines against a recursive writer, kept tables of activity, conversations on disk."""

import datetime
import json
import random

from cairnlore.operators import activity, answers, tree
from cairnlore.sources import files


def write(paths):
    """The tree as one would write it by hand."""
    root = {"dirs": {}, "files": set()}
    for path in paths:
        *folders, name = [x for x in path.split("/") if x] or [None]
        node = root
        for x in folders:
            node = node["dirs"].setdefault(x, {"dirs": {}, "files": set()})
        if name is not None:
            node["files"].add(name)
    count = lambda n: len(n["files"]) + sum(map(count, n["dirs"].values()))
    out = []

    def node(n, indent, prefix):
        if len(n["dirs"]) == 1 and not n["files"]:
            (x, child), = n["dirs"].items()
            return node(child, indent, f"{prefix}/{x}" if prefix else x)
        if prefix:
            out.append("  " * indent + prefix + ":")
            indent += 1
        for x in sorted(n["dirs"], key=str.encode):
            why = "generated" if x.lower() in tree.GENERATED else "hidden" if x.startswith(".") and x not in (".", "..") else None
            if why:
                out.append("  " * indent + f"{x}: [{count(n['dirs'][x])} {why} files]")
            else:
                node(n["dirs"][x], indent, x)
        if len(n["files"]) > 12:
            out.append("  " * indent + f"- [{len(n['files'])} files...]")
        else:
            out.extend("  " * indent + f"- {x}" for x in sorted(n["files"], key=str.encode))

    node(root, 1, "")
    return out


def lines(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return tree.tree_lines(df)


def told(found):
    return ["  " * r.indent + r.label for r in sorted(found.collect(), key=lambda r: r.number)]


def test_like_a_recursive_writer(spark):
    rng = random.Random(11)
    names = ["src", "lib", "a b", "build", ".git", "Dist", "x", "é", "0", "deep"]
    paths = ["/".join([*(rng.choice(names) for _ in range(rng.randrange(5))), f"f{rng.randrange(30)}"]) for _ in range(250)]
    paths += [f"one/two/three/f{i}" for i in range(3)] + [f"many/f{i}" for i in range(13)] + ["//odd//file", "one/two/three/f0", "", "deep/deep/deep/build/gen/x"]
    assert told(lines(spark, paths)) == write(paths)
    for only in (["a/b/c/d.txt"], ["build/x", "y"], ["x"], ["a/build/x", "a/build/y"], [".git/a", "src/.hidden/z"], []):
        assert told(lines(spark, only)) == write(only)


def test_views(spark):
    found = lines(spark, ["src/api/v1/user.py", "src/api/v1/sub/x.py", "src/api/health.py", "src/app.py", "docs/a/b/c.md", "README"])
    text = lambda *a, **k: [r.text for r in sorted(tree.tree_view(found, *a, **k).collect(), key=lambda r: r.number)]
    assert text() == ["  docs/a/b:", "  src:", "    api: [...]", "  - README"]
    assert text("src/api") == ["    api:", "      v1:", "        sub:", "          - x.py", "        - user.py", "      - health.py"]
    assert text("src", depth=1) == ["  src:", "    api: [...]"] and text("none") == []


def test_three_increments_equal_one_run(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"c{c}", f"a{c % 5}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=c), f"p{f}", rng.randrange(9), 1) for c in range(90) for f in rng.sample(range(12), rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "commit string, author string, ts timestamp, path string, added long, removed long")
    kept = activity.ActivityTables(spark, str(tmp_path / "t"), buckets=4, most_files=4)
    whole = lambda f: sorted(map(tuple, f.collect()))
    for batch, (lo, hi) in enumerate([(0, 30), (30, 60), (60, 90)]):
        part = spark.createDataFrame([r for r in rows if lo <= int(r[0][1:]) < hi], df.schema)
        kept.add(part, "log", batch)
        kept.add(part, "log", batch)  # a batch that comes again
    as_of = "2024-02-01 00:00:00"
    assert whole(kept.expertise(as_of)) == whole(activity.file_expertise(df, as_of))
    assert whole(kept.cochange(3, 0.2)) == whole(activity.cochange(df, 4, 3, 0.2, k=None)) != []


def test_conversations_of_features(spark, tmp_path):
    for feature, name, day in (("auth", "one", 1), ("auth", "two", 3), ("api", "three", 2)):
        folder = tmp_path / "features" / feature / "conversations"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json").write_text(json.dumps({"id": name, "feature": feature, "summary": "s", "created_at": f"2024-01-0{day}T00:00:00Z"}, indent=1))
        (folder / "notes.txt").write_text("no conversation")
    (tmp_path / "features" / "api" / "conversations" / "broken.json").write_text("{")
    found = files.conversation_records(spark, str(tmp_path)).filter("id IS NOT NULL")
    assert sorted((r.id, r.folder) for r in found.collect()) == [("one", "auth"), ("three", "api"), ("two", "auth")]
    assert {r.id for r in files.conversation_records(spark, str(tmp_path), "auth").collect()} == {"one", "two"}
    ids = lambda *a: [r.id for r in answers.newest_conversations(found, *a).collect()]
    assert ids() == ["two", "three", "one"] and ids("auth") == ["two", "one"] and ids(None, "2024-01-01 00:00:00") == ["two", "three"] and ids(None, None, 1) == ["two"]
    features = spark.createDataFrame([("f", "active", "b", None, "d")], "id string, status string, branch string, owner string, description string")
    assert files.feature_summaries(features).columns == ["id", "status", "branch", "owner"]
