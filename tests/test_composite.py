from cairnlore.operators import composite, extract

from tests.test_sources import source


def test_blocks_end_where_braces_balance(spark):
    body = "func a() {\n  if x {\n  }\n}\nfunc b()\n{\n\n"
    files = spark.createDataFrame([("f", body)], "path string, content string")
    starts = spark.createDataFrame([("f", 1), ("f", 5)], "path string, line int")
    got = sorted((r.start, r.end) for r in composite.block_ends(files, starts, most=50).collect())
    assert got == [(1, 4), (5, 8)]
    assert [r.end for r in composite.block_ends(files, starts.limit(1), most=2).collect()] == [2]


def test_summaries_and_rendering(spark):
    sk = extract.skeleton(source(spark))
    told = {r.path: r.summary for r in composite.file_summary(sk).collect()}
    assert told["a/user.ts"] == "1 class(s): UserController" and told["b/main.go"] == "1 function(s): main"
    text = {r.path: r.text for r in composite.rendered(sk).collect()}
    assert "class User(Base):\n  def save(self):" in text["c/app.py"]


def test_frameworks_rules_and_first_source(spark):
    m = spark.createDataFrame([("a", '"@nestjs/core": 1, "express": 2'), ("b", "gin-gonic"), ("c", "")], "path string, content string")
    got = composite.frameworks(m, [("@nestjs/core", "nest"), ("express", "express"), ("gin-gonic", "gin")]).collect()
    assert {r.path: r.framework for r in got} == {"a": "nest", "b": "gin"}
    d = spark.createDataFrame([(2, "b", "active"), (1, "a", None), (3, "c", "superseded")], "seq long, content string, status string")
    assert composite.rules_text("P", d, d.select("seq", "content"), (30, 1)).first().text == "# P\n\n## Decisions\n- a\n- b\n\n## Warnings\n- a"
    one, two = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1)], [("a", 2), ("b", 2)]))
    assert sorted(map(tuple, composite.first_source([one, two], ["k"]).collect())) == [("a", 1), ("b", 2)]
