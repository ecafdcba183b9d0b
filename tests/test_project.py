import datetime

from cairnlore.operators import answers, extract, knowledge, project
from cairnlore.sources import commitlog, files
from pyspark.sql import functions as F

from tests.test_sources import FILES, source


def plain_terms(text, terms):
    return {t for t in terms if t in text.lower()}


def test_terms_in_texts_against_brute_force(spark):
    texts = ["Station äü NATION x", "no token here", "", None, "a" * 500 + "bc nationality"]
    terms = ["nation", "äü", "x", "tion", "missing", "abc", "token", "n"]
    code = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.term) for r in knowledge.terms_in(code, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(i, t) for i, x in enumerate(texts) for t in plain_terms(x or "", terms)}


def test_related_paths_hold_each_other(spark):
    code = spark.createDataFrame([(1, "src/auth/login.ts"), (2, "login.ts"), (3, "other")], "id long, path string")
    rules = spark.createDataFrame([("r", ["auth/login.ts"]), ("s", ["src"]), ("t", ["x/login.ts/y", ""])], "rule_id string, related_files array<string>")
    assert {(r.id, r.rule_id) for r in knowledge.related_by_path(code, rules).collect()} == {(1, "r"), (1, "s"), (2, "r"), (2, "t")}


def test_budget_over_many_partitions(spark):
    rows = [(i, float(1000 - i), (i * 7) % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, score double, cost long")
    want, used = [], 0
    for i, _, c in rows:
        if used + c > 100:
            break
        used += c
        want.append((i, used))
    for parts in (1, 7, 64):
        got = knowledge.within_budget(df.repartition(parts), 100, [], [F.desc("score")], F.col("cost")).orderBy("id").collect()
        assert [(r.id, r.used) for r in got] == want


def test_semantic_chunks_and_records(spark):
    s = source(spark)
    chunks = {(r.path[0], r.kind, r["name"]): (r.start, r.end) for r in project.semantic_chunks(s).collect()}
    assert chunks["a", "class", "UserController"] == (5, 10) and chunks["a", "method", "find"] == (7, 9) and chunks["b", "function", "main"] == (12, 15)
    records = {r.path[0]: r for r in project.file_records(s).collect()}
    assert (records["a"].imports, records["a"].language) == (3, "typescript") and records["c"].imports == 3 and records["d"].summary == ""
    assert len(records) == len(FILES)
    lines = {r.path[0]: r.lines for r in project.line_estimate(extract.skeleton(s)).collect()}
    assert lines["f"] == 1 + 3 + 1 + 2 + 1
    assert [r.container for r in project.signatures(s, "SAVE").collect()] == ["Store", "User"]
    assert {r.text for r in project.rendered_types(extract.ts_types(s)).collect()} == {"enum Role { Admin, Guest }\ninterface User { id, name }"}
    assert ("a", 5, "Controller") in {(r.path[0], r.line, r.decorator) for r in project.decorators(s).collect()}


def test_parameters_of_languages(spark):
    cases = {
        "typescript": ("private readonly a: A, b?: string = 'x', ...rest: any[]", [("a", "A", False, ""), ("b", "string", True, "'x'"), ("rest", "any[]", False, "")]),
        "python": ("self, a, b: int = 5, **kw", [("a", "", False, ""), ("b", "int", True, "5"), ("kw", "", False, "")]),
        "go": ("ctx context.Context, n int", [("ctx", "context.Context", False, ""), ("n", "int", False, "")]),
        "java": ("final String name, List<String> xs", [("name", "String", False, ""), ("xs", "List<String>", False, "")]),
        "csharp": ("ref int a, string b = \"x\"", [("a", "int", False, ""), ("b", "string", True, '"x"')]),
        "rust": ("&self, mut n: u32", [("n", "u32", False, "")]),
        "php": ("?int $a, $b = 3", [("a", "?int", False, ""), ("b", "", True, "3")]),
        "ruby": ("a, b = 1, *c", [("a", "", False, ""), ("b", "", True, "1"), ("c", "", False, "")]),
        "cpp": ("const std::string& s, int n = 4", [("s", "std::string", False, ""), ("n", "int", True, "4")]),
        "kotlin": ("val a: Int = 1, b: String", [("a", "Int", True, "1"), ("b", "String", False, "")]),
        "swift": ("a: Int, b: String = \"\"", [("a", "Int", False, ""), ("b", "String", True, '""')]),
        "scala": ("a: Int, b: Option[Int] = None", [("a", "Int", False, ""), ("b", "Option[Int]", True, "None")]),
    }
    for language, (text, want) in cases.items():
        got = spark.createDataFrame([(text,)], "t string").select(project.parameters(F.col("t"), language).alias("p")).first().p
        assert [tuple(p) for p in got] == want, language


def test_django_and_prisma(spark):
    rows = [
        ("u/urls.py", "urlpatterns = [\n  path('items/<int:pk>/', v.item),\n  re_path(r'^old/$', v.old),\n]\n", "python"),
        ("s.prisma", "enum Role {\n  ADMIN\n  USER\n}\nmodel User {\n  id Int @id @default(autoincrement())\n  role Role @default(USER)\n  posts Post[]\n  bio String?\n  @@index([role])\n}\nmodel Post {\n  author User @relation(fields: [authorId], references: [id])\n}\n", "unknown"),
    ]
    df = spark.createDataFrame(rows, "path string, content string, language string")
    assert [(r.route, tuple(r.params), r.line) for r in project.django_routes(df).orderBy("line").collect()] == [("/items/<int:pk>/", ("pk",), 2), ("/old/", (), 3)]
    got = {(r.model, r.field): (r.type, r.many, r.optional, r.relation, r.default, tuple(r.attributes)) for r in project.prisma_fields(df).collect()}
    assert got == {
        ("Role", "ADMIN"): ("enum", False, False, False, "", ()),
        ("Role", "USER"): ("enum", False, False, False, "", ()),
        ("User", "id"): ("Int", False, False, False, "autoincrement()", ("id", "default")),
        ("User", "role"): ("Role", False, False, False, "USER", ("default",)),
        ("User", "posts"): ("Post", True, False, True, "", ()),
        ("User", "bio"): ("String", False, True, False, "", ()),
        ("Post", "author"): ("User", False, False, True, "", ("relation",)),
    }


def test_project_views(spark):
    t = lambda day: datetime.datetime(2024, 1, day)
    rows = [("nx.json", "unknown", 1, t(1)), ("apps/a/x.ts", "typescript", 10, t(2)), ("apps/b/y.ts", "typescript", 20, t(3)), ("libs/c/z.spec.ts", "typescript", 30, t(4))]
    df = spark.createDataFrame(rows, "path string, language string, size long, modified timestamp")
    assert {(r["name"], r.value) for r in project.architecture(df).collect()} == {("monorepo", "nx"), ("apps", "2"), ("libs", "1"), ("language:typescript", "3")}
    assert {(r.folder, r.files, r.size) for r in project.index_status(df).collect()} == {(".", 1, 1), ("apps/a", 1, 10), ("apps/b", 1, 20), ("libs/c", 1, 30)}
    indexed = spark.createDataFrame([("apps/a/x.ts", t(5)), ("apps/b/y.ts", t(1))], "path string, indexed_at timestamp")
    assert {r.path for r in project.stale(df, indexed).collect()} == {"nx.json", "apps/b/y.ts", "libs/c/z.spec.ts"}
    examples = project.newest_examples(df, {"test": (r"\.spec\.", 2), "feature": (r"^apps/", 1)}).collect()
    assert {(r.kind, r.rank, r.path) for r in examples} == {("test", 1, "libs/c/z.spec.ts"), ("feature", 1, "apps/b/y.ts")}


def test_blueprint(spark):
    code = spark.createDataFrame([("u.ts", "/* all */\nclass UserService {\n  // note\n  user() {\n        deep();\n  }\n}\n")], "path string, content string")
    assert project.condensed(code, "user").first().text == "class {Name}Service {\n  {name}() {\n  }\n}"
    records = spark.createDataFrame([("a", "A", ["Auth", "api"]), ("b", "B", ["auth"]), ("c", "C", [])], "id string, text string, tags array<string>")
    assert [(r.id, r.hits) for r in project.best_tagged(records, ["auth", "API"]).collect()] == [("a", 2), ("b", 1)]
    part = lambda n: spark.createDataFrame([(1, "x" * n)], "id long, text string")
    got = project.blueprint({"examples": part(4000), "decisions": part(4000), "checklist": part(40), "correlations": part(16000)}, 4000).collect()
    assert {r.section for r in got} == {"examples", "decisions", "checklist"} and {r.confidence for r in got} == {1.0}


def test_collections_and_reports(spark, tmp_path):
    for name, body in (("one", '[{"id": "d1", "content": "c"}]'), ("two", "not json")):
        (tmp_path / "features" / name).mkdir(parents=True)
        (tmp_path / "features" / name / "decisions.json").write_text(body)
    found = files.feature_records(spark, str(tmp_path), "decisions").filter("id IS NOT NULL").collect()
    assert [(r.id, r.folder) for r in found] == [("d1", "one")]
    df = spark.createDataFrame([("d9", "c", 1)], "id string, content string, other int")
    files.replace_collection(df, str(tmp_path / "d"), "decisions")
    back = files.collection(spark, str(tmp_path / "d"))
    assert "other" not in back.columns and back.first().id == "d9"
    answers.write_reports({"risks": df, "experts": df}, str(tmp_path / "r"))
    assert files.report(spark, str(tmp_path / "r"), "risks").count() == 1
    for _ in range(2):
        files.append_log(spark.createDataFrame([("2024-01-01 00:00:00", "info", "x")], "at string, level string, message string"), str(tmp_path / "log"))
    assert [(r.level, r.entries) for r in files.log_counts(spark, str(tmp_path / "log")).collect()] == [("info", 2)]
    log = spark.createDataFrame([(f"{i}", datetime.datetime(2024, 1, 1 + i)) for i in range(5)], "hash string, ts timestamp")
    assert [r.hash for r in commitlog.newest(log, 2).collect()] == ["4", "3"]


def test_risk_levels_by_hand(spark):
    t = lambda y, m: datetime.datetime(y, m, 1)
    rows = [("c1", "ann", t(2023, 12), "new/a"), ("c1", "ann", t(2023, 12), "new/b"), ("c2", "bob", t(2020, 1), "old/a"), ("c2", "bob", t(2020, 1), "old/b"), ("c3", "ann", t(2023, 12), "mix/b"), ("c4", "cy", t(2023, 1), "mix/a"), ("c5", "ann", t(2023, 12), "solo/a")]
    df = spark.createDataFrame([(*r, 1, 0) for r in rows], "commit string, author string, ts timestamp, path string, added long, removed long")
    risks = answers.live_risk(df, "2024-01-01 00:00:00")
    got = [(r.dir, r.level) for r in risks.orderBy(*answers.by_level(risks)).collect()]
    assert got == [("old", "CRITICAL"), ("mix", "HIGH"), ("new", "MEDIUM")]
    renames = spark.createDataFrame([("new/a", "old/a", t(2019, 1)), ("old/a", "mix/a", t(2022, 1))], "old string, new string, ts timestamp")
    assert [r.commit for r in answers.file_history(df, renames, "mix/a").collect()] == ["c4", "c2"]
