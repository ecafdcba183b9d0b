from cairnlore.operators import activity, extract, graph, knowledge, text
from cairnlore.sources import commitlog, files
from pyspark.sql import functions as F

H = "0123456789abcdef0123456789abcdef0123456"
LOG = f"""{H}1|0123456|Ann|ann@x|2024-05-20T10:00:00+00:00|fix a | b
10\t2\tsrc/a/x.py
-\t-\tlogo.png

{H}2|0123457|Bob|bob@x|2024-04-02T08:00:00+02:00|add
1\t1\tsrc/a/x.py
not a header|x
7\t0\tlib/my file.py
"""


def test_log_keeps_subjects_with_bars_and_binary_files(spark):
    parsed = commitlog.commits(spark.createDataFrame([("r", LOG)], "repo string, value string"))
    rows = {r.short_hash: r for r in parsed.collect()}
    assert rows["0123456"].subject == "fix a | b" and [tuple(f) for f in rows["0123456"].files] == [("src/a/x.py", 10, 2), ("logo.png", 0, 0)]
    assert [f.path for f in rows["0123457"].files] == ["src/a/x.py", "lib/my file.py"] and rows["0123457"].ts.hour == 6
    assert commitlog.changes(parsed).count() == 4
    middle = f"{H}3|abc|a|b: c|Ann|ann@x|2024-05-20T10:00:00+00:00\n3\t4\tp"
    got = commitlog.commits(spark.createDataFrame([(middle,)], "value string"), layout=commitlog.SUBJECT_MIDDLE).first()
    assert (got.subject, got.author, got.email) == ("a|b: c", "Ann", "ann@x")


def test_diff_and_status(spark):
    diff = "--- a/x\n+++ b/x\n@@ -1 +1 @@ f\n-old\n+new\n+more\n@@ -9 +9 @@\n ctx"
    r = commitlog.diff_summary(spark.createDataFrame([(diff,)], "diff string"), cut=12).first()
    assert (r.added, r.removed, len(r.hunks), r.hunks[0]) == (2, 1, 2, "@@ -1 +1 @@ ")
    lines = [(" M a.py",), ("?? b.py",), ("R  c.py -> d.py",), ("D  e.py",), ("A  f g.py",)]
    got = {r.path: (r.status, r.old_path) for r in commitlog.status(spark.createDataFrame(lines, "value string")).collect()}
    assert got == {"a.py": ("modified", None), "b.py": ("untracked", None), "d.py": ("renamed", "c.py"), "e.py": ("deleted", None), "f g.py": ("added", None)}


CHANGES = [("c1", "2024-05-20", "alice", "src/a/x.py", 10, 2), ("c1", "2024-05-20", "alice", "src/a/y.py", 5, 0), ("c2", "2024-05-10", "alice", "src/a/x.py", 3, 1), ("c3", "2024-04-02", "bob", "src/a/x.py", 1, 1), ("c3", "2024-04-02", "bob", "lib/z.py", 7, 0), ("c4", "2023-01-15", "carol", "old/m.py", 100, 0), ("c4", "2023-01-15", "carol", "old/n.py", 50, 5), ("c5", "2023-01-10", "carol", "old/m.py", 2, 2)]
AS_OF = "2024-06-01 00:00:00"


def changes(spark):
    return spark.createDataFrame(CHANGES, "commit string, ts string, author string, path string, added long, removed long").withColumn("ts", F.to_timestamp("ts"))


def test_activity_by_hand(spark):
    c = changes(spark)
    assert {r.author: (r.commits, r.added, r.removed, r.active) for r in activity.contributors(c, AS_OF).collect()} == {"alice": (2, 18, 3, True), "bob": (1, 8, 1, True), "carol": (2, 152, 7, False)}
    experts = {(r.dir, r.author): (r.total, r.file_count, r.ownership) for r in activity.directory_experts(c, AS_OF).collect()}
    assert experts == {("src/a", "alice"): (4, 2, 0.75), ("src/a", "bob"): (4, 2, 0.25), ("old", "carol"): (3, 2, 1.0), ("lib", "bob"): (1, 1, 1.0)}
    assert [(r.dir, r.level, r.last_activity) for r in activity.knowledge_risk(c, AS_OF).collect()] == [("old", "CRITICAL", "Over a year ago")]
    own = {r.author: (r.commits, r.ownership, r.total_lines, r.churn) for r in activity.file_expertise(c, AS_OF).filter("path = 'src/a/x.py'").collect()}
    assert own == {"alice": (2, 0.666667, 14, "low"), "bob": (1, 0.333333, 14, "low")}
    assert {(r.path, r.share, r.confidence) for r in activity.file_correlations(c, "src/a/x.py").collect()} == {("src/a/y.py", 0.333333, "low"), ("lib/z.py", 0.333333, "low")}
    assert {r.commit: r.impact for r in activity.commit_impact(c).collect()} == {"c1": "low", "c2": "low", "c3": "low", "c4": "medium", "c5": "low"}
    assert activity.cochange(c).count() == 0


def test_thresholds(spark):
    def log(groups):
        rows = [(f"{g}-{i}", f"{p}") for g, (n, paths) in enumerate(groups) for i in range(n) for p in paths]
        return spark.createDataFrame(rows, "commit string, path string")

    pairs = lambda n: activity.cochange(log([(n, ["a", "b"])])).collect()
    assert pairs(8) == [] and pairs(9)[0].confidence == pairs(15)[0].confidence == "medium" and pairs(16)[0].confidence == "high"
    assert activity.cochange(log([(9, [f"f{i:02}" for i in range(30)])]), k=None).count() == 435 and activity.cochange(log([(9, [f"f{i:02}" for i in range(31)])])).count() == 0
    level = lambda lines, n: activity.commit_impact(spark.createDataFrame([("c", f"p{i}", lines if i == 0 else 0, 0) for i in range(n)], "commit string, path string, added long, removed long")).first().impact
    assert [level(x, 1) for x in (100, 101, 500, 501)] == ["low", "medium", "medium", "high"] and [level(1, n) for n in (5, 6, 20, 21)] == ["low", "medium", "medium", "high"]


def test_tokens_by_hand(spark):
    cases = {"auth flow": "auth authentication flow auth_authentication authentication_flow", "running tests": "running runn tests running_runn runn_tests", "the station": "station sta station_sta", "a í": "í", "": "", None: ""}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", F.array_join(text.tokens(F.col("t")), " ").alias("k"))
    assert {r.t: r.k for r in df.collect()} == cases


def test_full_text_grammar(spark):
    df = spark.createDataFrame([("Déjà vu, again",), ("vu only",), ("again deja",), ("",), (None,)], "t string")
    hits = lambda q: [r.t for r in text.full_text(df, q, "t").collect()]
    assert hits("deja vu") == ["Déjà vu, again"] and hits('"vu again"') == ["Déjà vu, again"] and hits("only OR again") == ["Déjà vu, again", "vu only", "again deja"]
    assert hits("again NOT vu") == ["again deja"] and hits("dej*") == ["Déjà vu, again", "again deja"] and hits("?") == []


def test_graph_by_hand(spark):
    e = spark.createDataFrame([("n", a, "n", b, "r") for a, b in ("AB", "BC", "CA", "DC")], "from_type string, from_id string, to_type string, to_id string, relation string")
    pairs = lambda d: {r.from_id + r.to_id for r in graph.bfs(e, "n", "A", d).collect()}
    assert pairs(1) == {"AB", "CA"} and pairs(2) == {"AB", "CA", "BC", "DC"}
    chain = graph.ancestors(spark.createDataFrame([("f3", "f2"), ("f2", "f1"), ("f1", "f3")], "id string, parent string")).filter("id = 'f3'").orderBy("depth").collect()
    assert [r.ancestor for r in chain] == ["f2", "f1", "f3"]
    imports = spark.createDataFrame([("src/a/x.ts", "./y"), ("src/a/x.ts", "../lib"), ("src/a/x.ts", "react"), ("src/a/x.ts", "./gone")], "path string, module string")
    known = spark.createDataFrame([("src/a/y.ts",), ("src/a/y.js",), ("src/lib/index.ts",)], "path string")
    assert {r.target for r in graph.resolve_imports(imports, known).collect()} == {"src/a/y.ts", "src/lib/index.ts"}


def test_budget_breaks_at_the_first_misfit(spark):
    ranked = lambda costs: spark.createDataFrame([(i, float(-i), c) for i, c in enumerate(costs)], "id long, score double, cost long")
    got = knowledge.chained_budget([("w", ranked([4, 5, 3, 1])), ("d", ranked([1])), ("p", ranked([1]))], 10).collect()
    assert [(r.kind, r.id, r.used) for r in got] == [("w", 0, 4), ("w", 1, 9), ("d", 0, 10)]
    assert [r.used for r in knowledge.chained_budget([("w", ranked([99])), ("d", ranked([3]))], 10).collect()] == [3]


def test_rules(spark):
    df = spark.createDataFrame([("Avoid localStorage for tokens",), ("piano keys, don't use eval(x)",), ("no no x",)], "t string")
    assert [r.p for r in df.select(knowledge.prohibited_terms(F.col("t")).alias("p")).collect()] == [["localstorage"], ["eval", "keys"], ["no", "x"]]
    code = spark.createDataFrame([(1, "x = localStorage.get()"), (2, "fine")], "id long, text string")
    rules = spark.createDataFrame([("r", "blocker", ["localstorage"], 1)], "rule_id string, severity string, terms array<string>, need int")
    assert [(r.id, r.rule_id, r.terms) for r in knowledge.compliance(code, rules).collect()] == [(1, "r", 1)]
    assert knowledge.since("7d", "2024-01-31 00:00:00") == "2024-01-24 00:00:00" and knowledge.since("30m", "2024-01-31 00:00:00") == "2024-01-30 23:30:00"
    assert knowledge.since("soon", "2024-01-31 00:00:00") is None


def test_commit_messages(spark):
    msgs = {
        "a": "feat!: move to new parser\n\nDecision: use one parser\nWhy: two drifted",
        "b": "x\nchose: one\nchose: two\nreason: faster\ndecided: three",
        "c": "fix!: same\nDECISION: same",
        "d": "WARNING: slow\nDanger: hot\nnote: small\nWarnING: odd\nBreaking Change: gone",
        "e": "nothing here",
    }
    df = spark.createDataFrame(list(msgs.items()), "commit string, message string")
    got = sorted((r.commit, r.title, r.reason) for r in knowledge.message_decisions(df).collect())
    assert got == [("a", "move to new parser", "Breaking change - see commit for details"), ("a", "use one parser", "two drifted"), ("b", "three", ""), ("b", "two", "faster"), ("c", "same", "")]
    assert sorted((r.title, r.severity) for r in knowledge.message_warnings(df).collect()) == [("gone", "critical"), ("hot", "critical"), ("slow", "warning"), ("small", "info")]


def test_pull_request_items(spark):
    body = "intro\n- no\n## Decisions\n- use one parser \n* keep it\ntext\n### Notes\n- not this\n## warnings\n  - slow start\n"
    got = knowledge.pull_request_items(spark.createDataFrame([(1, body), (2, None)], "id long, body string")).collect()
    assert sorted((r.section, r["item"]) for r in got) == [("decisions", "keep it"), ("decisions", "use one parser"), ("warnings", "slow start")]


FILES = [
    ("a/user.ts", "import { X } from './x';\nimport React from \"react\";\nconst y = require('../y');\n@Controller('users')\nexport class UserController {\n  @Get(':id')\n  async find(id: string): Promise<User> {\n    return process.env.DB_URL;\n  }\n}\nexport interface User {\n  id: string;\n  name?: string;\n}\nexport enum Role { Admin, Guest = 'g' }\nexport const add = (a: number) => a + 1;\nthis.bus.emit('user.created', u);\n"),
    ("b/main.go", "package main\nimport (\n\t\"fmt\"\n\t\"os\"\n)\ntype Store struct {\n\tName string `gorm:\"column:name\"`\n}\nfunc (s *Store) Save(x int) error {\n\treturn nil\n}\nfunc main() {\n\tr.GET(\"/ping\", h)\n\tos.Getenv(\"PORT\")\n}\n"),
    ("c/app.py", "import os, sys\nfrom .models import User\nLIMIT = 5\nclass User(Base):\n    name = Column(String)\n    def save(self):\n        pass\n@app.route('/items/<int:item_id>')\ndef items():\n    return os.environ['SECRET']\n"),
    ("d/.env", "PORT=80\nexport TOKEN=x\n"),
    ("e/schema.prisma", "model Post {\n  id Int @id\n  tags Tag[]\n}\n"),
    ("f/lib.rs", "pub struct P {\n}\nimpl P {\n    pub fn go(&self) {}\n}\npub trait T {}\nfn free() {}\n"),
    ("g/A.java", "@RestController\n@RequestMapping(\"/api\")\npublic class A {\n    private String name;\n    @GetMapping(\"/x/{id}\")\n    public String x(int id) {\n        return \"\";\n    }\n}\n"),
]


def source(spark):
    df = spark.createDataFrame(FILES, "path string, content string")
    return df.withColumn("language", files.language(F.col("path")))


def test_skeletons(spark):
    got = {(r.path[0], r.kind, r.name, r.container) for r in extract.skeleton(source(spark)).collect()}
    want = {("a", "class", "UserController", ""), ("a", "method", "find", "UserController"), ("a", "interface", "User", ""), ("a", "enum", "Role", ""), ("a", "function", "add", ""), ("b", "struct", "Store", ""), ("b", "method", "Save", "Store"), ("b", "function", "main", ""), ("c", "class", "User", ""), ("c", "method", "save", "User"), ("c", "function", "items", ""), ("c", "constant", "LIMIT", ""), ("f", "struct", "P", ""), ("f", "method", "go", "P"), ("f", "interface", "T", ""), ("f", "function", "free", ""), ("g", "class", "A", ""), ("g", "method", "x", "A")}
    assert want <= got


def test_extractors(spark):
    s = source(spark)
    assert {(r.path[0], r.module, r.kind) for r in extract.imports(s).collect()} == {("a", "./x", "relative"), ("a", "react", "package"), ("a", "../y", "relative"), ("b", "fmt", "package"), ("b", "os", "package"), ("c", "os", "package"), ("c", "sys", "package"), ("c", ".models", "relative")}
    assert {(r.method, r.route, tuple(r.params)) for r in extract.api_endpoints(s).collect()} == {("GET", "/users/:id", ("id",)), ("GET", "/ping", ()), ("GET", "/items/<int:item_id>", ("item_id",)), ("GET", "/api/x/{id}", ("id",))}
    assert [(r.topic, r.role) for r in extract.message_handlers(s).collect()] == [("user.created", "producer")]
    assert {(r.name, r.source) for r in extract.config_variables(s).collect()} == {("DB_URL", "process_env"), ("PORT", "getenv"), ("SECRET", "environ"), ("TOKEN", "env_file")}
    assert {(r.model, r.field, r.type) for r in extract.schema_fields(s).collect()} == {("Post", "id", "Int"), ("Post", "tags", "Tag[]"), ("Store", "Name", "string"), ("User", "name", "String")}
    assert {(r.name, r.kind, tuple(r.members)) for r in extract.ts_types(s).collect()} == {("User", "interface", ("id", "name")), ("Role", "enum", ("Admin", "Guest"))}
    p = spark.createDataFrame([("a: int, b?: string, c = 5",)], "t string").select(extract.parameters(F.col("t")).alias("p")).first().p
    assert [tuple(x) for x in p] == [("a", "int", False, ""), ("b", "string", True, ""), ("c", "", True, "5")]


def test_project_files(spark, tmp_path):
    for name, body in [("src/a.py", "x"), ("node_modules/b.js", "x"), (".git/c.py", "x"), ("d.txt", "x")]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert [r.path.rsplit("/", 1)[1] for r in files.project_files(spark, str(tmp_path)).collect()] == ["a.py"]
    (tmp_path / "dec.json").write_text('[{"id": "d1", "content": "c", "tags": ["t"], "other": 1}]')
    assert [(r.id, r.tags, r.status) for r in files.records(spark, str(tmp_path / "dec.json"), "decisions").collect()] == [("d1", ["t"], None)]
