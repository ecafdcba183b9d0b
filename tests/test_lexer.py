"""Statements and structure of source files, on fixtures of our own."""

import random

import pytest
from cairnlore.operators import extract, lexer, project

SOURCES = {
    "a.ts": """import { a } from "x";
@Injectable({ scope: "}" })
export class Foo<T>
  extends Bar {
  private readonly a: Map<string, number> = new Map(); // class No {
  b?: string
  constructor(
    private readonly s: Svc,
    b = "}",
  ) {
    super({ x: 1 });
    this.re = /[{]/g;
  }
  async go(a: { x: number }, cb: () => void): Promise<{ y: string }> {
    const t = `a ${b ? `}` : "{"} {`;
    if (a) { return { y: t }; }
  }
  @Input() name = 'x';
}
interface User { id: string; tags: { a: number, b: string }; readonly f?: (x: number) => void }
export enum Role { Admin = "a,b", Guest }
type P = {
  q: string,
  r?: {
    s: number
  }
}
type Q = string | number
export const add = (a: number) => a + 1
namespace N { export function inner() { function no() {} } }
/* function gone() { */
""",
    "b.py": '''class A(B):
    """class X:
    def no(self)"""
    def __init__(self,
                 a="{", b=(1,
                 2)):  # class C:
        if a:
            pass

    @property
    def y(self): return {
        "a": 1}
LIMIT = 3
def f():
    def no():
        pass
    return 1
''',
    "c.java": """package x;
@Entity
@Table(name = "t;{")
public class A<T extends B>
{
    private int x = 1;
    /* class Z { */
    public A(int x) { this.x = x; }
    @Override public List<String> go(
        int a)
        throws X
    {
        char c = '{';
        Runnable r = () -> { foo(); };
        return null;
    }
    interface In { void f(); }
}
""",
    "d.rs": "/* a /* b */ struct No { */\npub struct P<'a> { x: &'a str }\nimpl<'a> P<'a> {\n    pub async fn go(&self) -> char { r#\"}\"#; '{' }\n}\nimpl Show for Q { fn show(&self) {} }\nfn free<T>() where T: X\n{\n}\npub const N: u8 = 1;\n",
    "e.cpp": "#define X {\nnamespace n {\nclass A : public B\n{\npublic:\n  A(int x);\n  virtual int size() const = 0;\nprivate:\n  int n_;\n};\n}\nint A::size() const {\n  return '}';\n}\nstatic void run(int a,\n    int b) {\n}\n",
    "f.go": "package m\n\ntype S struct {\n\tA string `json:\"}\"`\n}\n\nfunc (s *S) Do(a int) error {\n\tx := `func no() {`\n\treturn nil\n}\n\nfunc Top[T any](\n\ta T,\n) {\n}\n\nconst K = 1\n",
    "g.rb": "module M\n  class A\n    attr_reader :x\n    def initialize(x)\n      @x = \"class No\"\n    end\n    # def no\n    def self.go?\n    end\n  end\nend\ndef top\nend\n",
    "h.php": "<?php\nnamespace A\\B;\nclass C extends D {\n  private ?int $n = 1;\n  public function __construct() { $s = 'function no() {'; }\n  public static function go($a) { }\n}\nfunction top() { }\n",
    "i.swift": "class A: B {\n  let n = 1\n  init(x: Int) { }\n  func go() -> Int { return 1 }\n}\nextension String { func up() { } }\nprotocol P { func f() }\nfunc top() { }\n",
    "j.kt": "data class A(val x: Int) {\n  val y = \"\"\"class No {\"\"\"\n  constructor() : this(1) { }\n  fun go(): Int { return 1 }\n}\nfun String.up() { }\n",
    "k.scala": "object O {\n  val x = 1\n  def go(a: Int): Int = {\n    a\n  }\n}\ntrait T { def f: Int }\n",
    "l.cs": "namespace N\n{\n  [Serializable]\n  public class A : B\n  {\n    public int X { get; set; }\n    private string p = @\"c:\\\";\n    public A() { }\n    public async Task<int> Go(int a) { return 1; }\n  }\n  public struct S { }\n}\n",
}
EXPECTED = {
    "a.ts": [("class", "Foo", "", 3, 19), ("property", "a", "Foo", 5, 5), ("property", "b", "Foo", 6, 6), ("constructor", "constructor", "Foo", 7, 13), ("method", "go", "Foo", 14, 17), ("property", "name", "Foo", 18, 18), ("interface", "User", "", 20, 20), ("enum", "Role", "", 21, 21), ("type", "P", "", 22, 27), ("type", "Q", "", 28, 28), ("function", "add", "", 29, 29), ("function", "inner", "", 30, 30)],
    "b.py": [("class", "A", "", 1, 12), ("constructor", "__init__", "A", 4, 8), ("method", "y", "A", 11, 12), ("constant", "LIMIT", "", 13, 13), ("function", "f", "", 14, 17)],
    "c.java": [("class", "A", "", 4, 18), ("property", "x", "A", 6, 6), ("constructor", "A", "A", 8, 8), ("method", "go", "A", 9, 16), ("interface", "In", "A", 17, 17), ("method", "f", "In", 17, 17)],
    "d.rs": [("struct", "P", "", 2, 2), ("class", "P", "", 3, 5), ("method", "go", "P", 4, 4), ("class", "Q", "", 6, 6), ("method", "show", "Q", 6, 6), ("function", "free", "", 7, 9), ("constant", "N", "", 10, 10)],
    "e.cpp": [("class", "A", "", 3, 10), ("constructor", "A", "A", 5, 6), ("method", "size", "A", 7, 7), ("property", "n_", "A", 8, 9), ("method", "size", "A", 12, 14), ("function", "run", "", 15, 17)],
    "f.go": [("struct", "S", "", 3, 5), ("method", "Do", "S", 7, 10), ("function", "Top", "", 12, 15), ("constant", "K", "", 17, 17)],
    "g.rb": [("module", "M", "", 1, 11), ("class", "A", "M", 2, 10), ("property", "x", "A", 3, 3), ("constructor", "initialize", "A", 4, 6), ("method", "go?", "A", 8, 9), ("function", "top", "", 12, 13)],
    "h.php": [("class", "C", "", 3, 7), ("property", "n", "C", 4, 4), ("constructor", "__construct", "C", 5, 5), ("method", "go", "C", 6, 6), ("function", "top", "", 8, 8)],
    "i.swift": [("class", "A", "", 1, 5), ("property", "n", "A", 2, 2), ("constructor", "init", "A", 3, 3), ("method", "go", "A", 4, 4), ("class", "String", "", 6, 6), ("method", "up", "String", 6, 6), ("interface", "P", "", 7, 7), ("method", "f", "P", 7, 7), ("function", "top", "", 8, 8)],
    "j.kt": [("class", "A", "", 1, 5), ("property", "y", "A", 2, 2), ("constructor", "constructor", "A", 3, 3), ("method", "go", "A", 4, 4), ("function", "up", "", 6, 6)],
    "k.scala": [("object", "O", "", 1, 6), ("property", "x", "O", 2, 2), ("method", "go", "O", 3, 5), ("interface", "T", "", 7, 7), ("method", "f", "T", 7, 7)],
    "l.cs": [("class", "A", "", 4, 10), ("property", "X", "A", 6, 6), ("property", "p", "A", 7, 7), ("constructor", "A", "A", 8, 8), ("method", "Go", "A", 9, 9), ("struct", "S", "", 11, 11)],
}
LANGUAGES = {"ts": "typescript", "py": "python", "java": "java", "rs": "rust", "cpp": "cpp", "go": "go", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "cs": "csharp"}


def lang(path):
    return LANGUAGES[path.rsplit(".", 1)[1]]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(p, lang(p), c, 1, "x") for p, c in SOURCES.items()], "path string, language string, content string, line int, owner string")


def test_structure_of_every_language(sources):
    got = {p: [] for p in SOURCES}
    for r in extract.skeleton(sources).collect():
        got[r.path].append((r.kind, r.name, r.container, r.line, r.end_line))
    for path, want in EXPECTED.items():
        assert got[path] == want, path


def test_signatures_keep_strings(sources):
    told = {(r.path, r.name): r.signature for r in extract.skeleton(sources).collect()}
    assert told["a.ts", "constructor"] == 'constructor( private readonly s: Svc, b = "}", )'
    assert told["b.py", "__init__"] == 'def __init__(self, a="{", b=(1, 2)):'
    assert told["c.java", "go"] == "@Override public List<String> go( int a) throws X"


def test_types_within_types(sources):
    got = {r.name: (r.kind, [tuple(f) for f in r.fields]) for r in extract.ts_types(sources).collect()}
    assert got == {
        "User": ("interface", [("id", False, "string"), ("tags", False, "{ a: number, b: string }"), ("f", True, "(x: number) => void")]),
        "Role": ("enum", [("Admin", False, '"a,b"'), ("Guest", False, "")]),
        "P": ("type", [("q", False, "string"), ("r", True, "{ s: number }")]),
    }


def test_chunks_end_where_blocks_do(sources):
    chunks = {(r.path, r["name"]): r.content for r in project.semantic_chunks(sources).collect()}
    assert chunks["b.py", "y"] == '    def y(self): return {\n        "a": 1}'
    assert chunks["e.cpp", "size"].endswith("return '}';\n}") or chunks["e.cpp", "size"] == "  virtual int size() const = 0;"


def test_odd_files(spark):
    rows = [("n", "java", None), ("e", "go", ""), ("u", None, "class A {}"), ("x", "klingon", "a { b"), ("c", "java", "}}) class A { int x; "), ("s", "typescript", "const a = `${"), ("q", "python", '"""never closed'), ("m", "rust", "/* /* */ open")]
    df = spark.createDataFrame(rows, "path string, language string, content string")
    got = {(r.path, r.kind, r.name, r.end_line) for r in extract.skeleton(df).collect()}
    assert got == {("c", "class", "A", 1), ("c", "property", "x", 1)}
    assert {r.path for r in lexer.statements(df).collect()} == {"u", "x", "c", "s", "q"}
    assert extract.skeleton(df.limit(0)).count() == extract.ts_types(df.limit(0)).count() == 0


def test_groups_of_go(spark):
    text = "package m\n\ntype (\n\tA struct {\n\t\tX int\n\t}\n\tB interface {\n\t\tDo(a int)\n\t}\n\tC = string\n)\n\nconst (\n\tK = iota // (\n\tL\n)\n\nvar (\n\tv = f(1)\n)\n\nfunc Last() {\n}\n"
    df = spark.createDataFrame([("a.go", "go", text)], "path string, language string, content string")
    got = [(r.kind, r.name, r.container, r.line, r.end_line) for r in extract.skeleton(df).collect()]
    assert got == [("struct", "A", "", 4, 6), ("interface", "B", "", 7, 9), ("type", "C", "", 10, 10), ("constant", "K", "", 14, 14), ("constant", "L", "", 15, 15), ("function", "Last", "", 22, 23)]


def test_any_text_is_read_in_order():
    """Random pieces never fail; statements come in order, lie in the file, and blocks hold what they own."""
    dice = random.Random(5)
    pieces = ["{", "}", "(", ")", "[", "]", "\n", "\n  ", ";", ",", '"', "'", "`", "${", "/*", "*/", "//", "#", "=>", ":", "class A", "x", "\\", "def f", '"""', "é"]
    for language in LANGUAGES.values():
        for _ in range(300):
            text = "".join(dice.choice(pieces) + " " * dice.randrange(2) for _ in range(dice.randrange(60)))
            rows = lexer._Reader(text, language).read()
            lines = text.count("\n") + 1
            assert all(1 <= r[0] <= r[1] <= lines and r[2] <= lines for r in rows), text
            assert [r[0] for r in rows] == sorted(r[0] for r in rows), text
            assert all(r[5] is None or (r[5] < i and r[1] <= max(rows[r[5]][2], rows[r[5]][1])) for i, r in enumerate(rows)), text


@pytest.mark.parametrize("text", ["x = [" + "1, " * 400_000 + "]", "f(" * 100_000, "{" * 100_000 + "}" * 100_000, "a\n" * 300_000])
def test_long_files_take_linear_time(text):
    import time

    begin = time.time()
    for language in ("typescript", "java", "python"):
        lexer._Reader(text, language).read()
    assert time.time() - begin < 30
