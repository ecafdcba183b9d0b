"""Structure of source files.

Rows of path, language, content become rows of what is declared in them. Declarations are read from statements (see
`lexer`), so that strings, comments and breaks within brackets don't count: patterns are tables of (kind, expression
with the name as its first group) for each language, and a member belongs to the type whose block it stands in. Routes,
topics, settings and model fields go by line patterns in built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from cairnlore.operators.lexer import GROUPS, SCRIPT, each_file, statements
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_VIS = r"(?:(?:public|private|protected|internal|fileprivate|static|final|abstract|override|open|sealed|virtual|async|export|default|declare|inline|suspend|data|case|partial|readonly|unsafe|const|constexpr|explicit|synchronized|volatile|transient|native|required|convenience|mutating|lateinit|operator|implicit|lazy|weak|pub(?:\([a-z]+\))?)\s+)*"
#: What may stand before a declaration: annotations, attributes, template heads, access labels; then modifiers.
_H = r"^(?:@(?!interface\b)[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\s+|\#?\[[^\]]*\]\s*|template\s*<[^{}]*?>\s*(?=class|struct|\w+[\w:<>*& ]*\()|(?:public|private|protected)\s*:\s*)*" + _VIS
_TYPED = r"(?!(?:return|new|else|throw|using|typedef|package|import|goto|delete)\b)[\w:.<>\[\],?*& \\]*[\w>\]?*&]"
#: language: (kind, pattern) of types, of what stands directly in them, and of what stands at the top or in a namespace.
TYPES: dict[str, list[tuple[str, str]]] = {
    "typescript": [("class", rf"{_H}class\s+(\w+)"), ("interface", rf"{_H}interface\s+(\w+)"), ("enum", rf"{_H}enum\s+(\w+)"), ("type", rf"{_H}type\s+(\w+)[^=]*="), ("namespace", rf"{_H}(?:namespace|module)\s+([\w.]+)\s*\{{")],
    "go": [("struct", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type", r"^type\s+(\w+)\s+\S")],
    "python": [("class", r"^class\s+(\w+)")],
    "rust": [("struct", rf"{_H}struct\s+(\w+)"), ("enum", rf"{_H}enum\s+(\w+)"), ("interface", rf"{_H}trait\s+(\w+)"), ("class", rf"{_H}impl(?:\s*<[^>]*>)?\s+(?:[\w:<>', ]+\s+for\s+)?&?(\w+)"), ("type", rf"{_H}type\s+(\w+)[^=]*="), ("namespace", rf"{_H}mod\s+(\w+)\s*\{{")],
    "java": [("class", rf"{_H}(?:class|record)\s+(\w+)"), ("interface", rf"{_H}@?interface\s+(\w+)"), ("enum", rf"{_H}enum\s+(\w+)")],
    "kotlin": [("class", rf"{_H}(?:enum\s+|annotation\s+|inner\s+|companion\s+)*(?:class|object)\s+(\w+)"), ("interface", rf"{_H}(?:fun\s+)?interface\s+(\w+)")],
    "ruby": [("class", r"^class\s+([\w:]+)"), ("module", r"^module\s+([\w:]+)")],
    "php": [("class", rf"{_H}class\s+(\w+)"), ("interface", r"^interface\s+(\w+)"), ("class", r"^trait\s+(\w+)"), ("enum", r"^enum\s+(\w+)"), ("namespace", r"^namespace\s+([\w\\]+)\s*\{")],
    "cpp": [("class", rf"{_H}class\s+(\w+)[^;]*$"), ("struct", rf"{_H}(?:typedef\s+)?struct\s+(\w+)[^;()]*$"), ("enum", rf"{_H}enum\s+(?:class\s+|struct\s+)?(\w+)"), ("namespace", r"^(?:inline\s+)?(?:namespace\s*([\w:]*)|extern\s+\"[^\"]*\")\s*\{")],
    "swift": [("class", rf"{_H}(?:class|actor)\s+(?!func\b|var\b)(\w+)"), ("struct", rf"{_H}struct\s+(\w+)"), ("interface", rf"{_H}protocol\s+(\w+)"), ("enum", rf"{_H}(?:indirect\s+)?enum\s+(\w+)"), ("class", rf"{_H}extension\s+(\w+)")],
    "scala": [("class", rf"{_H}class\s+(\w+)"), ("object", rf"{_H}object\s+(\w+)"), ("interface", rf"{_H}trait\s+(\w+)")],
}
MEMBERS: dict[str, list[tuple[str, str]]] = {
    "typescript": [("constructor", rf"{_H}(constructor)\s*\("), ("method", rf"{_H}(?:get\s+|set\s+)?\*?(#?[\w$]+)\??\s*(?:<[^()]*>)?\s*\("), ("property", rf"{_H}(?:accessor\s+)?(#?[\w$]+)[?!]?\s*(?:[:=;]|$)")],
    "python": [("constructor", r"^def\s+(__init__)\b"), ("method", r"^(?:async\s+)?def\s+(\w+)")],
    "rust": [("method", rf"{_H}(?:extern\s+\S+\s+)?fn\s+(\w+)")],
    "java": [("constructor", rf"{_H}(?:<[^()]*>\s*)?([A-Z]\w*)\s*\("), ("method", rf"{_H}{_TYPED}\s+(\w+)\s*\("), ("property", rf"{_H}{_TYPED}\s+(\w+)\s*(?:[;=,{{]|$)")],
    "kotlin": [("constructor", rf"{_H}(constructor)\s*\("), ("method", rf"{_H}fun\s+(?:<[^>]*>\s*)?(\w+)"), ("property", rf"{_H}va[lr]\s+(\w+)")],
    "ruby": [("constructor", r"^def\s+(initialize)\b"), ("method", r"^def\s+(?:self\.)?(\w+[?!=]?)"), ("property", r"^attr_\w+\s+:(\w+)")],
    "php": [("constructor", rf"{_H}function\s+(__construct)\b"), ("method", rf"{_H}function\s+&?(\w+)"), ("property", rf"{_H}(?:var\s+)?(?:[?\w\\|]+\s+)?\$(\w+)")],
    "cpp": [("constructor", rf"{_H}(~?[A-Z]\w*)\s*\("), ("method", rf"{_H}{_TYPED}[\s*&]+(\w+)\s*\("), ("property", rf"{_H}{_TYPED}[\s*&]+(\w+)\s*(?:\[[^\]]*\]\s*)*[;={{]")],
    "swift": [("constructor", rf"{_H}(init)[?!]?\s*[(<]"), ("method", rf"{_H}(?:class\s+)?func\s+(\w+)"), ("property", rf"{_H}(?:class\s+)?(?:let|var)\s+(\w+)")],
    "scala": [("method", rf"{_H}def\s+(\w+)"), ("property", rf"{_H}va[lr]\s+(\w+)")],
}
FREE: dict[str, list[tuple[str, str]]] = {
    "typescript": [("function", rf"{_H}function\s*\*?\s*(\w+)"), ("function", rf"{_H}(?:const\s+|let\s+|var\s+)?(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\(.*\)|\w+)\s*(?::[^=]+)?=>")],
    "go": [("function", r"^func\s+(\w+)\s*[\[(]"), ("method", r"^func\s+\([^)]*\)\s+(\w+)\s*\("), ("constant", r"^const\s+(\w+)")],
    "python": [("function", r"^(?:async\s+)?def\s+(\w+)"), ("constant", r"^([A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=(?!=)")],
    "rust": [("function", rf"{_H}(?:extern\s+\S+\s+)?fn\s+(\w+)"), ("constant", rf"{_H}(?:static\s+)?(\w+)\s*:[^=]+=")],
    "kotlin": [("function", rf"{_H}fun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?(\w+)")],
    "ruby": [("function", r"^def\s+(\w+[?!]?)")],
    "php": [("function", r"^function\s+&?(\w+)")],
    "cpp": [("method", rf"{_H}{_TYPED}[\s*&]+\w+::(~?\w+)\s*\(.*\{{$"), ("method", r"^\w+::(~?\w+)\s*\(.*\{$"), ("function", rf"{_H}{_TYPED}[\s*&]+(\w+)\s*\(.*\{{$")],
    "swift": [("function", rf"{_H}func\s+(\w+)")],
    "scala": [("function", rf"{_H}def\s+(\w+)")],
}
#: Languages that are read by another one's patterns, and what C# has besides.
_STRUCT, _NAMESPACE = ("struct", rf"{_H}(?:record\s+)?struct\s+(\w+)"), ("namespace", r"^namespace\s+([\w.]+)\s*\{")
for patterns in (TYPES, MEMBERS, FREE):
    patterns["javascript"], patterns["c"] = patterns["typescript"], patterns["cpp"]
TYPES["csharp"], MEMBERS["csharp"] = [_STRUCT, _NAMESPACE, *TYPES["java"]], MEMBERS["java"]
#: Types whose methods stand outside of them: where the type's name is.
RECEIVERS = {"go": r"^func\s+\(\s*\w*\s*\*?(\w+)", "cpp": r"(\w+)::~?\w+\s*\(", "c": r"(\w+)::~?\w+\s*\("}
HOLDERS = ["class", "interface", "enum", "struct", "object", "module"]


def source_lines(files: DataFrame) -> DataFrame:
    return files.select("path", "language", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("bigint"))


def _first(patterns: list[tuple[str, re.Pattern]], code: str) -> tuple[str, str]:
    """Kind and name by the first pattern that code meets."""
    for kind, pattern in patterns:
        if m := pattern.match(code):
            return kind, m.group(1) or ""
    return "", ""


def skeleton(files: DataFrame) -> DataFrame:
    """path, language, line, kind, name, container, signature, end_line (of the block, if it opens one): types wherever
    they stand, members directly in a type, functions and constants at the top or in a namespace. Functions within
    functions are left out. Members of TypeScript interfaces are in `ts_types`. One pass over the files, no shuffle."""

    def rows_of(language: str, rows: list[list]) -> Iterator[tuple]:
        of = lambda patterns: [(kind, re.compile(p)) for kind, p in patterns.get(language, [])]
        types, members, free = of(TYPES), of(MEMBERS), of(FREE)
        heads = []
        for line, end, block, code, text, owner, _ in rows:
            group = "" if owner is None or language != "go" else rows[owner][3].removesuffix("(").strip()
            if group in GROUPS:
                code, owner = f"{group} {code}", None
            heads.append(_first(types, code))
            kind, name = heads[-1]
            held, holder = ("", "") if owner is None else heads[owner]
            if not kind and (owner is None or held == "namespace"):
                kind, name = _first(free, code)
            elif not kind and held in HOLDERS and not (held == "interface" and language in SCRIPT):
                kind, name = _first(members, code)
                kind = "" if kind == "property" and held in ("enum", "interface") else kind
            if kind in ("", "namespace"):
                continue
            outside = re.search(RECEIVERS[language], code) if language in RECEIVERS and kind == "method" and held not in HOLDERS else None
            signature = re.sub(r"\s*[{;]\s*$", "", re.sub(r"\s+", " ", text)).strip()
            yield line, kind, name, outside.group(1) if outside else holder if held in HOLDERS else "", signature, max(block, end)

    return each_file(files, rows_of, "path string, language string, line bigint, kind string, name string, container string, signature string, end_line bigint")


def skeleton_savings(original: Column, skeleton_size: Column) -> Column:
    """Share of the original saved, in whole percent."""
    return (100 - F.floor(skeleton_size * 100 / original)).cast("bigint")


def imports(files: DataFrame) -> DataFrame:
    """path, module, kind (relative, package): each module once for each file."""
    c = F.col("content")
    js = F.concat(F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:(?:import|export)\b[^'\"\n]*\bfrom|import)\s*['\"]([^'\"\n]+)['\"]"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"\b(?:require|import)\(\s*['\"]([^'\"\n]+)['\"]\s*\)"), F.lit(1)))
    block = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^import\s*\(([^)]*)\)"), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(r"\"([^\"]+)\""), F.lit(1))))
    go = F.concat(F.regexp_extract_all(c, F.lit(r"(?m)^import\s+(?:\w+\s+)?\"([^\"]+)\""), F.lit(1)), block)
    py = F.concat(F.regexp_extract_all(c, F.lit(r"(?m)^\s*from\s+(\.*[\w.]*)\s+import\b"), F.lit(1)), F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^\s*import\s+([\w., ]+)"), F.lit(1)), lambda x: F.transform(F.split(x, r"\s*,\s*"), lambda m: F.regexp_extract(F.trim(m), r"^(\S+)", 1)))))
    lang = F.col("language")
    found = F.when(lang.isin("typescript", "javascript"), js).when(lang == "go", go).when(lang == "python", py).otherwise(F.array().cast("array<string>"))
    out = files.select("path", F.explode(F.array_distinct(F.filter(found, lambda m: m != ""))).alias("module"))
    return out.withColumn("kind", F.when(F.startswith("module", F.lit(".")), "relative").otherwise("package"))


def api_endpoints(files: DataFrame) -> DataFrame:
    """path, line, method, route, framework of web routes; a controller's base path is put in front."""
    lines = source_lines(files)
    verbs = "get|post|put|patch|delete|head|options|all"
    rules = [
        ("nest", rf"(?i)^\s*@({verbs})\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)", ["typescript"]),
        ("express", rf"\b(?:app|router)\.({verbs})\(\s*['\"`]([^'\"`]+)['\"`]", ["typescript", "javascript"]),
        ("gin", r"\.(GET|POST|PUT|PATCH|DELETE)\(\s*\"([^\"]*)\"", ["go"]),
        ("fastapi", rf"^\s*@\w+\.({verbs})\(\s*['\"]([^'\"]*)['\"]", ["python"]),
        ("flask", r"^\s*@\w+\.(route)\(\s*['\"]([^'\"]*)['\"]", ["python"]),
        ("spring", r"^\s*@(Get|Post|Put|Patch|Delete)Mapping\(?\s*(?:(?:value|path)\s*=\s*)?(?:\"([^\"]*)\")?", ["java", "kotlin"]),
        ("aspnet", r"^\s*\[Http(Get|Post|Put|Patch|Delete)(?:\(\"([^\"]*)\")?", ["csharp"]),
    ]
    hit = F.lit(None).cast("struct<framework:string,method:string,route:string>")
    for name, pattern, langs in reversed(rules):
        hit = F.when(F.col("language").isin(langs) & F.col("text").rlike(pattern), F.struct(F.lit(name).alias("framework"), F.upper(F.regexp_extract("text", pattern, 1)).alias("method"), F.regexp_extract("text", pattern, 2).alias("route"))).otherwise(hit)
    base = r"@(?:Controller|RequestMapping)\(\s*(?:value\s*=\s*)?['\"]([^'\"]*)['\"]|\[Route\(\"([^\"]*)\""
    bases = lines.filter(F.col("text").rlike(base)).groupBy("path").agg(F.min_by(F.concat(F.regexp_extract("text", base, 1), F.regexp_extract("text", base, 2)), "line").alias("base"))
    found = lines.withColumn("h", hit).filter("h IS NOT NULL").select("path", "line", "h.*").join(bases, "path", "left")
    joined = F.array_join(F.filter(F.transform(F.array(F.when(F.col("framework").isin("nest", "spring", "aspnet"), F.coalesce("base", F.lit(""))).otherwise(F.lit("")), F.col("route")), lambda x: F.regexp_replace(x, "^/+|/+$", "")), lambda x: x != ""), "/")
    method = F.when(F.col("method") == "ROUTE", "GET").otherwise(F.col("method"))
    route = F.concat(F.lit("/"), joined)
    params = F.concat(F.regexp_extract_all(route, F.lit(r"(?<=/):(\w+)"), F.lit(1)), F.regexp_extract_all(route, F.lit(r"\{(\w+)"), F.lit(1)), F.regexp_extract_all(route, F.lit(r"<(?:\w+:)?(\w+)>"), F.lit(1)))
    return found.select("path", "line", method.alias("method"), route.alias("route"), "framework", params.alias("params"))


def message_handlers(files: DataFrame) -> DataFrame:
    """path, line, topic, role (consumer, producer) of message topics."""
    consume, produce = r"(?:@(?:MessagePattern|EventPattern|KafkaListener)\(\s*(?:topics\s*=\s*)?|\.subscribe\(\s*(?:\{\s*topic:\s*)?)['\"]([^'\"]+)['\"]", r"(?:\.emit\(\s*|\.send\(\s*(?:\{\s*topic:\s*)?|\.produce\(\s*)['\"]([^'\"]+)['\"]"
    role = F.when(F.col("text").rlike(consume), "consumer").when(F.col("text").rlike(produce), "producer")
    topic = F.when(role == "consumer", F.regexp_extract("text", consume, 1)).otherwise(F.regexp_extract("text", produce, 1))
    return source_lines(files).select("path", "line", topic.alias("topic"), role.alias("role")).filter("role IS NOT NULL")


def config_variables(files: DataFrame) -> DataFrame:
    """name, path, line, source of configuration variables; the first place of each name in order of path and line."""
    rules = [("env_file", r"^\s*(?:export\s+)?([A-Z][A-Z0-9_]*)\s*="), ("process_env", r"process\.env(?:\.|\[['\"])([A-Z][A-Z0-9_]*)"), ("getenv", r"os\.(?:Getenv|LookupEnv|getenv)\(\s*['\"]([A-Za-z_]\w*)"), ("environ", r"os\.environ(?:\.get\(|\[)\s*['\"]([A-Za-z_]\w*)"), ("viper", r"viper\.Get\w*\(\s*\"([^\"]+)\""), ("tag", r"`[^`]*\benv:\"([A-Za-z_]\w*)")]
    hit = F.lit(None).cast("struct<source:string,name:string>")
    for name, pattern in reversed(rules):
        where = F.col("text").rlike(pattern) & (F.col("path").rlike(r"(^|/)\.env[^/]*$") == F.lit(name == "env_file"))
        hit = F.when(where, F.struct(F.lit(name).alias("source"), F.regexp_extract("text", pattern, 1).alias("name"))).otherwise(hit)
    found = source_lines(files).withColumn("h", hit).filter("h IS NOT NULL")
    return found.groupBy(F.col("h.name").alias("name")).agg(F.min(F.struct("path", "line", F.col("h.source").alias("source"))).alias("m")).select("name", "m.*")


def schema_fields(files: DataFrame) -> DataFrame:
    """path, model, field, type, flavour of models: Prisma, gorm or db tags, SQLAlchemy and Django, JPA, TypeORM."""
    begin = {"prisma": r"^\s*model\s+(\w+)\s*\{", "go": r"^type\s+(\w+)\s+struct\b", "python": r"^class\s+(\w+)\(.*(?:Base|Model)\b.*\)", "java": r"^\s*(?:public\s+)?class\s+(\w+)", "typescript": r"^\s*(?:export\s+)?class\s+(\w+)"}
    field = {"prisma": r"^\s+(\w+)\s+(\w+(?:\[\])?\??)", "go": r"^\s+(\w+)\s+([\w.*\[\]]+)\s+`[^`]*(?:gorm|db):", "python": r"^\s+(\w+)\s*=\s*(?:\w+\.)?(?:Column\(\s*(?:\w+\.)?|models\.)(\w+)", "java": r"^\s+private\s+([\w<>]+)\s+(\w+)\s*;", "typescript": r"^\s+(\w+)[?!]?:\s*([\w\[\]]+);"}
    lang = F.when(F.col("path").endswith(".prisma"), "prisma").otherwise(F.col("language"))
    lines = source_lines(files).withColumn("language", lang)
    model = field_name = kind = F.lit(None).cast("string")
    for k in begin:
        here = F.col("language") == k
        model = F.when(here & F.col("text").rlike(begin[k]), F.regexp_extract("text", begin[k], 1)).otherwise(model)
        a, b = (2, 1) if k == "java" else (1, 2)
        is_field = here & F.col("text").rlike(field[k]) & ~F.col("text").rlike(begin[k])
        field_name = F.when(is_field, F.regexp_extract("text", field[k], a)).otherwise(field_name)
        kind = F.when(is_field, F.regexp_extract("text", field[k], b)).otherwise(kind)
    marked = F.col("content").rlike(r"@Entity|@Table|gorm:|db:\"|Column\(|models\.|model\s+\w+\s*\{")
    w = W.partitionBy("path").orderBy("line")
    out = lines.join(files.filter(marked).select("path"), "path", "left_semi")
    out = out.withColumns({"m": model, "field": field_name, "type": kind}).withColumn("model", F.last("m", ignorenulls=True).over(w))
    return out.filter("field IS NOT NULL AND model IS NOT NULL").select("path", "model", "field", "type", F.col("language").alias("flavour"))


def ts_types(files: DataFrame) -> DataFrame:
    """path, name, kind, members, fields of TypeScript interfaces, types with a body and enums, by place: names of the
    members, and name, optional, type (of an enum: value) of each. A type within a type is text of its field; index
    signatures have no name and are left out."""
    kinds = [p for p in TYPES["typescript"] if p[0] in ("interface", "type", "enum")]

    def kind_of(code: Column) -> Column:
        out = F.lit(None).cast("struct<kind:string,name:string>")
        for kind, pattern in reversed(kinds):
            out = F.when(code.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(code, pattern, 1).alias("name"))).otherwise(out)
        return out

    s = statements(files.filter(F.col("language").isin(*SCRIPT))).withColumns({"a": kind_of(F.col("code")), "o": kind_of(F.col("owner"))})
    bare = F.regexp_replace(F.regexp_replace("text", r"\s+", " "), r"[;, ]+$", "")
    pattern = r"^(?:readonly )?(?:[-+]readonly )?['\"]?([\w$]+)['\"]?(\??) ?(.*)$"
    rest = F.regexp_extract(bare, pattern, 3)
    field = F.struct("seq", F.regexp_extract(bare, pattern, 1).alias("name"), (F.regexp_extract(bare, pattern, 2) == "?").alias("optional"), F.trim(F.regexp_replace(rest, "^[:=] ?", "")).alias("type"))
    heads = s.filter(F.col("a").isNotNull() & F.col("code").endswith("{")).select("path", F.col("seq").alias("at"), "a.*", F.lit(None).cast("struct<seq:bigint,name:string,optional:boolean,type:string>").alias("f"))
    inside = s.filter(F.col("o").isNotNull()).select("path", F.col("owner_seq").alias("at"), "o.*", field.alias("f")).filter("f.name != ''")
    by = heads.unionByName(inside).groupBy("path", "at", "kind", "name").agg(F.array_sort(F.collect_list("f")).alias("f"))
    fields = F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["optional"].alias("optional"), x["type"].alias("type")))
    return by.select("path", "name", "kind", F.col("f.name").alias("members"), fields.alias("fields"))


def parameters(text: Column) -> Column:
    """array<struct<name, type, optional, default>> of a parameter list such as `a: int, b?: string = "x"`."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"^\.{0,3}(\w+)", 1).alias("name"),
            F.trim(F.regexp_extract(p, r":\s*([^=]+)", 1)).alias("type"),
            (p.rlike(r"^\w+\?") | p.contains("=")).alias("optional"),
            F.trim(F.regexp_extract(p, r"=\s*(.+)$", 1)).alias("default"),
        ),
    )


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, href, n: the targets of a page's links."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(F.col(key), F.explode(found).alias("href")).groupBy(key, "href").agg(F.count("*").alias("n"))


def page_outline(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, tag, content of titles and headings without markup inside."""
    def of(t):
        contents = F.regexp_extract_all(F.col(html), F.lit(rf"<{t}(?:\s[^>]*)?>([^<]*)</{t}>"), F.lit(1))
        return F.transform(contents, lambda x: F.struct(F.lit(t).alias("tag"), F.trim(x).alias("content")))

    found = F.concat(*map(of, ("title", "h1", "h2", "h3")))
    return pages.select(F.col(key), F.explode(found).alias("x")).select(key, "x.*")


def script_variables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, name, n: variables that a page's scripts declare with a value."""
    bodies = F.array_join(F.regexp_extract_all(F.col(html), F.lit("(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    names = F.regexp_extract_all(bodies, F.lit(r"\b(?:var|let|const)\s+(\w+)\s*="), F.lit(1))
    return pages.select(F.col(key), F.explode(names).alias("name")).groupBy(key, "name").agg(F.count("*").alias("n"))


def script_statements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text, n: statements of a page's scripts, without comments."""
    bodies = F.regexp_extract_all(F.col(html), F.lit("(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    scripts = pages.select(F.col(key).cast("string").alias("path"), F.lit("javascript").alias("language"), F.explode(bodies).alias("content"))
    kind = pages.schema[key].dataType
    return statements(scripts).groupBy(F.col("path").cast(kind).alias(key), "text").agg(F.count("*").alias("n"))
