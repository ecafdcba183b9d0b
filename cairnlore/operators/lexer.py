"""Statements of source files: where each begins and ends, what block it opens and whose block it stands in.

Files (path, language, content) go through tasks in Arrow batches, each file once from front to back with a stack of its
open brackets; nothing is shuffled. A statement is given as `code`, with what strings hold blanked and comments left
out, so that patterns over it can't be misled, and as `text`, with strings kept. Line breaks within brackets don't end
a statement. Empty and null contents have no statements. Brackets that don't match are passed over; a block that isn't
closed ends with its file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

STATEMENT = "path string, language string, seq bigint, line bigint, end_line bigint, block_end bigint, code string, text string, owner string, owner_seq bigint"
#: Rows given back at once.
ROWS = 20_000
INDENTED = ("python", "ruby")
#: Languages whose statements go on after a line break until `;`, `{` or `}`.
FREE_FORM = ("java", "csharp", "cpp", "c", "php")
SCRIPT = ("typescript", "javascript")
#: Words before a group of Go's declarations.
GROUPS = ("type", "const", "var")
NESTED_COMMENTS = ("rust", "kotlin", "scala", "swift")
_CONTINUES = re.compile(r"\s*(?:\{|(?:extends|implements|where|throws)\b|=>|[|&?:]|\.(?!\.))")
#: Code so far that may be annotations alone.
_MARKED = re.compile(r"[)\]]\s*\Z|\A\s*@(?!interface\b)[\w.]+\s*\Z")
_LISTS = re.compile(r"\b(?:enum|interface|type|struct)\b")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)
_COMMENT_MARK = re.compile(r"/\*|\*/")


@lru_cache(maxsize=None)
def _tokens(language: str) -> re.Pattern:
    """What can't be passed over in a language: comments, strings, brackets, ends of statements."""
    comments = [r"\#(?!\[)[^\n]*"] if language in (*INDENTED, "php") else []
    comments += [r"(?<![^\n])[ \t]*\#(?:[^\n\\]|\\.)*"] if language in ("c", "cpp", "csharp") else []
    comments += [] if language in INDENTED else [r"//[^\n]*", r"/\*" if language in NESTED_COMMENTS else r"/\*.*?(?:\*/|\Z)"]
    strings = [r'"""(?:\\.|[^\\])*?(?:"""|\Z)'] if language in ("python", "java", "kotlin", "scala", "swift") else []
    strings += {"python": [r"'''(?:\\.|[^\\])*?(?:'''|\Z)"], "go": [r"`[^`]*(?:`|\Z)"], "rust": [r'\br(\#*)".*?(?:"\1|\Z)'.replace(r"(\#*)", r"(?P<hashes>\#*)").replace(r"\1", "(?P=hashes)")], "csharp": [r'@\$?"(?:""|[^"])*(?:"|\Z)']}.get(language, [])
    if language in SCRIPT:
        strings.append(r"(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
    strings.append(r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)')
    strings.append(r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)" if language in (*INDENTED, *SCRIPT, "php") else r"'(?:\\[^\n']{1,9}|\\'|[^'\\\n])'")
    return re.compile(rf"(?P<comment>{'|'.join(comments)})|(?P<string>{'|'.join(strings)})|(?P<mark>[`(){{}}\[\];,\n])", re.S)


def _nested_end(content: str, pos: int) -> int:
    """Where a comment ends that can hold others."""
    depth = 0
    for m in _COMMENT_MARK.finditer(content, pos):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return m.end()
    return len(content)


class _Reader:
    """One file's statements: pieces are added until `end` makes them a row."""

    def __init__(self, content: str, language: str):
        self.content, self.language, self.rows, self.stack, self.line = content, language, [], [], 1
        self._clear()

    def _clear(self):
        self.code, self.text, self.first, self.last, self.start, self.indent = [], [], "", "", None, 0

    def add(self, code: str, text: str, at: int):
        bare = code.strip()
        if bare and self.start is None:
            self.start, self.first = self.line, bare[0]
            self.indent = at + len(code) - len(code.lstrip()) - self.content.rfind("\n", 0, at) - 1
        if bare:
            self.last = (self.last + bare)[-2:]
        self.code.append(code)
        self.text.append(text)

    def owner(self) -> int | None:
        return self.stack[-1][1] if self.stack else None

    def end(self) -> int | None:
        """The pending pieces as a row; its number, or None if there was nothing but blanks."""
        number = None
        if self.start is not None:
            number = len(self.rows)
            self.rows.append([self.start, self.line, self.line, "".join(self.code).strip(), "".join(self.text).strip(), self.owner(), self.indent])
        self._clear()
        return number

    def opens_block(self) -> bool:
        """A brace after `)` or `=>` begins a block; else it does unless it stands within an expression."""
        if self.language in INDENTED:
            return False
        inside = bool(self.stack) and not self.stack[-1][2]
        return self.last.endswith((")", "=>")) or (not inside and not self.last.endswith((":", ",", "?", "|", "&", "<")))

    def opens_group(self) -> bool:
        """Go's declarations in parentheses are a block."""
        return self.language == "go" and "".join(self.code).strip() in GROUPS

    def template(self, pos: int) -> int:
        """A template string from pos to its end or to its next embedded expression."""
        stop = _TEMPLATE.match(self.content, pos).end()
        piece = self.content[pos : stop + (2 if self.content.startswith("${", stop) else 1)]
        self.add(" " * (len(piece) - 1) + piece[-1:], piece, pos)
        self.line += piece.count("\n")
        if piece.endswith("${"):
            self.stack.append(("}", self.owner(), False, "template"))
        return pos + len(piece)

    def close(self, bracket: str, pos: int) -> int:
        """A closing bracket; pos is the place after it."""
        if bracket == "}" and any(s[0] == "}" for s in self.stack):
            while self.stack[-1][0] != "}":
                self.stack.pop()
        elif not self.stack or self.stack[-1][0] != bracket:
            return pos
        if self.stack[-1][2]:
            self.end()
            number = self.stack.pop()[3]
            if number is not None:
                self.rows[number][2] = self.line
            return pos
        kind = self.stack.pop()[3]
        self.add(bracket, bracket, pos - 1)
        return self.template(pos) if kind == "template" else pos

    def broken(self, pos: int):
        """A line break; pos is the place after it."""
        inside = bool(self.stack) and not self.stack[-1][2]
        if self.language in FREE_FORM:
            goes_on = not (self.first == "#" or (self.first in ("@", "[") and _CONTINUES.match(self.content, pos) is None and _MARKED.search("".join(self.code))))
        elif self.language in INDENTED:
            goes_on = self.last.endswith("\\")
        else:
            goes_on = self.last.endswith(("=", ",", "|", "&")) or (self.start is not None and not self.last.endswith(";") and _CONTINUES.match(self.content, pos) is not None)
        if inside or goes_on:
            self.add(" ", "\n", pos - 1)
        else:
            self.end()
        self.line += 1

    def mark(self, t: str, pos: int) -> int:
        """One bracket, separator or line break; pos is the place after it."""
        if t == "\n":
            self.broken(pos)
        elif t in ")}]":
            return self.close(t, pos)
        elif (t == "{" and self.opens_block()) or (t == "(" and self.opens_group()):
            self.add(t, t, pos - 1)
            listed = t == "{" and _LISTS.search("".join(self.code)) is not None
            owner, number = self.owner(), self.end()
            self.stack.append(("}" if t == "{" else ")", owner if number is None else number, True, number, listed))
        else:
            self.add(t, t, pos - 1)
            if t in "({[":
                self.stack.append(({"(": ")", "{": "}", "[": "]"}[t], self.owner(), False, None))
            elif t == "`" and self.language in SCRIPT:
                return self.template(pos)
            elif (t == ";" and (not self.stack or self.stack[-1][2])) or (t == "," and self.stack and self.stack[-1][2] and self.stack[-1][4]):
                self.end()
        return pos

    def read(self) -> list[list]:
        tokens, pos = _tokens(self.language), 0
        while m := tokens.search(self.content, pos):
            before, t, at, pos = self.content[pos : m.start()], m.group(), m.start(), m.end()
            self.add(before, before, at - len(before))
            if m.group("mark"):
                pos = self.mark(t, pos)
                continue
            if m.group("string") is not None:
                self.add(t[0] + " " * (len(t) - 2) + t[-1:] * (len(t) > 1), t, at)
            else:
                pos = _nested_end(self.content, at) if t == "/*" else pos
                t = self.content[at:pos]
                self.add(" ", " ", at)
            self.line += t.count("\n")
        self.add(self.content[pos:], self.content[pos:], pos)
        self.end()
        for s in self.stack:
            if s[2] and s[3] is not None:
                self.rows[s[3]][2] = self.line
        return _indented(self.rows, self.language) if self.language in INDENTED else self.rows


def _indented(rows: list[list], language: str) -> list[list]:
    """Owners and ends of blocks by indentation; a closing word belongs to the block it closes."""
    stack: list[int] = []
    for i, row in enumerate(rows):
        while stack and rows[stack[-1]][6] >= row[6]:
            closed = stack.pop()
            closes = language == "ruby" and row[3] == "end" and rows[closed][6] == row[6]
            rows[closed][2] = row[1] if closes else rows[i - 1][1]
        row[5] = stack[-1] if stack else None
        stack.append(i)
    for i in stack:
        rows[i][2] = rows[-1][1]
    return rows


def each_file(files: DataFrame, rows_of: Callable[[str, list[list]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of the schema (path, language and what `rows_of` gives for a file's language and statements), in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, out = [c.split()[0] for c in schema.split(", ")], []
        for batch in batches:
            for path, language, content in zip(batch["path"], batch["language"], batch["content"]):
                for row in rows_of(language or "", _Reader(content or "", language or "").read()):
                    out.append((path, language, *row))
                    if len(out) >= ROWS:
                        yield _frame(out, columns)
                        out = []
        yield _frame(out, columns)

    return files.select("path", "language", "content").mapInPandas(run, schema)


def statements(files: DataFrame) -> DataFrame:
    """path, language, seq, line, end_line, block_end (of the block it opens, else end_line), code, text, owner (code
    of the statement whose block it stands in, empty at the top) and owner_seq of each statement, in the files' order."""

    def rows_of(language: str, rows: list[list]) -> Iterator[tuple]:
        for seq, (line, end, block, code, text, owner, _) in enumerate(rows):
            yield seq, line, end, max(block, end), code, text, "" if owner is None else rows[owner][3], owner

    return each_file(files, rows_of, STATEMENT)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({"owner_seq": "Int64"}) if "owner_seq" in columns else frame
