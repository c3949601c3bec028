"""Heads of source files: a lexer over comments, strings and signs, and what stands before the first declaration.

A file is read as far as its imports go and no further. Imports may stand in one
line (``import ("a"; b "c")``), in several groups, in raw or escaped strings;
what looks like one inside a comment or string is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<end>\n|;)|(?P<raw>`[^`]*`)|(?P<text>\"(?:\\.|[^\"\\\n])*\")|(?P<rune>'(?:\\.|[^'\\\n])+')|(?P<name>[^\W\d]\w*)|(?P<blank>[^\S\n]+)|(?P<sign>.)",
    re.S,
)
# Build tags that are no reason to pass over a file.
TAGS = ("linux", "386", "darwin", "cgo")
ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"', "'": "'"}
ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|(.))", re.S)


def lex(body: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of the tokens of a file; blanks within lines are left out."""
    for m in TOKEN.finditer(body):
        if m.lastgroup != "blank":
            yield m.lastgroup, m[0]


def unquoted(literal: str) -> str:
    if literal[0] == "`":
        return literal[1:-1].replace("\r", "")

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(int(code, 16)) if code and int(code, 16) < 0x110000 else chr(int(m[4], 8)) if m[4] else ESCAPES.get(m[5] or "", m[0])

    return ESCAPE.sub(one, literal[1:-1])


def comment_text(comments: list[str]) -> str:
    """What a group of comments says, without its marks; a group with build tags says nothing."""
    lines: list[str] = []
    for c in comments:
        if c.startswith("//"):
            if "+build" in c:
                return ""
            lines.append(c[2:].removeprefix(" "))
        else:
            lines += [x.strip() for x in c[2:-2].split("\n")]
    return "\n".join(x.rstrip() for x in lines).strip()


def ignored(comments: list[str]) -> bool:
    """Whether a build tag among them is neither a known one nor a language version."""
    tags = [t.lstrip("!") for c in comments if re.match(r"//\s*\+build\s", c) for t in re.split(r"[\s,]+", c.split("+build", 1)[1].strip())]
    return any(t and t not in TAGS and not t.startswith("go") for t in tags)


class Parsed:
    """The clauses at the head of a file."""

    def __init__(self, body: str):
        self.name, self.doc, self.imports, self.before, self.failed = "", "", [], [], False
        self._tokens = lex(body.removeprefix("\ufeff"))
        self._clause()
        if self.name:
            self._imports()

    def _clause(self) -> None:
        """``package name`` after comments and blank lines; the comments right above it are its doc."""
        group: list[str] = []
        ends = 0
        for kind, text in self._tokens:
            if kind in ("line", "block"):
                group = [*group, text] if ends <= 1 else [text]
                self.before.append(text)
                ends = 0
            elif text == "\n":
                ends += 1
            elif kind == "name" and text == "package":
                following = next(((k, t) for k, t in self._tokens if k != "block"), ("", ""))
                if following[0] == "name":
                    self.name, self.doc = following[1], comment_text(group) if ends <= 1 else ""
                return
            else:
                return

    def _imports(self) -> None:
        inside, wanted = False, False  # within brackets; after ``import``
        for kind, text in self._tokens:
            if kind in ("line", "block"):
                continue
            if kind == "end":
                wanted = wanted and inside
            elif wanted and text == "(" and not inside:
                inside = True
            elif wanted and text == ")" and inside:
                inside = wanted = False
            elif wanted and kind in ("raw", "text"):
                self.imports.append(unquoted(text))
            elif wanted and (kind == "name" or text == "."):
                continue  # the name that the import gets
            elif kind == "name" and text == "import" and not wanted:
                wanted = True
            else:
                self.failed = wanted
                return  # the first declaration ends what is read
        self.failed = inside


def header(path: str, body: str) -> dict:
    """Package name, doc comment, imports, test flag and status of a source file.

    A file with an unknown build tag above its package clause is ignored, as is
    a test file that can't be read; another that can't be read has failed.
    """
    test = path.endswith("_test.go")
    parsed = Parsed(body)
    blank = {"name": "", "description": "", "imports": [], "is_test": test}
    if ignored(parsed.before):
        return {"status": "ShouldIgnore"} | blank
    if not parsed.name or parsed.failed:
        return {"status": "ShouldIgnore" if test else "ParseFailed"} | blank
    return {"status": "ParseSuccess", "name": parsed.name, "description": parsed.doc, "imports": parsed.imports, "is_test": test}


HEADER = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("status", "name", "description")] + [T.StructField("imports", T.ArrayType(T.StringType())), T.StructField("is_test", T.BooleanType())]
)


@F.pandas_udf(HEADER)
def parse_header(path: pd.Series, body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header(p or "", b or "") for p, b in zip(path, body, strict=True)], columns=["status", "name", "description", "imports", "is_test"])
