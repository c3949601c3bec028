"""Markdown as text: blocks first (lists and quotes in each other, fences, headings), then what stands within lines.

Paragraphs, headings, items and code come as texts parted by blank lines. Marks,
addresses and HTML tags go; the words of links and pictures, code and entities
stay.
"""

from __future__ import annotations

import html
import re

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)$")
HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$| {0,3}#+([^\s#].*)$")
UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3}(?:[*+-]|\d{1,9}[.)]))(?:([ \t]+)(.*)|)$")
DEFINED = re.compile(r" {0,3}\[([^\]]+)\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
TABLE_RULE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$")
# spans of more characters than these are not looked for, so that a text of opening marks takes linear time
CODE = re.compile(r"(?<!`)(`+)(?!`)(.{1,2000}?)(?<!`)\1(?!`)", re.S)
ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
TARGET = r"\([^()\s]*(?:\([^()]*\)[^()\s]*)*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)"
PICTURE = re.compile(rf"!\[([^\[\]]*)\](?:{TARGET}|\[([^\]]*)\])?")
LINK = re.compile(rf"\[([^\[\]]*)\](?:{TARGET}|\[([^\]]*)\])?")
ADDRESS = re.compile(r"<([a-zA-Z][a-zA-Z0-9+.-]*:[^\s<>]*|[^\s<>@]+@[^\s<>@]+)>")
TAG = re.compile(r"<!--.{0,2000}?-->|</?[a-zA-Z][^<>]{0,2000}>", re.S)
STRONG = re.compile(r"(\*{2,3}|_{2,3})(?=\S)(.{1,1000}?)(?<=\S)\1", re.S)
WEAK = re.compile(r"(?<![\w*])\*(?=[^\s*])(.{1,1000}?)(?<=[^\s*])\*(?!\*)|(?<![\w_])_(?=[^\s_])(.{1,1000}?)(?<=[^\s_])_(?![\w_])|~~(?=\S)(.{1,1000}?)(?<=\S)~~", re.S)


def within(text: str, known: set[str]) -> str:
    """A paragraph without its marks; ``known`` are the names that links may refer to."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x01"

    text = text.replace("\x00", "").replace("\x01", "")
    text = CODE.sub(lambda m: keep(re.sub(r"\s+", " ", m[2]).strip()), text)
    text = ESCAPE.sub(lambda m: keep(m[1]), text)
    text = ADDRESS.sub(lambda m: keep(m[1]), text)
    text = TAG.sub("", text)

    def said(m: re.Match) -> str:
        label, whole = m[1], m[0]
        if whole.endswith(")") or m[2]:
            return label
        # [words] alone, or with empty brackets, is a link if its name is defined
        return label if label.strip().lower() in known or whole.endswith("[]") else keep("[") + label + keep("]")

    for pattern in (PICTURE, LINK):
        before = None
        while before != text:  # inner ones first
            before, text = text, pattern.sub(lambda m: m[1] if m[0][0] == "!" else said(m), text)
    for pattern in (STRONG, WEAK):
        text = pattern.sub(lambda m: next(g for g in m.groups()[::-1] if g is not None), text)
    text = html.unescape(re.sub(r"[ \t]*\n[ \t]*", "\n", text))
    return re.sub("\x00(\\d+)\x01", lambda m: kept[int(m[1])], text).strip()


def dedented(line: str, n: int) -> str:
    """The line without its first ``n`` columns of blanks."""
    line = line.expandtabs(4)
    return line[min(n, len(line) - len(line.lstrip(" "))) :]


def starts_block(line: str) -> bool:
    return bool(FENCE.match(line) or HEADING.match(line) or RULE.match(line) or QUOTE.match(line) or ITEM.match(line))


def blocks(lines: list[str], known: set[str], depth: int = 0) -> list[str]:
    """The texts of the blocks of these lines, in order."""
    out: list[str] = []
    paragraph: list[str] = []

    def close() -> None:
        if paragraph:
            out.append(within("\n".join(paragraph), known))
            paragraph.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        item = ITEM.match(line) if depth < 20 else None
        if not line.strip():
            close()
        elif fence := FENCE.match(line):
            close()
            start = i
            mark = fence[1]
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i]):
                i += 1
            out.append("\n".join(lines[start:i]))
            i += 1
        elif not paragraph and (line.startswith("    ") or line.startswith("\t")):
            start = i - 1
            while i < len(lines) and (not lines[i].strip() or lines[i].startswith(("    ", "\t"))):
                i += 1
            out.append("\n".join(dedented(x, 4) for x in lines[start:i]).strip("\n"))
        elif paragraph and UNDERLINE.match(line):
            close()
        elif RULE.match(line):
            close()
        elif heading := HEADING.match(line):
            close()
            out.append(within((heading[1] or heading[2] or "").strip().rstrip("#").rstrip(), known))
        elif QUOTE.match(line) and depth < 20:
            close()
            inside = [QUOTE.sub("", line, count=1)]
            # lines of a paragraph may go on without the mark
            while i < len(lines) and (QUOTE.match(lines[i]) or (lines[i].strip() and inside[-1].strip() and not starts_block(lines[i]))):
                inside.append(QUOTE.sub("", lines[i], count=1))
                i += 1
            out += blocks(inside, known, depth + 1)
        elif item and not (paragraph and not (item[3] or "").strip()):
            close()
            width = len(item[1].expandtabs(4)) + (len(item[2].expandtabs(4)) if item[2] and len(item[2]) < 5 else 1)
            inside = [item[3] or ""]
            while i < len(lines):
                x = lines[i]
                indent = len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip(" "))
                if not x.strip():
                    inside.append("")
                elif indent >= width or (indent >= 2 and ITEM.match(x.lstrip()) and indent > len(item[1]) - 2):
                    inside.append(dedented(x, width))
                elif inside[-1].strip() and not starts_block(x):
                    inside.append(x.lstrip())
                else:
                    break
                i += 1
            out += blocks(inside, known, depth + 1)
        elif DEFINED.match(line) and not paragraph:
            pass
        elif TABLE_RULE.match(line):
            pass
        elif line.lstrip().startswith("<!--"):
            while "-->" not in line and i < len(lines):
                line = lines[i]
                i += 1
            rest = line.split("-->", 1)[1] if "-->" in line else ""
            if rest.strip():
                paragraph.append(rest.strip())
        else:
            hard = line.rstrip()
            paragraph.append((hard[:-1] if hard.endswith("\\") else hard).strip().strip("|").strip() if hard.lstrip().startswith("|") else (hard[:-1] if hard.endswith("\\") else hard).strip())
    close()
    return [x for x in out if x]


def text_of(markdown: str) -> str:
    """The text of a Markdown file: blocks parted by blank lines."""
    lines = markdown.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    known = {m[1].strip().lower() for x in lines if (m := DEFINED.match(x))}
    return "\n\n".join(blocks(lines, known))
