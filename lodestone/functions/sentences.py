"""Sentences of readme texts: splitting, choosing what describes a package, snippets, mark-up."""

from __future__ import annotations

import html
import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import markdown
from .stem import norm_word
from .stemming import let
from .words import tokens_of

# The wording by which a sentence describes a package.
GO = r"(?:pure[- ])?go(?:lang| programming(?: language)?| language)?"
KIND = r"(?:binding|code|implementation|interface|lib|library|package|plugin|port|program|project|repository|repositorie|tool|utilitie|utility|version|wrapper)"
BASIC = r"(?:basic|helper|naive|simple|small|unofficial)"
ARTICLE, THE, THIS, OF, WILL = r"(?:an|a|the)", r"(?:this|the)", r"(?:this|it|these|they)", r"(?:of|for|to)", r"(?:will|would|shall|can|could|is going to)"
DO = r"(?:allow|analyze|contain|create|find|implement|perform|provide|wrap)"
DOING = r"(?:allow|analyz|contain|creat|find|implement|perform|provid|wrapp)ing"
BE = r"(?:is|are|be)"
DOES = rf"(?:{WILL} )?{DO}(?:s|ed|d)?"
PREFIXES = (
    "这是一个",
    "这个项目是",
    rf"(?:just )?(?:{ARTICLE} )?(?:{BASIC} )?(?:{GO} )?{KIND}s? {OF} ",
    rf"(?:(?:{THE} )?(?:{GO} )?{KIND}s? )?{DOES} ",
    rf"(?:{GO} )?(?:{BASIC} )?{KIND}s? that ",
    rf"(?:{ARTICLE} )?(?:{BASIC} )?{GO} ",
    rf"extended version of {GO}'s template {KIND}s? {OF} ",
    rf"{ARTICLE} {KIND} {DOING} ",
    rf"{THE} {KIND} (?:{WILL} )?offer(?:s|ed|d)? {ARTICLE} ",
    rf"{THE} {KIND} is designed {OF} ",
    rf"{THE} {KIND} (?:{WILL} )?allow(?:s|ed|d)? {GO} ",
    rf"{THE} goal of {THE} {KIND} is ",
    rf"{THE} {KIND} (?:can be used|allows us) to ",
    rf"{THE} {KIND} {WILL} ",
    rf"{THIS} {DO}s? ",
    rf"(?:{THIS} )?(?:{GO} )?(?:{KIND}s? )?{BE} {ARTICLE} ",
    rf"(?:just )?(?:a few|some|a set of) functions? {OF} ",
    rf"{GO} ?的",
    rf"api {OF} ",
    rf"to {DO} ",
    "yet another ",
    rf"solution {OF} ",
)
VERBS = (
    rf" (?:just )?{DOES} ",
    rf" {BE} (?:more than )?{ARTICLE} ",
    " ?是一个",
    " -+ ",
    "[,:] ",
    " module helps to ",
    rf" makes? interface {OF} ",
    rf" {KIND} {DOES} ",
    rf" is {GO} {KIND} {OF} ",
    rf" {BE} supposed to ",
    rf" {BE} intended to ",
)
IMAGE = r"!\[.*?\]\(.+?\)"
SUFFIX = re.compile(rf"(?: (?:for|in) (?:{THE} )?{GO}| using {GO})\.?\s*(?:{IMAGE})?$")
PREFIX = re.compile("|".join(PREFIXES))
WRAP = re.compile(rf"{ARTICLE} .+ {KIND}\.?")
VERB = "|".join(VERBS)


def split_sentences(text: Column) -> Column:
    """Sentences of a text: header rules go, blank lines and full stops part; an empty text is one empty sentence."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(trimmed(text), r"(?:-{4,}|={4,})\n", "\n"), r"-{2,}={2,}|={2,}-{2,}", "")

    # bound once: inside a lambda, the parts would be split anew for each sentence
    def of(parts: Column) -> Column:
        return F.transform(parts, lambda s, i: F.regexp_replace(F.when(i < F.size(parts) - 1, F.concat(s, F.lit("."))).otherwise(s), r"\s+", " "))

    def parted(paragraph: Column) -> Column:
        return let(F.split(F.regexp_replace(trimmed(paragraph), "\n", " "), r"\. "), of)

    return F.flatten(F.transform(F.split(body, r"\n\n+"), parted))


def sentences_of(text: str) -> list[str]:
    body = re.sub(r"--+==+|==+--+", "", re.sub(r"(?:----+|====+)\n", "\n", text.strip()))
    out = []
    for paragraph in re.split(r"\n\n+", body):
        parts = paragraph.strip().replace("\n", " ").split(". ")
        out += [re.sub(r"\s+", " ", s + "." * (i < len(parts) - 1)) for i, s in enumerate(parts)]
    return out


def remove_brackets(s: str) -> str:
    """Takes out each (...) from its first opening to the next closing bracket, and one of two spaces around it."""
    while (i := s.find("(")) >= 0 and (j := s.find(")", i)) >= 0:
        j += i > 0 and s[i - 1] == " " and s[j + 1 : j + 2] == " " and j + 1 < len(s)
        s = s[:i] + s[j + 1 :]
    return s.strip()


def _loose(name: str) -> str:
    """A name with optional spaces between its letters; a last d or s, or a last -go, may be missing."""
    keep = len(name) - 1 if name.endswith(("d", "s")) else len(name) - 3 if name.endswith("-go") else len(name)
    return " ?".join(re.escape(c) + "?" * (i >= keep) for i, c in enumerate(name))


def name_pattern(name: str, pkg: str) -> re.Pattern:
    parts = pkg.lower().split("/")
    forms = [re.escape("/".join(parts[i:])) for i in range(len(parts) - 1)] + [rf"(?:go )?{_loose(parts[-1])}(?:\.go)?"]
    if name and name.lower() != parts[-1]:
        forms.append(rf"(?:go )?{_loose(name.lower())}(?:\.go)?")
    return re.compile(rf"(?:package )?(?:{THE} )?(?:{'|'.join(forms)})(?: package)?(?:{VERB})")


def important(text: str, name: str, pkg: str) -> list[str]:
    """The sentences that say what a package is, without image links."""
    own = None
    out = []
    for s in sentences_of(text):
        low = remove_brackets(s.lower())
        if not low:
            continue
        if not (told := PREFIX.match(low) or SUFFIX.search(low) or WRAP.fullmatch(low)):
            # made only where a sentence asks for it: compiling takes milliseconds
            own = own or name_pattern(name, pkg)
            told = own.match(low)
        if told:
            out.append(re.sub(IMAGE, "", s))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def important_sentences(text: pd.Series, name: pd.Series, pkg: pd.Series) -> pd.Series:
    return pd.Series([important(t or "", n or "", p or "") for t, n, p in zip(text, name, pkg, strict=True)])


plain = markdown.text_of


@F.pandas_udf(T.StringType())
def _markdown(text: pd.Series) -> pd.Series:
    return text.map(plain, na_action="ignore")


def readme_text(file: Column, data: Column) -> Column:
    return F.when(F.lower(file).rlike(r"\.(?:md|markdown|mkd)$"), _markdown(data)).otherwise(data)


def synopsis(text: Column) -> Column:
    """The first sentence."""
    return F.regexp_replace(F.element_at(split_sentences(text), 1), r"\s+$", "")


def snippet(text: str, tokens: set[str], most: int = 300) -> str:
    """Lines of a text within ``most`` bytes: the first, those with new query tokens, then others in order."""
    size = lambda s: len(s.encode())
    text = text.strip()
    if size(text) <= most:
        return text
    lines = [x.strip() for x in text.split("\n")]
    chosen: set[int] = set()
    seen: set[str] = set()
    used = 0
    for i, line in enumerate(lines):
        new = (tokens - seen) & tokens_of(line)
        seen |= new
        if i == 0 or (new and used + size(line) + 1 < most):
            chosen.add(i)
            used += size(line) + 1
            if used == most:
                break
    if used < most:
        for i, line in enumerate(lines):
            if i in chosen or not line:
                continue
            if used + size(line) >= most:
                break
            chosen.add(i)
            used += size(line) + 1
    out, before = "", None
    for i in sorted(chosen):
        gap = "..." if i > 1 and before != i - 1 else " " if before is not None else ""
        out, before = out + gap + lines[i], i
    return out + "..." * (before != len(lines) - 1)


_WORD = regex.compile(r"[A-Za-z]+|[0-9]+|\p{L}[A-Za-z]*|\p{N}[0-9]*")


def marked(text: str, tokens: set[str]) -> str:
    """The text HTML-escaped, with words whose normal form is a query token in bold."""
    out, at = "", 0
    for m in _WORD.finditer(text):
        out += html.escape(text[at : m.start()])
        word = html.escape(m[0])
        out += f"<b>{word}</b>" if norm_word(m[0]) in tokens else word
        at = m.end()
    return out + html.escape(text[at:])


def snippets(tokens: set[str], most: int = 300):
    @F.pandas_udf(T.StringType())
    def of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippet(t, tokens, most), na_action="ignore")

    return of


def marks(tokens: set[str]):
    @F.pandas_udf(T.StringType())
    def of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: marked(t, tokens), na_action="ignore")

    return of
