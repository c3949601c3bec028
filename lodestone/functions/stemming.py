"""Stems as column expressions: the rules of ``stem`` as patterns on a word.

A word is first written with Y for each y that is a consonant (at the start and
after a vowel), so that vowels are ``[aeiouy]`` wherever they stand and the
measure of a stem (how often a vowel run is followed by consonants) is a plain
pattern. Each step is a table of endings, longest first; the first ending that a
word has decides, by a pattern that what is left of the word must match.

The steps are data. ``stem`` makes columns of them, ``stem_sql`` the same
statement in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import OVERRIDES, STEP2, STEP3, STEP4

V, C = "[aeiouy]", "[^aeiouy]"
SOME, MORE, ONE = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}+{C}", f"^{C}*{V}+{C}+{V}*$"
SHORT = f"{C}{V}[^aeiouywxY]$"
DOUBLE = "(?:" + "|".join(c + c for c in "bcdfghjkmnpqrtvwx") + "|yY)$"
#: (ending, pattern of the rest, what takes the ending's place)
Rule = tuple[str, str, str]


def _by_length(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -len(r[0]))


TWO, THREE = (_by_length([(a, SOME, b) for a, b in step]) for step in (STEP2, STEP3))
FOUR = _by_length([(a, MORE if a != "ion" else f"(?:{MORE}.*|{MORE[:-len(C)]})[st]$", "") for a in STEP4])
#: How each word ends that some rule may change; all others are their own stems.
ENDING = "(?:[sye]|ed|ing|ll|al|er|or|ic|[ae]nt|ion|ou|ism|[tlc]i|ful)$"
#: After -ed and -ing: what the rest ends with, and what is done.
MENDED = (("(?:at|bl|iz)$", "add"), (DOUBLE, "cut"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _step(word: Column, rules: list[Rule]) -> Column:
    """The rules by their last letters, so that a word meets few of them; their order stays."""
    out = None
    for last in sorted({ending[-1] for ending, _, _ in rules}):
        own = None
        for ending, rest, new in (r for r in rules if r[0].endswith(last)):
            left = _cut(word, len(ending))
            value = F.when(left.rlike(rest), F.concat(left, F.lit(new)) if new else left).otherwise(word)
            has = word.endswith(ending)
            own = F.when(has, value) if own is None else own.when(has, value)
        own, has = own.otherwise(word), word.endswith(last)
        out = F.when(has, own) if out is None else out.when(has, own)
    return out.otherwise(word)


def _by(rules: list[Rule]):
    return lambda word: _step(word, rules)


def _mended(left: Column) -> Column:
    return (
        F.when(left.rlike(MENDED[0][0]), F.concat(left, F.lit("e"))).when(left.rlike(DOUBLE), _cut(left, 1))
        .when(left.rlike(ONE) & left.rlike(SHORT), F.concat(left, F.lit("e"))).otherwise(left)
    )


def _first(word: Column) -> Column:
    """-eed, or else -ed and -ing after a vowel."""
    ed, ing = _cut(word, 2), _cut(word, 3)
    return (
        F.when(word.endswith("eed"), F.when(ing.rlike(SOME), _cut(word, 1)).otherwise(word))
        .when(word.endswith("ed") & ed.rlike(V), let(ed, _mended)).when(word.endswith("ing") & ing.rlike(V), let(ing, _mended)).otherwise(word)
    )


def _last(word: Column) -> Column:
    left = _cut(word, 1)
    gone = left.rlike(MORE) | (left.rlike(ONE) & ~left.rlike(SHORT))
    return F.when(word.endswith("e") & gone, left).otherwise(word)


def marked(word: Column) -> Column:
    """The word with Y for consonants: at the start, after a vowel, and behind a y that is a vowel."""
    return F.regexp_replace(F.regexp_replace(word, "(^|[aeiou])y", "$1Y"), "yy", "yY")


def porter(word: Column) -> Column:
    """The stem of a word of small ASCII letters; other words and those of one or two letters stay."""
    out = let(marked(word), lambda w: F.regexp_replace(w, "(ss|i)es$|([^s])s$", "$1$2"))
    out = let(out, _first)
    out = let(out, lambda w: F.when(w.rlike(f"{V}.*[yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    for rules in (TWO, THREE, FOUR):
        out = let(out, _by(rules))
    out = let(out, _last)
    out = let(out, lambda w: F.when(w.endswith("ll") & w.rlike(MORE), _cut(w, 1)).otherwise(w))
    return F.when(word.rlike(f"^(?=[a-z]{{3,}}$).*{ENDING}"), F.lower(out)).otherwise(word)


def kernel(stem_: str) -> str:
    """What each word of a stem begins with: the rules cut words, and write i, e, l and le at most at their ends."""
    return re.sub("(?<=.)(?:le|[lei])$", "", stem_)


def stem(word: Column) -> Column:
    """The search form of a word: small letters, fixed words, stems."""

    def of(low: Column) -> Column:
        out = None
        for w, fixed in OVERRIDES.items():
            out = F.when(low == w, F.lit(fixed)) if out is None else out.when(low == w, F.lit(fixed))
        return out.otherwise(porter(low))

    return let(F.lower(word), of)


def _step_sql(rules: list[Rule]) -> str:
    left = lambda e: f"left(w, length(w) - {len(e)})"
    return "CASE " + " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN regexp_matches({left(e)}, '{rest}') THEN {left(e)} || '{new}' ELSE w END" for e, rest, new in rules) + " ELSE w END"


def stem_sql(words: str) -> str:
    """CTEs ending in ``stems`` (word, stem) of the words in the statement ``words`` (word), for DuckDB."""
    left = lambda n: f"left(w, length(w) - {n})"

    def mended(n: int) -> str:
        e = left(n)
        return f"CASE WHEN regexp_matches({e}, '{MENDED[0][0]}') THEN {e} || 'e' WHEN regexp_matches({e}, '{DOUBLE}') THEN {left(n + 1)} WHEN regexp_matches({e}, '{ONE}') AND regexp_matches({e}, '{SHORT}') THEN {e} || 'e' ELSE {e} END"

    steps = [
        "regexp_replace(w, '(ss|i)es$|([^s])s$', '\\1\\2')",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches({left(3)}, '{SOME}') THEN {left(1)} ELSE w END WHEN ends_with(w, 'ed') AND regexp_matches({left(2)}, '{V}') THEN {mended(2)} "
        f"WHEN ends_with(w, 'ing') AND regexp_matches({left(3)}, '{V}') THEN {mended(3)} ELSE w END",
        f"CASE WHEN regexp_matches(w, '{V}.*[yY]$') THEN {left(1)} || 'i' ELSE w END",
        *[_step_sql(rules) for rules in (TWO, THREE, FOUR)],
        f"CASE WHEN ends_with(w, 'e') AND (regexp_matches({left(1)}, '{MORE}') OR (regexp_matches({left(1)}, '{ONE}') AND NOT regexp_matches({left(1)}, '{SHORT}'))) THEN {left(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{MORE}') THEN {left(1)} ELSE w END",
    ]
    out = f"w0 AS (SELECT word, lower(word) AS low, regexp_replace(regexp_replace(lower(word), '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g') AS w FROM (SELECT DISTINCT word FROM ({words})))"
    for i, e in enumerate(steps):
        out += f",\nw{i + 1} AS (SELECT word, low, {e} AS w FROM w{i})"
    fixed = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in OVERRIDES.items())
    return out + f",\nstems AS (SELECT word, CASE low {fixed} ELSE CASE WHEN regexp_full_match(low, '[a-z]{{3,}}') THEN lower(w) ELSE low END END AS stem FROM w{len(steps)})"
