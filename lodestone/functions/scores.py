"""Ranking formulas as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

# How much a closed host still counts, from which day on.
LEGACY_HOST = "code.google.com/"
LEGACY_FACTORS = ((dt.datetime(2016, 1, 25), 0.01), (dt.datetime(2015, 8, 24), 0.1))


def idf(df: Column, total: Column) -> Column:
    x = F.ln(total / F.greatest(df, F.lit(1)))
    return F.when(x > 1, F.sqrt(x)).otherwise(x)


def shared_weight(n: Column, same: Column, factor: float) -> Column:
    """What each of ``n`` packages of one project (or author) adds: less with their number, and for its own project by ``factor``."""
    return F.when(same, factor).otherwise(1.0) / F.sqrt(n.cast("double"))


# The factors of a package's own project and own author.
OWN_PROJECT, OWN_AUTHOR = 0.1, 0.5


def legacy_factor(now: Column) -> Column:
    out = None
    for day, factor in LEGACY_FACTORS:
        late = now > F.lit(day)
        out = F.when(late, factor) if out is None else out.when(late, factor)
    return out.otherwise(0.25)


def _text_bonus(name: Column, description: Column) -> Column:
    text = F.regexp_replace(F.coalesce(description, F.lit("")), r"^\s+|\s+$", "")
    named = F.when(text.startswith(F.concat(F.lit("Package "), name)) | text.startswith(F.concat(name, F.lit(" package"))), 0.5).when(text.startswith(F.concat(F.lit("package "), name)), 0.4).otherwise(0.0)
    described = F.when(text == "", 0.0).otherwise(F.lit(1.0) + F.when(F.octet_length(text) > 100, 0.5).otherwise(0.0) + named)
    return described + F.when((name != "") & (name != "main"), 0.1).otherwise(0.0)


def _star_part(stars: Column, own: Column, other: Column) -> Column:
    share = F.when(own + other > 0, own / (own + other)).otherwise(1.0)
    return F.sqrt(F.greatest(stars - 3, F.lit(0)).cast("double")) * 0.5 * share


def static_score(effective: Column, name: Column, description: Column, stars: Column, imported: Column, test_imported: Column, pkg: Column, now: Column) -> Column:
    s = F.lit(1.0) + effective + _text_bonus(name, description) + _star_part(stars, imported, test_imported)
    return F.when(pkg.startswith(LEGACY_HOST), s * legacy_factor(now)).otherwise(s)


def test_static_score(effective: Column, name: Column, description: Column, stars: Column, imported: Column, real_test: Column) -> Column:
    return F.lit(1.0) + effective + _text_bonus(name, description) + F.least(_star_part(stars, real_test, imported), effective)


def matches(token: Column, text: Column, tokens: Column) -> Column:
    return text.contains(token) | F.array_contains(tokens, token) | F.exists(tokens, lambda t: t.startswith(token) | t.endswith(token))


def match_score(query: list[tuple[str, float, float]], fields: dict[str, tuple[Column, Column]]) -> Column:
    """``query``: (token, text idf, name idf); ``fields``: lower-case text and tokens of synopsis, sentences, name, path."""
    if not query:
        return F.lit(1.0)
    s = F.lit(0.02 * len(query))
    for token, text_idf, name_idf in sorted(query):
        for field, weight in (("synopsis", 0.25 * text_idf), ("sentences", 0.25 * text_idf), ("name", 0.25 * name_idf), ("path", 0.1 * text_idf)):
            s = s + F.when(matches(F.lit(token), *fields[field]), weight).otherwise(0.0)
    return s


def fuse_stars(a: Column, b: Column) -> Column:
    """Two star counts; negative means unknown."""
    low, high = F.least(a, b), F.greatest(a, b)
    third, mean = F.floor(high / 3).cast("long"), F.floor((a + b) * 3 / 4).cast("long")
    return F.when(a < 0, b).when(b < 0, a).when(low <= third, high).otherwise(mean).cast("long")


def list_length(n: Column, low: int = 20, high: int = 100) -> Column:
    return F.least(F.greatest(F.coalesce(n.try_cast("int"), F.lit(0)), F.lit(low)), F.lit(high))


def match_path(pkg: Column) -> Column:
    return F.lower(paths.remove_host(pkg))
