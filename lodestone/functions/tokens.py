"""Tokens of search texts.

Blocks are runs without white space (after URLs and e-mail addresses are taken
out); a block is cut into raw tokens by one pattern; camel-case tokens give
their parts and adjacent part pairs; adjacent tokens of a block give pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stemming
from .stem import norm_word
from .words import EMAIL, RAW, STOP, URL, tokens_of


def strip_links(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, URL, " "), EMAIL, "")


def blocks(text: Column) -> Column:
    return F.filter(F.split(strip_links(text), r"[\s\x{85}\p{Z}]+"), lambda b: b != "")


def raw_tokens(block: Column) -> Column:
    return F.regexp_extract_all(block, F.lit(RAW), F.lit(0))


def is_camel(token: Column) -> Column:
    return token.rlike(r"^\p{L}+$") & token.rlike(r"\p{Lu}") & token.rlike(r"\p{Ll}")


def camel_parts(token: Column) -> Column:
    """Parts of a camel-case token, each from an upper-case letter on; none for other tokens."""
    return F.when(is_camel(token), F.regexp_extract_all(token, F.lit(r"\p{Lu}[^\p{Lu}]*|^[^\p{Lu}]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pairs(tokens: Column) -> Column:
    """Adjacent pairs: two ASCII tokens with a hyphen, two others joined, none where they differ."""
    nexts = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    firsts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    ascii_ = lambda t: F.octet_length(t) == F.length(t)
    both = F.zip_with(firsts, nexts, lambda a, b: F.when(ascii_(a) & ascii_(b), F.concat(a, F.lit("-"), b)).when(~ascii_(a) & ~ascii_(b), F.concat(a, b)))
    return F.filter(both, lambda p: p.isNotNull())


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(norm_word, na_action="ignore")


def camel_tokens(token: Column) -> Column:
    """Stems of the parts of a camel-case token, and adjacent ones joined."""

    def of(parts: Column) -> Column:
        joined = F.zip_with(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        return F.concat(F.filter(parts, lambda p: ~p.isin(STOP)), joined)

    return stemming.let(F.transform(camel_parts(token), stemming.stem), of)


#: A word with a capital behind its first letter; only such words have more than one camel part.
INNER = r"\p{L}\p{Lu}"


def token_set(text: Column) -> Column:
    """The distinct tokens of a text as one expression, without Python workers; the same as ``tokenize`` gives.

    It stems each different block of a text, where ``tokenize`` remembers stems.
    """
    empty = F.array().cast("array<string>")

    def of(raw: Column) -> Column:
        norms = lambda n: F.concat(F.filter(n, lambda t: ~t.isin(STOP)), F.when(F.size(n) > 1, pairs(n)).otherwise(empty))
        return stemming.let(F.transform(raw, stemming.stem), norms)

    def of_block(b: Column) -> Column:
        with_camel = lambda raw: F.concat(of(raw), F.flatten(F.transform(raw, camel_tokens)))
        return stemming.let(raw_tokens(b), lambda raw: F.when(b.rlike(INNER), with_camel(raw)).otherwise(of(raw)))

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(blocks(text)), of_block)))


def tokens_among(text: Column, wanted: list[str]) -> Column:
    """The tokens of ``token_set`` that are in ``wanted``, in its order.

    Words that begin like none of these, and have no inner capital, are not
    stemmed; pairs are looked for only where one is wanted.
    """
    own = F.array(*[F.lit(t) for t in wanted]).cast("array<string>")
    if not wanted or any(not t.isascii() or "-" in t for t in wanted):
        return F.array_intersect(own, token_set(text))
    begins = "^(?:" + "|".join(sorted({re.escape(stemming.kernel(t)) for t in wanted})) + ")"

    def of(raw: Column) -> Column:
        plain = F.filter(F.transform(F.filter(raw, lambda w: F.lower(w).rlike(begins)), stemming.stem), lambda t: ~t.isin(STOP))
        return F.concat(plain, F.flatten(F.transform(F.filter(raw, lambda w: w.rlike(INNER)), camel_tokens)))

    return F.array_intersect(own, stemming.let(words(text), of))


def words(text: Column) -> Column:
    """All raw tokens of a text in order; the same as those of its blocks, as no token holds white space."""
    return raw_tokens(strip_links(text))


def tokenize(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, token) for each row and each of its distinct tokens, in one pass without a shuffle.

    Each worker keeps the stems of the words it met last.
    """
    given = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("token"))
    out = T.StructType([given.schema[id_col], T.StructField("token", T.ArrayType(T.StringType()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem_of = lru_cache(1 << 18)(norm_word)
        for b in it:
            found = pa.array([sorted(tokens_of(t, stem_of)) for t in b.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=[id_col, "token"])

    return given.mapInArrow(batches, out).select(id_col, F.explode("token").alias("token"))
