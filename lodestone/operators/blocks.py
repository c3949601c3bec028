"""Posting blocks: the best hits of a query without reading or scoring every hit.

Documents are numbered by their static rank. The documents of a range of
``SIZE`` numbers that hold a token in a field are one block: first and last
number, count, the highest prior score, and the numbers. A second table has what
bounds the match of any document of a range, whatever the query.

A query reads the heads of its tokens' blocks (the numbers are a column of their
own, which that scan leaves out), drops ranges in which the blocks can't meet,
and bounds the score of the others. The ranges with the highest bounds are
scored first; of the rest, only those whose bound reaches the k-th score found
so far.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 128


def range_of(place: Column, size: int = SIZE) -> Column:
    return F.floor(place / size).cast("long")


def of_postings(postings: DataFrame, docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(field, token, range, first, last, n, best, places) of ``postings`` (field, token, doc_id) and ``docs`` (doc_id, place, prior).

    A block has ``size`` places at most.
    """
    return of_places(postings.distinct().join(docs.select("doc_id", "place", "prior"), "doc_id").withColumn("range", range_of(F.col("place"), size)), size)


def of_places(own: DataFrame, size: int = SIZE) -> DataFrame:
    """The blocks of distinct (field, token, place) with ``prior`` and ``range``; rows that are dealt by ``range`` are not shuffled again.

    Numbers are gathered as bits, 64 a column, so that the aggregation keeps no lists and sorts nothing.
    """
    at = F.col("place") - F.col("range") * size
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (at - 64 * i).cast("int"))
    words = range(-(-size // 64))
    bits = [F.bit_or(F.when(F.floor(at / 64) == i, bit(i)).otherwise(F.lit(0).cast("long"))).alias(f"__{i}") for i in words]
    out = own.groupBy("range", "token", "field").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"), F.max("prior").alias("best"), *bits)

    def there(place: Column) -> Column:
        i = place - F.col("range") * size
        found = F.lit(False)
        for w in words:
            found = F.when(F.floor(i / 64) == w, F.call_function("getbit", F.col(f"__{w}"), (i - 64 * w).cast("int")) == 1).otherwise(found)
        return found

    places = F.when(F.col("n") == 1, F.array("first")).when(F.col("n") == 2, F.array("first", "last")).otherwise(F.filter(F.sequence("first", "last"), there))
    return out.select("field", "token", "range", "first", "last", "n", "best", places.alias("places"))


def frequencies(blocks: DataFrame, field: str = "text") -> DataFrame:
    """(token, df): documents of each token, from the heads of its blocks."""
    return blocks.filter(F.col("field") == field).groupBy("token").agg(F.sum("n").alias("df"))


def of_docs(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(range, best, names, paths, synopses, said): what bounds the match of the documents of a range.

    ``docs``: (place, prior, name, path, synopsis, sentences), texts in lower
    case. ``names`` and ``paths`` are the different ones, ``synopses`` and
    ``said`` tell whether any document has one.
    """
    there = lambda c: F.max(F.octet_length(F.coalesce(F.col(c), F.lit(""))) > 0)
    return docs.groupBy(range_of(F.col("place"), size).alias("range")).agg(F.max("prior").alias("best"), F.collect_set("name").alias("names"), F.collect_set("path").alias("paths"), there("synopsis").alias("synopses"), there("sentences").alias("said"))


def ordered(blocks: DataFrame) -> DataFrame:
    """Blocks as they are written: a token reads few row groups."""
    return blocks.repartitionByRange("field", "token", "range").sortWithinPartitions("field", "token", "range")


def most(query: list[tuple[str, float, float]]) -> Column:
    """The highest match that any document of a range (a row of ``of_docs``) can have; ``query`` as in ``scores.match_score``."""
    out = F.lit(0.02 * len(query) if query else 1.0)
    for token, text_idf, name_idf in query:
        among = lambda c, t=token: F.exists(c, lambda x: x.contains(t))
        out = out + F.when(F.col("synopses"), 0.25 * text_idf).otherwise(0.0) + F.when(F.col("said"), 0.25 * text_idf).otherwise(0.0)
        out = out + F.when(among("names"), 0.25 * name_idf).otherwise(0.0) + F.when(among("paths"), 0.1 * text_idf).otherwise(0.0)
    return out


@dataclass
class Found:
    """``hits``: the best k, not in order; ``read``: (range) of which blocks were read; ``heads``: (range, bound) where the tokens may meet."""

    hits: DataFrame
    read: DataFrame
    heads: DataFrame


def heads(blocks: DataFrame, ranges: DataFrame, tokens: list[str], bound: Column, field: str = "text") -> DataFrame:
    """(range, bound) of the ranges in which blocks of all tokens overlap. Without tokens: all ranges."""
    if not tokens:
        return ranges.select("range", bound.alias("bound"))
    own = blocks.filter((F.col("field") == field) & F.col("token").isin(tokens))
    meet = own.groupBy("range").agg(F.count("*").alias("n"), F.max("first").alias("low"), F.min("last").alias("high")).filter((F.col("n") == len(tokens)) & (F.col("low") <= F.col("high")))
    return meet.join(ranges, "range").select("range", bound.alias("bound"))


def meeting(blocks: DataFrame, tokens: list[str], field: str = "text") -> DataFrame:
    """(place) of the documents that are in the blocks of all tokens."""
    own = blocks.filter((F.col("field") == field) & F.col("token").isin(tokens))
    lists = own.groupBy("range").agg(F.collect_list("places").alias("lists")).filter(F.size("lists") == len(tokens))
    return lists.select(F.explode(F.aggregate(F.slice("lists", 2, max(len(tokens) - 1, 1)), F.col("lists")[0], F.array_intersect)).alias("place"))


def top(
    blocks: DataFrame, ranges: DataFrame, docs: DataFrame, query: list[tuple[str, float, float]], k: int, score: Callable[[DataFrame], DataFrame], order: list[Column], size: int = SIZE, at_first: int | None = None,
) -> Found:
    """The ``k`` best documents that hold all tokens of ``query``.

    ``score`` adds ``score`` (prior times match) to rows of ``docs`` (which have
    ``place`` and ``range``); equal scores go by ``order``. ``at_first`` ranges
    are scored before there is a k-th score; of these, the driver holds numbers.
    """
    tokens = [t for t, _, _ in query]
    bounded = heads(blocks, ranges, tokens, F.col("best") * most(query))
    n = at_first or max(4, -(-2 * k // size))
    first = [r["range"] for r in bounded.orderBy(F.desc("bound"), "range").limit(n).collect()]

    def scored(own: DataFrame, rows: DataFrame) -> DataFrame:
        return score(rows.join(meeting(own, tokens), "place", "left_semi") if tokens else rows)

    one = scored(blocks.filter(F.col("range").isin(first)), docs.filter(F.col("range").isin(first)))
    best = one.orderBy(F.desc("score"), *order).limit(k)
    row = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    rest = bounded.filter(~F.col("range").isin(first))
    if row["n"] == k:
        # rounding of products must not hide an equal score
        rest = rest.filter(F.col("bound") * (1 + 1e-9) >= row["least"])
    rest = rest.select("range")
    two = scored(blocks.join(rest, "range", "left_semi"), docs.join(rest, "range", "left_semi"))
    hits = one.unionByName(two).orderBy(F.desc("score"), *order).limit(k)
    chosen = bounded.filter(F.col("range").isin(first)).select("range").unionByName(rest)
    return Found(hits, chosen, bounded)


def counts(found: Found, blocks: DataFrame, tokens: list[str], field: str = "text") -> DataFrame:
    """(read, total): blocks of the tokens whose numbers were read, and all of them."""
    own = blocks.filter((F.col("field") == field) & F.col("token").isin(tokens)).join(found.read.withColumn("was", F.lit(True)), "range", "left")
    return own.agg(F.count_if("was").alias("read"), F.count("*").alias("total"))
