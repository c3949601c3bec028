"""Building the index: hits with scores and ranks, postings by field, as tables of one segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, scores, sentences, tokens, zeros
from ..sources.snapshots import Segments, keep, save
from . import blocks, graph

_strings = T.ArrayType(T.StringType())
DOC = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("name", "package", "author")]
    + [T.StructField("last_updated", T.TimestampType()), T.StructField("star_count", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("synopsis", "description", "project_url", "readme_fn", "readme_data")]
    + [T.StructField(c, _strings) for c in ("imports", "test_imports", "exported")]
)
HEAVY = ("description", "readme_fn", "readme_data")


def clean(docs: DataFrame) -> DataFrame:
    """Nulls as zero values, self-imports taken out, test imports without normal ones, authors filled in."""
    text = {c: zeros.text(F.col(c)) for c in ("name", "synopsis", "description", "project_url", "readme_fn", "readme_data")}
    empty = F.array().cast("array<string>")
    own = F.array("package")
    normal = F.array_except(F.coalesce("imports", empty), own)
    out = docs.withColumns(text | {"star_count": zeros.number(F.col("star_count")), "exported": zeros.strings(F.col("exported")), "test_imports": F.array_except(F.array_except(F.coalesce("test_imports", empty), normal), own)})
    return out.withColumn("imports", normal).withColumn("author", F.coalesce(F.nullif("author", F.lit("")), paths.author(F.col("package"))))


def searched(*fields: str | Column) -> Column:
    """The text whose tokens are the union of those of the fields: a line break parts blocks."""
    return F.concat_ws("\n", *fields)


def kinds_of(docs: DataFrame, *more: str) -> DataFrame:
    """(importer, imported, test) of clean documents: their lists hold each import once; ``more`` columns come along."""
    one = lambda c, test: docs.select(F.col("package").alias("importer"), *more, F.explode(c).alias("imported"), F.lit(test).alias("test"))
    return graph.without_self(one("imports", False).unionByName(one("test_imports", True)))


def build(docs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """``hits_full``, ``hits`` (without heavy columns), ``importers`` (package, importer, test), ``postings`` (field, token, doc_id), and their ``blocks`` and ``ranges``.

    Importers stay one row each: a package may have very many.
    """
    own = keep(clean(docs).dropDuplicates(["package"]), "index-docs")
    importers = keep(graph.as_importers(own.select("package")), "index-importers")
    n = graph.parts(own.sparkSession, own.agg(F.sum(F.size("imports") + F.size("test_imports"))).first()[0] or 0)
    folded = graph.by_project(kinds_of(own.join(importers, "package"), *graph.IMPORTER).repartition(n, "imported", "by"))
    # rounded before they are ranked: scores that differ by an order of summation are equal, and ties go by package
    scored = graph.static_scores(own, folded, now, F.col("description")).drop("name").withColumns({c: F.round(c, 6) for c in ("static_score", "test_static_score")})
    hits = own.join(scored, "package")
    readme = sentences.readme_text(F.col("readme_fn"), F.col("readme_data"))
    hits = hits.withColumn("important_sentences", sentences.important_sentences(readme, "name", "package"))
    full = keep(graph.ranked(hits).withColumn("range", blocks.range_of(F.col("doc_id"))), "index-hits")
    text = searched("name", "package", "description", "readme_data", "author", F.array_join("exported", "\n"))
    words = tokens.tokenize(full.select("doc_id", text.alias("t")), "doc_id", "t").select(F.lit("text").alias("field"), "token", "doc_id")
    names = tokens.tokenize(full.select("doc_id", F.col("name").alias("t")), "doc_id", "t").select(F.lit("name").alias("field"), "token", "doc_id")
    ids = full.select(F.lit("pkg").alias("field"), F.col("package").alias("token"), "doc_id")
    postings = keep(words.unionByName(names).unionByName(ids), "index-postings")
    numbered = full.select(
        "doc_id", F.col("doc_id").alias("place"), F.greatest("static_score", "test_static_score").alias("prior"), F.lower("name").alias("name"), scores.match_path(F.col("package")).alias("path"), "synopsis",
        F.array_join("important_sentences", " ").alias("sentences"),
    )
    found = {"blocks": blocks.of_postings(postings.filter("field = 'text'"), numbered), "ranges": blocks.of_docs(numbered)}
    rows = kinds_of(own).select(F.col("imported").alias("package"), "importer", "test")
    return {"hits_full": full, "hits": full.drop(*HEAVY), "importers": rows, "postings": postings} | found


def write(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """A new segment with the tables; postings sorted, so that a token reads few row groups. Older segments go."""
    segments = Segments(spark, root)
    segments.clear_undone()
    name = segments.new_max()
    for key, df in tables.items():
        df = df.repartitionByRange("field", "token", "doc_id").sortWithinPartitions("field", "token", "doc_id") if key == "postings" else df
        df = blocks.ordered(df) if key == "blocks" else df
        df = df.repartitionByRange("range").sortWithinPartitions("range") if key == "hits" else df
        df = df.repartitionByRange("package", "importer").sortWithinPartitions("package", "importer") if key == "importers" else df
        save(df, f"{root}/{name}/{key}")
    segments.finish(name)
    segments.clear_outdated()
    return name
