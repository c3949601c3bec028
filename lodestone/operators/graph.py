"""The import graph: reverse edges, project importers, stars, effective imports, static ranks.

``by_project`` folds kinds of imports into one row for each package and project
of importers; counts, stars and effective imports of an index come from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, scores
from ..sources.snapshots import keep


def without_self(edges: DataFrame) -> DataFrame:
    return edges.filter("importer <> imported")


def test_only(edges: DataFrame) -> DataFrame:
    """Test imports that are neither normal imports nor the package itself."""
    kinds = without_self(edges).groupBy("importer", "imported").agg(F.bool_and("test").alias("test"))
    return kinds.filter("test").select("importer", "imported")


def edge_kinds(edges: DataFrame) -> DataFrame:
    """(importer, imported, test) once for each pair: normal imports win over test imports, self-imports go."""
    return without_self(edges).groupBy("importer", "imported").agg(F.bool_and("test").alias("test"))


def reverse(edges: DataFrame) -> DataFrame:
    """How many packages import each package, in normal and in test code."""
    kinds = edge_kinds(edges)
    return kinds.groupBy(F.col("imported").alias("package")).agg(F.count_if(~F.col("test")).alias("imported_len"), F.count_if("test").alias("test_imported_len"))


def project_importers(edges: DataFrame) -> DataFrame:
    """Distinct projects that import any package of each project, by any kind of import."""
    own = without_self(edges).select(paths.full_project(F.col("imported")).alias("project"), paths.full_project(F.col("importer")).alias("by")).distinct()
    return own.groupBy("project").agg(F.count("*").alias("importers"))


def project_stars(docs: DataFrame) -> DataFrame:
    """Star count of each project's most lately updated package; ties by package."""
    order = F.struct(F.coalesce(F.col("last_updated"), F.lit("1970-01-01").cast(docs.schema["last_updated"].dataType)), F.col("package"))
    return docs.groupBy(paths.full_project(F.col("package")).alias("project")).agg(F.max_by("star_count", order).alias("stars"))


def other_projects(edges: DataFrame) -> DataFrame:
    """Imports that leave the importer's project."""
    return without_self(edges).filter(paths.full_project(F.col("importer")) != paths.full_project(F.col("imported")))


def import_counts(kinds: DataFrame) -> DataFrame:
    """For each imported package: importers in normal code, in test code, in real test code, and importing projects.

    ``kinds`` are those of ``edge_kinds``; test imports are real where their
    project has no normal import of the package.
    """
    by = kinds.groupBy("imported", paths.full_project(F.col("importer")).alias("by")).agg(F.count_if(~F.col("test")).alias("normal"), F.count_if("test").alias("tests"))
    return by.groupBy(F.col("imported").alias("package")).agg(
        F.sum("normal").alias("imported_len"), F.sum("tests").alias("test_imported_len"), F.sum(F.when(F.col("normal") == 0, F.col("tests")).otherwise(0)).alias("real_test_len"), F.count("*").alias("importing_projects")
    )


def assigned_stars(docs: DataFrame, edges: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Root packages get their project's stars, others their share by how many of its importing projects import them."""
    return _assigned(docs, project_importers(edges), import_counts(edge_kinds(edges)) if counts is None else counts)


def _assigned(docs: DataFrame, importers: DataFrame, counts: DataFrame) -> DataFrame:
    own = docs.select("package", paths.full_project(F.col("package")).alias("project"))
    by = counts.select("package", F.col("importing_projects").alias("n"))
    out = own.join(project_stars(docs), "project", "left").join(importers, "project", "left").join(by, "package", "left")
    share = F.col("stars").cast("double") / F.col("importers") * F.coalesce("n", F.lit(0))
    stars = F.when(F.col("package") == F.col("project"), F.col("stars").cast("double")).when(F.col("importers").isNull(), F.lit(0.0)).otherwise(share)
    return out.select("package", stars.alias("assigned_stars"))


def real_tests(kinds: DataFrame) -> DataFrame:
    """Test imports by projects that have no normal import of the same package."""
    marked = kinds.withColumn("by", paths.full_project(F.col("importer")))
    normal = marked.filter("NOT test").select("imported", "by").distinct()
    return marked.filter("test").join(normal, ["imported", "by"], "left_anti").select("importer", "imported")


def effective_imported(imports: DataFrame) -> DataFrame:
    """(package, effective): 1 for each importer of a new owner and a new project, half if it is the package's own.

    The order of importers is that of their names. The first importer of each
    owner is the least one; among those, the first of each project again: two
    aggregations with partial sums instead of a fold over one long list.
    """
    rows = imports.select(F.col("imported").alias("package"), "importer", paths.author(F.col("importer")).alias("by"), paths.project(F.col("importer")).alias("of"))
    return _effective(rows, "importer", "by")


def _effective(rows: DataFrame, order: str, owner: str) -> DataFrame:
    """``effective_imported`` of (package, ``order``, ``owner``, of)."""
    # an empty owner is never taken for a repeated one
    first = rows.groupBy("package", F.when(F.col(owner) == "", F.col(order)).alias("alone"), owner).agg(F.min_by("of", order).alias("of"), F.min(order).alias(order))
    once = first.groupBy("package", "of").agg(F.min_by(owner, order).alias(owner))
    own = ((F.col(owner) != "") & (F.col(owner) == paths.author(F.col("package")))) | (F.col("of") == paths.project(F.col("package")))
    return once.groupBy("package").agg(F.sum(F.when(own, 0.5).otherwise(1.0)).alias("effective"))


#: Rows of wide names that one task of a shuffle holds.
PART_ROWS = 300_000
IMPORTER = ("place", "by", "owner", "of")


def parts(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for so many rows: a task holds no more of them in larger tables."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def as_importers(packages: DataFrame) -> DataFrame:
    """Adds to packages what their imports are folded by: ``place`` in the order of names, full project ``by``, ``owner`` and short project ``of``."""
    pkg = F.col("package")
    return placed(packages, [F.asc("package")]).withColumns({"by": paths.full_project(pkg), "owner": paths.author(pkg), "of": paths.project(pkg)})


def by_project(kinds: DataFrame) -> DataFrame:
    """(imported, by, owner, of, normal, tests, first, first_test, used) of ``kinds`` (importer, imported, test) with the columns of ``as_importers``.

    Importers of a project count together. ``first`` and ``first_test`` are the
    least places among those that import in normal code and in tests, ``used``
    tells how many of the whole full project import in normal code.
    """
    own = kinds.groupBy("imported", "by", "owner", "of").agg(
        F.count_if(~F.col("test")).alias("normal"), F.count_if("test").alias("tests"), F.min(F.when(~F.col("test"), F.col("place"))).alias("first"), F.min(F.when(F.col("test"), F.col("place"))).alias("first_test")
    )
    return own.withColumn("used", F.sum("normal").over(Window.partitionBy("imported", "by")))


def counts_of(folded: DataFrame) -> DataFrame:
    """``import_counts`` of rows of ``by_project``."""
    by = folded.groupBy("imported", "by").agg(F.sum("normal").alias("normal"), F.sum("tests").alias("tests"))
    return by.groupBy(F.col("imported").alias("package")).agg(
        F.sum("normal").alias("imported_len"), F.sum("tests").alias("test_imported_len"), F.sum(F.when(F.col("normal") == 0, F.col("tests")).otherwise(0)).alias("real_test_len"), F.count("*").alias("importing_projects")
    )


def effective_of(folded: DataFrame, first: str = "first") -> DataFrame:
    """``effective_imported`` of rows of ``by_project``, by ``first`` or, for real tests, by ``first_test`` where ``used`` is 0."""
    rows = folded.filter(F.col(first).isNotNull()).select(F.col("imported").alias("package"), F.col(first).alias("place"), "owner", "of")
    return _effective(rows, "place", "owner")


def static_scores(docs: DataFrame, edges: DataFrame, now: Column, description: Column | None = None) -> DataFrame:
    """(package, name, static_score, test_static_score, imported_len, test_imported_len, assigned_stars) of each document.

    ``edges``: (importer, imported, test), or rows of ``by_project``.
    """
    if "used" not in edges.columns:
        kinds = keep(edge_kinds(edges), "edge-kinds")
        importers = keep(as_importers(kinds.select(F.col("importer").alias("package")).distinct()), "importers").withColumnRenamed("package", "importer")
        edges = by_project(kinds.join(importers, "importer"))
    folded = keep(edges, "imports-by-project")
    counts = keep(counts_of(folded), "import-counts")
    normal = effective_of(folded)
    test = effective_of(folded.filter("used = 0"), "first_test").withColumnRenamed("effective", "effective_test")
    own = folded.select(paths.full_project(F.col("imported")).alias("project"), "by").distinct().groupBy("project").agg(F.count("*").alias("importers"))
    rows = docs.join(normal, "package", "left").join(test, "package", "left").join(counts, "package", "left").join(_assigned(docs, own, counts), "package", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = F.lit("") if description is None else description
    s = scores.static_score(F.coalesce("effective", F.lit(0.0)), F.col("name"), text, zero("assigned_stars"), zero("imported_len"), zero("test_imported_len"), F.col("package"), now)
    t = scores.test_static_score(F.coalesce("effective_test", F.lit(0.0)), F.col("name"), text, zero("assigned_stars"), zero("imported_len"), zero("real_test_len"))
    return rows.select("package", "name", s.alias("static_score"), t.alias("test_static_score"), zero("imported_len").alias("imported_len"), zero("test_imported_len").alias("test_imported_len"), zero("assigned_stars").alias("assigned_stars"))


def _ranges(scored: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in range partitions of ``order``, with ``__p`` (partition) and ``place`` (rows before this one in the whole order)."""
    spark = scored.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # range partitioning samples its input first: kept rows are not computed twice
    parts = keep(scored, "scored").repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id())
    parts = keep(parts, "places")
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    # one row for each partition
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.withColumn("__r", own).join(F.broadcast(before), "__p").withColumn("place", F.col("__before") + F.col("__r")).drop("__r", "__before")


def placed(scored: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place``: rows before this one in a global order, by counting ranges instead of one sorted task."""
    return _ranges(scored, order).drop("__p")


def ranked(scored: DataFrame, score: str = "static_score", tie: str = "package") -> DataFrame:
    """Adds ``doc_id`` (position by score, ties by ``tie``) and ``static_rank`` (position of the first row of the same score).

    A score's first row lies in the same range or is known from the range before
    it, so that rows of one score, however many, never meet in one task.
    """
    out = keep(_ranges(scored, [F.desc(score), F.asc(tie)]), "ranked")
    ends = out.groupBy("__p").agg(F.max(score).alias("high"), F.min(score).alias("low"), F.min_by("place", F.struct(score, "place")).alias("first"))
    # one row for each range
    carried, low, first = [], None, None
    for r in ends.orderBy("__p").collect():
        from_before = first if r["high"] == low else None
        carried.append((r["__p"], r["high"], from_before))
        first = from_before if from_before is not None and r["low"] == r["high"] else r["first"]
        low = r["low"]
    carried = out.sparkSession.createDataFrame(carried, "__p int, __high double, __carried long")
    own = F.min("place").over(Window.partitionBy("__p", score))
    out = out.withColumn("__own", own).join(F.broadcast(carried), "__p")
    rank = F.when((F.col(score) == F.col("__high")) & F.col("__carried").isNotNull(), F.col("__carried")).otherwise(F.col("__own"))
    return out.withColumn("static_rank", rank).withColumnRenamed("place", "doc_id").drop("__p", "__own", "__high", "__carried")
