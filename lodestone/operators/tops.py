"""Top lists and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def top(rows: DataFrame, by: str, n: int, tie: str = "package") -> DataFrame:
    return rows.orderBy(F.desc(by), F.asc(tie)).limit(n)


def hot(rows: DataFrame, by: str, n: int, imports: str, project: Column | None = None) -> DataFrame:
    """The best imported, named packages that are no programs, ``n`` at most: none whose project lies in that of a better one.

    ``project`` (default: that of the path) is a slash-separated name; it lies in
    itself and in its prefixes. A project that is left out for a better ancestor
    hides nothing that the ancestor doesn't hide too, so that one anti join
    gives what a walk from the best package down would keep.
    """
    own = rows.filter((F.col(imports) > 0) & ~F.col("name").isin("", "main")).withColumn("project", paths.full_project(F.col("package")) if project is None else project)
    own = own.groupBy("project").agg(F.min_by(F.struct("package", "name", by), F.struct(-F.col(by), "package")).alias("b"))
    best = own.select("project", "b.*").withColumn("place", F.struct(-F.col(by), F.col("package")))
    ups = best.select("project", "place", F.explode(paths.ancestors(F.col("project"), 1)).alias("up"))
    hidden = ups.join(best.select(F.col("project").alias("up"), F.col("place").alias("above")), "up").filter(F.col("above") < F.col("place")).select("project").distinct()
    return best.join(hidden, "project", "left_anti").drop("place").orderBy(F.desc(by), F.asc("package")).limit(n)


def sites(rows: DataFrame, n: int) -> DataFrame:
    own = rows.select(F.lower(paths.host(F.col("package"))).alias("site")).filter("site <> ''")
    return own.groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").limit(n)


def report(scored: DataFrame, n: int, project: Column | None = None) -> DataFrame:
    """The four lists under one another: (list, about, place, name, package, link, info). Lists have at most ``n`` rows each."""
    place = lambda df, by, tie: df.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), F.asc(tie))))  # noqa: E731  of n rows
    shown = paths.display_name(F.col("name"), F.col("package"))
    both = scored.withColumn("both", F.col("imported_len") + F.col("test_imported_len"))
    more = scored.select("package", "imported_len", "test_imported_len", "star_count")
    refs = lambda c: F.concat_ws(" ", F.col(c), F.col("star_count"))
    parts = (
        ("Hot", "refs stars", place(hot(scored, "static_score", n, "imported_len", project), "static_score", "package").select("package", "name", "place").join(more, "package"), refs("imported_len")),
        ("Hot Test", "refs stars", place(top(scored.filter("test_imported_len > 0"), "test_static_score", n), "test_static_score", "package"), refs("test_imported_len")),
        ("Most Imported", "refs", place(top(both, "both", n), "both", "package"), F.col("both").cast("string")),
    )
    out = None
    for name, about, df, info in parts:
        one = df.select(F.lit(name).alias("list"), F.lit(about).alias("about"), "place", shown.alias("name"), "package", F.lit("").alias("link"), info.alias("info"))
        out = one if out is None else out.unionByName(one)
    site = place(sites(scored, n), "n", "site")
    return out.unionByName(site.select(F.lit("Sites").alias("list"), F.lit("packages").alias("about"), "place", F.col("site").alias("name"), F.lit("").alias("package"), F.concat(F.lit("http://"), F.col("site")).alias("link"), F.col("n").cast("string").alias("info")))


def rollup(metrics: DataFrame) -> DataFrame:
    """(name, method, value) rows reduced by their method: sum, max or average."""
    return metrics.groupBy("name", "method").agg(F.sum("value").alias("s"), F.max("value").alias("m"), F.avg("value").alias("a")).select("name", "method", F.when(F.col("method") == "sum", F.col("s")).when(F.col("method") == "max", F.col("m")).otherwise(F.col("a")).alias("value"))


def latency(rows: DataFrame, col: str) -> DataFrame:
    """Counts at most one second, and above 1, 10 and 100."""
    v = F.col(col)
    return rows.agg(F.count_if(v <= 1).alias("within_1"), F.count_if(v > 1).alias("over_1"), F.count_if(v > 10).alias("over_10"), F.count_if(v > 100).alias("over_100"))
