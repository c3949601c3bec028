"""Keyword search over postings: retrieval, ranking, folding, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, scores

RERANK_BELOW = 5000
PAGE = 10


def frequencies(postings: DataFrame) -> DataFrame:
    """Documents of each token."""
    return postings.groupBy("token").agg(F.count("*").alias("df"))


def matching(postings: DataFrame, tokens: list[str], mode: str = "and") -> DataFrame:
    """Documents that hold all (or any) of the distinct tokens, with how many. No tokens match every document."""
    own = sorted(set(tokens))
    if not own:
        return postings.select("doc_id").distinct().withColumn("n", F.lit(0).cast("long"))
    found = postings.filter(F.col("token").isin(own)).groupBy("doc_id").agg(F.countDistinct("token").alias("n"))
    return found.filter(F.col("n") == len(own)) if mode == "and" else found


def idfs(postings: DataFrame, tokens: list[str], total: int) -> list[tuple[str, float, float]]:
    """(token, text idf, name idf) of the query's tokens; a query has few."""
    return idfs_of(frequencies(postings.filter(F.col("token").isin(sorted(set(tokens))))), tokens, total)


def idfs_of(counts: DataFrame, tokens: list[str], total: int) -> list[tuple[str, float, float]]:
    """``idfs`` of (token, df)."""
    by = counts.filter(F.col("token").isin(sorted(set(tokens)))).withColumn("idf", scores.idf(F.col("df"), F.lit(float(total))))
    known = {r["token"]: r["idf"] for r in by.collect()}
    missing = counts.sparkSession.range(1).select(scores.idf(F.lit(0), F.lit(float(max(total, 1)))).alias("i")).first()["i"]
    return [(t, known.get(t, missing), known.get(t, missing)) for t in sorted(set(tokens))]


def sorted_hits(hits: DataFrame) -> DataFrame:
    """Best score, most stars, shortest and least package first."""
    return hits.orderBy(F.desc("score"), F.desc("star_count"), F.octet_length("package"), "package")


def hit_order() -> list[Column]:
    return [F.desc("score"), F.desc("star_count"), F.octet_length("package"), F.asc("package")]


def demoted(hits: DataFrame, below: int = RERANK_BELOW) -> DataFrame:
    """Among fewer than ``below`` hits, the n-th of a name that nothing imports has its score divided by n.

    Larger results keep their scores, so the window runs over fewer than
    ``below`` rows, counted beforehand.
    """
    if hits.limit(below).count() >= below:
        return hits.withColumn("occurrence", F.lit(1)).withColumn("final_score", F.col("score"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy(*hit_order()))
    idle = (F.col("imported_len") == 0) & (F.col("test_imported_len") == 0)
    return hits.withColumn("occurrence", nth).withColumn("final_score", F.when((F.col("occurrence") > 1) & idle, F.col("score") / F.col("occurrence")).otherwise(F.col("score")))


def hit_key() -> Column:
    """What orders hits like ``hit_order``, as one ascending value."""
    return F.struct((-F.col("score")).alias("s"), (-F.col("star_count")).alias("n"), F.octet_length("package").alias("l"), F.col("package").alias("p"))


def before(hits: DataFrame, shown: list[tuple]) -> list[int]:
    """How many hits come before each of a few (package, score, star_count), in one pass."""
    if not shown:
        return []
    keys = [F.struct(F.lit(-s).alias("s"), F.lit(-n).alias("n"), F.octet_length(F.lit(p)).alias("l"), F.lit(p).alias("p")) for p, s, n in shown]
    return list(hits.select(hit_key().alias("key")).agg(*[F.count_if(F.col("key") < k) for k in keys]).first())


def folded(hits: DataFrame, order: str | Column = "rank") -> DataFrame:
    """Adds ``parent``: the longest earlier hit above this path that is not folded itself; null if none is.

    A hit is folded if any earlier hit lies above it. ``order`` tells hits apart.
    """
    own = hits.select("package", (F.col(order) if isinstance(order, str) else order).alias("rank"))
    ups = own.select("package", "rank", F.explode(paths.ancestors(F.col("package"))).alias("up"))
    above = ups.join(own.select(F.col("package").alias("up"), F.col("rank").alias("up_rank")), "up").filter("up_rank < rank")
    inside = above.select(F.col("package").alias("up")).distinct()
    parent = above.join(inside, "up", "left_anti").groupBy("package").agg(F.max_by("up", F.length("up")).alias("parent"))
    return hits.join(parent, "package", "left")


def page(rows: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def pages(entries: int, size: int = PAGE) -> int:
    return -(-entries // size)


def page_links(number: int, total: int, reach: int = 10) -> dict:
    """Page numbers before and after, and the previous and next one (0: none)."""
    there = lambda p: p if 0 < p <= total else 0
    near = [p for p in range(1, total + 1) if abs(p - number) < reach]
    return {"before": [p for p in near if p < number], "after": [p for p in near if p > number], "prev": there(number - 1), "next": there(number + 1)}


def page_link_columns(number: Column, total: Column, reach: int = 10) -> dict[str, Column]:
    """``page_links`` as columns."""
    all_pages = F.when(total > 0, F.sequence(F.lit(1), F.greatest(total, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    there = lambda p: F.when((p > 0) & (p <= total), p).otherwise(0)
    return {
        "before": F.filter(all_pages, lambda p: (p < number) & (number - p < reach)), "after": F.filter(all_pages, lambda p: (p > number) & (p - number < reach)),
        "prev": there(number - 1), "next": there(number + 1),
    }


# The columns of a hit as the interface returns it, with their keys there.
API_KEYS = {"name": "name", "package": "package", "author": "author", "synopsis": "synopsis", "description": "description", "project_url": "projecturl"}


def as_json(keys: dict[str, str]) -> Column:
    """One JSON object of the columns in ``keys`` under their names there; nulls are kept."""
    return F.to_json(F.struct(*[F.col(c).alias(k) for c, k in keys.items()]), {"ignoreNullFields": "false"})


#: Rows of a long list that are joined at a time.
RUN = 1024


def json_runs(rows: DataFrame) -> DataFrame:
    """(run, text) of ``rows`` (place, j): the JSON of consecutive places, after commas; only that of place 0 has none before it."""
    runs = rows.groupBy(F.floor(F.col("place") / RUN).alias("run"))
    # an empty text before the first one gives the comma between runs
    return runs.agg(F.concat_ws(",", F.when(F.col("run") > 0, ""), F.array_sort(F.collect_list(F.struct("place", "j")))["j"]).alias("text"))


def json_list(runs: DataFrame, head: str, tail: str) -> DataFrame:
    """One row (body): the texts of ``json_runs`` between ``head`` and ``tail``. One task holds the whole body, but not its rows."""
    return runs.agg(F.concat_ws("", F.lit(head), F.array_sort(F.collect_list(F.struct("run", "text")))["text"], F.lit(tail)).alias("body"))


def shows_readme(description: Column, readme: Column) -> Column:
    """Whether the page of a package shows its readme: there is one, and hardly a description."""
    return (F.octet_length(description) < 10) & (F.octet_length(readme) > 0)


def badge(place: Column) -> Column:
    """A picture of a package's place, counted from one."""
    return F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="100" height="20"><text x="4" y="14">rank %d</text></svg>', place)


def badge_snippets(base: str, pkg: Column) -> dict[str, Column]:
    """How a page shows the badge of a package: ``html`` and ``markdown``; ``base`` is the address of the service."""
    id_ = F.url_encode(pkg)
    picture, page_ = F.concat(F.lit(f"{base}/badge?id="), id_), F.concat(F.lit(f"{base}/view?id="), id_)
    return {
        "html": F.concat(F.lit('<a href="'), page_, F.lit('"><img src="'), picture, F.lit('" alt="rank"></a>')),
        "markdown": F.concat(F.lit("[![rank]("), picture, F.lit(")]("), page_, F.lit(")")),
    }
