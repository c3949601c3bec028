"""Crawled packages: projections into documents and records, and rules on what to crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, sentences, zeros
from ..sources.snapshots import save

README_BYTES = 100 * 1024
# Fixed value: hosts that answer no more.
DEAD_HOSTS = ("thezombie.net",)


def cut_bytes(text: Column, most: int) -> Column:
    """The first ``most`` bytes of a text, without a torn last character."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string")), "\ufffd+$", "")


def bad_target(pkg: Column) -> Column:
    out = pkg.contains("/vendor/")
    for host in DEAD_HOSTS:
        out = out | pkg.startswith(host)
    return out


def remote_only(pkgs: Column) -> Column:
    """The valid remote paths of an array, trimmed."""
    return F.filter(F.transform(F.coalesce(pkgs, F.array().cast("array<string>")), paths.trim_name), paths.valid_remote)


def tidy_imports(df: DataFrame) -> DataFrame:
    """imports without the package; test imports (also external ones) without imports and the package."""
    own, none = F.array("package"), F.array().cast("array<string>")
    tests = F.array_union(F.coalesce("test_imports", none), F.coalesce("x_test_imports", none)) if "x_test_imports" in df.columns else F.coalesce("test_imports", none)
    df = df.withColumn("imports", F.coalesce("imports", none))
    return df.withColumn("test_imports", F.array_except(F.array_except(tests, F.col("imports")), own)).withColumn("imports", F.array_except("imports", own))


def exported(functions: Column, types: Column) -> Column:
    return F.array_union(functions, types)


def to_doc(crawled: DataFrame, now: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Crawled packages in the shape of documents: author from the path, updated now, valid imports only.

    ``carry`` names further columns to keep.
    """
    text = lambda c: zeros.text(F.col(c))
    return crawled.select(
        text("name").alias("name"), "package", paths.author(F.col("package")).alias("author"), now.cast("timestamp").alias("last_updated"), zeros.number(F.col("star_count")).alias("star_count"),
        F.when((text("synopsis") == "") & (text("doc") == ""), sentences.synopsis(text("readme_data"))).otherwise(text("synopsis")).alias("synopsis"), text("doc").alias("description"), text("project_url").alias("project_url"),
        text("readme_fn").alias("readme_fn"), cut_bytes(text("readme_data"), README_BYTES).alias("readme_data"), remote_only(F.col("imports")).alias("imports"), remote_only(F.col("test_imports")).alias("test_imports"), F.col("exported"), *carry,
    )


def to_record(crawled: DataFrame, now: Column) -> DataFrame:
    """Crawled packages in the shape of the store: the document's fields, references and the crawl time, by site and path."""
    doc = to_doc(crawled, now, ("references",))
    return doc.select(paths.site(F.col("package")).alias("site"), paths.rest(F.col("package")).alias("path"), "*").withColumn("crawl_time", F.col("last_updated"))


def touch(feed: DataFrame, docs: DataFrame) -> DataFrame:
    """Packages of a feed (package, updated_at) that are to be crawled now: valid, and not updated after that time."""
    known = docs.select("package", F.col("last_updated").alias("__known"))
    return feed.filter(paths.valid_remote(F.col("package"))).join(known, "package", "left").filter(F.col("__known").isNull() | (F.col("__known") <= F.col("updated_at"))).select(*feed.columns)


def append_persons(persons: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Persons (id, schedule_time) with those found (site, name) that are not there yet, scheduled now."""
    new = found.select(paths.person_id(F.col("site"), F.col("name")).alias("id")).distinct().join(persons.select("id"), "id", "left_anti")
    return persons.select("id", "schedule_time").unionByName(new.select("id", now.cast("timestamp").alias("schedule_time")))


def token_index(rows: DataFrame, id_col: str, token_col: str) -> tuple[DataFrame, DataFrame]:
    """Sorted token sets by id, and the ids of tokens, one row each: a common token has too many for a list."""
    pairs = rows.select(id_col, token_col).distinct()
    return pairs.groupBy(id_col).agg(F.array_sort(F.collect_list(token_col)).alias("tokens")), pairs.select(token_col, id_col)


def save_token_index(pairs: DataFrame, path: str) -> None:
    """The rows of a token index, sorted by token, so that a lookup reads few row groups."""
    save(pairs.repartitionByRange(*pairs.columns).sortWithinPartitions(*pairs.columns), path)


def ids_of(pairs: DataFrame, token: str) -> DataFrame:
    """The ids of one token of a token index (token, id)."""
    by, own = pairs.columns
    return pairs.filter(F.col(by) == token).select(own)


def actions(crawled: DataFrame, now: Column) -> DataFrame:
    """Action rows of crawl results (package, outcome, failures, ...): ``invalid`` deletes, ``ok`` updates, others give none."""
    act = F.when((F.col("outcome") == "invalid") | bad_target(F.col("package")), "delete").when(F.col("outcome") == "ok", "update")
    return crawled.withColumn("action", act).filter("action IS NOT NULL").withColumn("last_updated", now.cast("timestamp"))
