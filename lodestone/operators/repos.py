"""Repositories: which to crawl, what changed, packages of a file tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folder names that hold no packages.
NOT_SOURCE = (
    "android bin binary c cmd cpp css doc dll faq font fonts gif django help html image images icon icons java javascript js jpg jpeg lib less "
    "nodejs pdf python r readme src script scripts static themes templates tex vendor wav xml zip"
).split()
BUILD_TAGS = ("linux", "386", "darwin", "cgo")


def like_source_folder(folder: Column) -> Column:
    low = F.lower(folder)
    return ~low.isin(NOT_SOURCE) & ~low.rlike(r"^[0-9_-]+$") & ~low.contains(".") & low.rlike("^[a-z]") & ~low.contains("nodejs")


def is_readme(file: Column) -> Column:
    return F.lower(F.regexp_replace(file, r"\.[^.]*$", "")) == "readme"


def build_ignored(tags: Column) -> Column:
    """Any build tag that is neither a known one nor a language version."""
    return F.exists(tags, lambda t: ~F.ltrim(t, F.lit("!")).isin(*BUILD_TAGS) & ~F.ltrim(t, F.lit("!")).startswith("go"))


def need_crawl(crawl_time: Column, now: Column) -> Column:
    return crawl_time.isNull() | (crawl_time < now - F.expr("INTERVAL 1 DAY"))


def status(crawl_time: Column, info_time: Column, repo_updated: Column, now: Column) -> Column:
    """OutOfDate or UpToDate, by a repository record younger than ten days or else by age."""
    fresh = info_time > now - F.expr("INTERVAL 10 DAYS")
    return (
        F.when(crawl_time.isNull(), "OutOfDate").when(fresh, F.when(repo_updated > crawl_time, "OutOfDate").otherwise("UpToDate"))
        .when(crawl_time > now - F.expr("INTERVAL 5 DAYS"), "UpToDate").otherwise("OutOfDate")
    )


def most_overdue(repos: DataFrame, k: int) -> DataFrame:
    """The ``k`` repositories to crawl first: never crawled (greatest name first), then the oldest crawl."""
    return repos.orderBy(F.asc_nulls_first("crawl_time"), F.desc(F.concat("name", "user"))).limit(k)


def refreshed(stored: DataFrame, crawled: DataFrame, now: Column) -> DataFrame:
    """Stored repositories after a crawl: missing ones go, equal signatures only get a new time, others are replaced."""
    key = ["site", "user", "name"]
    new = crawled.select(*key, F.col("signature").alias("new_signature"), F.col("packages").alias("new_packages"), "found")
    out = stored.join(new, key, "left").filter(F.col("found").isNull() | F.col("found"))
    same = F.col("found").isNull() | (F.col("signature") == F.col("new_signature"))
    return out.select(*key, F.when(same, F.col("signature")).otherwise(F.col("new_signature")).alias("signature"), F.when(same, F.col("packages")).otherwise(F.col("new_packages")).alias("packages"), F.when(F.col("found"), now).otherwise(F.col("crawl_time")).alias("crawl_time"))


def folders(files: DataFrame) -> DataFrame:
    """Packages of a tree of parsed files (path, status, name, description, imports, is_test), by folder.

    Ignored files are left out. A folder with a file that failed, with no name
    or with several has ``error``; the root folder is the empty string, others
    start with a slash.
    """
    at = F.when(F.col("path").contains("/"), F.concat(F.lit("/"), F.regexp_replace("path", r"/[^/]*$", ""))).otherwise("")
    rows = files.filter("status <> 'ShouldIgnore'").withColumn("folder", at)
    gather = lambda test: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("is_test") == test, F.col("imports"))))))
    names = F.collect_set(F.when(~F.col("is_test") & (F.col("name") != ""), F.col("name")))
    out = rows.groupBy("folder").agg(
        names.alias("names"), gather(False).alias("imports"), gather(True).alias("test_imports"), F.bool_or(F.col("status") == "ParseFailed").alias("failed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("description") != "", F.struct("path", "description")))), lambda x: x["description"]), "\n").alias("description"),
    )
    error = F.when(F.col("failed"), "parse failed").when(F.size("names") == 0, "no name").when(F.size("names") > 1, "conflicting names")
    return out.select("folder", F.when(F.size("names") == 1, F.get("names", F.lit(0))).alias("name"), "description", "imports", "test_imports", error.alias("error"))


def info_age(crawl_time: Column, now: Column) -> Column:
    """Seconds since a repository record was read."""
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(crawl_time.cast("timestamp"))


def info_holds(crawl_time: Column, now: Column) -> Column:
    """Whether a repository record is young enough to be used again: below two days."""
    return F.coalesce(info_age(crawl_time, now) < 2 * 86400, F.lit(False))


def put(packages: Column, path: Column, package: Column) -> Column:
    """A map of packages with one put into it."""
    return F.map_concat(F.map_filter(packages, lambda k, _: k != path), F.create_map(path, package))


# Fixed value: what a search for repositories is narrowed to.
LANGUAGE = "language:go"


def search_query(q: Column) -> Column:
    return F.when(q.contains(LANGUAGE), q).otherwise(F.trim(F.concat(q, F.lit(" " + LANGUAGE))))


def feed_skips(feed: DataFrame) -> DataFrame:
    """How many rows of a search feed have no owner or time, and how many others no user or path."""
    user = F.coalesce(F.nullif("owner_name", F.lit("")), F.col("owner_login"))
    no_owner = (F.col("owner_name").isNull() & F.col("owner_login").isNull()) | F.col("updated_at").isNull()
    empty = (F.coalesce(user, F.lit("")) == "") | (F.coalesce("path", F.lit("")) == "")
    return feed.agg(F.count("*").alias("total"), F.count_if(no_owner).alias("no_owner_or_time"), F.count_if(~no_owner & empty).alias("no_user_or_path"))


def touched(feed: DataFrame) -> DataFrame:
    """Usable rows of a search feed: owner's name, else login; rows without owner, time, user or path are left out."""
    user = F.coalesce(F.nullif("owner_name", F.lit("")), F.col("owner_login"))
    rows = feed.withColumn("user", user).filter("updated_at IS NOT NULL AND user IS NOT NULL AND user <> '' AND path IS NOT NULL AND path <> ''")
    return rows.select("user", "path", "updated_at")
