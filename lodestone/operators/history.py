"""Crawl history of packages and persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

DEPTH = 10


def latest(events: DataFrame, n: int = DEPTH) -> DataFrame:
    """The newest ``n`` events of each key (without those of action None), with their position from 1."""
    order = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.filter("action <> 'None'").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def summary(events: DataFrame) -> DataFrame:
    """For each key: first time and event seen, count of recorded events, latest success and failure."""
    return events.groupBy("key").agg(
        F.min("ts").alias("found_time"), F.min_by("event_id", F.struct("ts", "event_id")).alias("found_event"), F.count_if(F.col("action") != "None").alias("events"),
        F.max(F.when(F.col("action") == "Success", F.col("ts"))).alias("latest_success"), F.max(F.when(F.col("action") == "Failed", F.col("ts"))).alias("latest_failed"),
    )


def lookup(found: DataFrame, events: DataFrame, package: str) -> DataFrame:
    """The history page of one package by its lower-cased name: how and when it was found, latest times, newest events."""
    one = F.col("key") == package.strip().lower()
    return found.filter(one).join(summary(events.filter(one)).select("key", "latest_success", "latest_failed"), "key", "left").join(lists(events.filter(one)), "key", "left")


def lists(events: DataFrame, n: int = DEPTH) -> DataFrame:
    """The newest events of each key as one array, newest first."""
    return latest(events, n).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "ts", "action"))), lambda e: F.struct(e["ts"].alias("ts"), e["action"].alias("action"))).alias("events"))


def fill_found(history: DataFrame, entries: DataFrame) -> DataFrame:
    """Missing found times become ten days before the scheduled time, found way unknown."""
    out = history.join(entries.select(F.col("id").alias("key"), "schedule_time"), "key", "left")
    missing = F.col("found_time").isNull()
    return out.withColumn("found_way", F.when(missing & F.col("schedule_time").isNotNull(), "unknown").otherwise(F.col("found_way"))).withColumn("found_time", F.coalesce("found_time", F.col("schedule_time") - F.expr("INTERVAL 10 DAYS"))).drop("schedule_time")


def or_empty(found: Column, empty: Column) -> Column:
    """Missing records read as empty ones."""
    return F.coalesce(found, empty)


# The hosts whose packages lead to others, and how each kind of these was found.
RELATED_HOSTS = ("github.com/", "bitbucket.org/")
WAYS = (("imports", "impoted:"), ("test_imports", "testimported:"), ("references", "reference:"))


def leading(packages: DataFrame) -> DataFrame:
    """Crawled packages of the hosts with persons."""
    on = F.lit(False)
    for host in RELATED_HOSTS:
        on = on | F.col("package").startswith(host)
    return packages.filter(on)


def related_persons(packages: DataFrame) -> DataFrame:
    """Distinct authors (id, site, name) of crawled packages, on hosts that have persons."""
    own = leading(packages).select(paths.site(F.col("package")).alias("site"), F.col("author").alias("name")).distinct()
    return own.select(paths.person_id(F.col("site"), F.col("name")).alias("id"), "site", "name")


def related(packages: DataFrame) -> DataFrame:
    """(package, found_way) of what a crawled package names: imports, test imports, references; only of hosts with persons."""
    out = None
    packages = leading(packages)
    for col, way in WAYS:
        one = packages.select(F.explode(col).alias("package"), F.concat(F.lit(way), F.col("package")).alias("found_way"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def from_folders(packages: DataFrame, history: DataFrame, like_folder) -> DataFrame:
    """Sub-folders that look like source and have no history yet, found by their parent."""
    rows = packages.select(F.col("package").alias("parent"), F.explode("folders").alias("folder")).filter(like_folder(F.col("folder")))
    rows = rows.select(F.concat_ws("/", "parent", "folder").alias("package"), F.concat(F.lit("parent:"), F.col("parent")).alias("found_way"))
    return rows.join(history.select(F.col("key").alias("package")), "package", "left_anti")
