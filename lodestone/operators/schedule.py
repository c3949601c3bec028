"""Crawl entries: what is due, in which order, and how entries change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshots import keep
from .graph import placed

VERSION = 5


def due(entries: DataFrame, now: Column) -> DataFrame:
    """Entries of another version, or whose time has come."""
    return entries.filter((F.col("version") != VERSION) | (F.col("schedule_time") <= now))


def without_vendor(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.col("id").contains("/vendor/"))


def on_hosts(entries: DataFrame, hosts: list[str], never: tuple[str, ...] = ()) -> DataFrame:
    """Entries of the hosts to crawl that are not among those ``never`` to crawl."""
    return entries.filter(F.col("host").isin(hosts) & ~F.col("host").isin(*never))


def skipped(entries: DataFrame, now: Column) -> DataFrame:
    """How many due entries the vendor rule leaves out."""
    return due(entries, now).agg(F.count_if(F.col("id").contains("/vendor/")).alias("vendors"))


def ordered(rows: DataFrame) -> DataFrame:
    """Adds ``place`` (from 1): unknown packages first, then the earliest, within each host.

    Ranges of the whole order are counted, so that a host with most of the
    entries is not one task.
    """
    out = keep(placed(rows, [F.asc("host"), F.asc("in_docs"), F.asc("schedule_time"), F.asc("id")]), "queue")
    # one row for each host
    first = out.groupBy("host").agg(F.min("place").alias("__first"))
    return out.join(F.broadcast(first), "host").withColumn("place", F.col("place") - F.col("__first") + 1).drop("__first")


def queue(entries: DataFrame, docs: DataFrame, now: Column, hosts: list[str], never: tuple[str, ...] = ()) -> DataFrame:
    """Due entries with ``in_docs``; unknown packages first, then the earliest, within each host."""
    known = docs.select(F.col("package").alias("id")).distinct().withColumn("in_docs", F.lit(True))
    rows = on_hosts(without_vendor(due(entries, now)), hosts, never).join(known, "id", "left").withColumn("in_docs", F.coalesce("in_docs", F.lit(False)))
    return current_etags(rows)


def write_queue(rows: DataFrame, path: str) -> None:
    """One folder for each host, files sorted in crawl order."""
    rows.repartitionByRange("host", "in_docs", "schedule_time", "id").sortWithinPartitions("host", "in_docs", "schedule_time", "id").write.mode("overwrite").partitionBy("host").parquet(path)


def dealt(key: Column, seed: int, among: int) -> Column:
    """A number below ``among`` that only key and seed decide, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % among


def forget_etags(entries: DataFrame, one_in: int = 10, seed: int = 0) -> DataFrame:
    """Every so-manieth entry, by hash, loses its etag and so is read anew."""
    return entries.withColumn("etag", F.when(dealt(F.col("id"), seed, one_in) == 0, "").otherwise(F.col("etag")))


def current_etags(entries: DataFrame) -> DataFrame:
    """Entries of an older version have no etag that counts."""
    return entries.withColumn("etag", F.when(F.col("version") < VERSION, "").otherwise(F.col("etag")))


def age_statistics(rows: DataFrame, now: Column) -> DataFrame:
    """For each host: the greatest age in hours with its id, the mean age, counts."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("schedule_time")) / 3600.0
    own = rows.withColumn("age", age)
    return own.groupBy("host").agg(
        F.max("age").alias("max_age"), F.min_by("id", F.struct(-F.col("age"), F.col("id"))).alias("max_id"), F.avg("age").alias("mean_age"), F.count("*").alias("n"), F.count_if(~F.col("in_docs")).alias("n_new")
    )


def upsert(entries: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return entries.join(new.select(key), key, "left_anti").unionByName(new)


def delete(entries: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return entries.join(keys.select(key), key, "left_anti")


def push(entries: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Keys are due now unless they are earlier already; etag and version stay."""
    asked = keys.select("id").distinct().withColumn("__asked", F.lit(True))
    out = entries.join(asked, "id", "full")
    return out.select(
        "id", F.coalesce("host", F.substring_index("id", "/", 1)).alias("host"), F.when(F.col("__asked"), F.least(F.coalesce("schedule_time", now), now)).otherwise(F.col("schedule_time")).alias("schedule_time"),
        F.coalesce("version", F.lit(VERSION)).alias("version"), F.coalesce("etag", F.lit("")).alias("etag"),
    )


def append_new(entries: DataFrame, found: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Found packages that are to be scheduled now: not there, or there later than now while no document exists."""
    own = found.select("id").distinct().join(entries.select("id", "schedule_time"), "id", "left").join(docs.select(F.col("package").alias("id")).distinct().withColumn("in_docs", F.lit(True)), "id", "left")
    skip = F.col("schedule_time").isNotNull() & ((F.col("schedule_time") < now) | F.coalesce("in_docs", F.lit(False)))
    return own.filter(~skip).select("id", now.alias("schedule_time"), F.lit(VERSION).alias("version"), F.lit("").alias("etag"))


def next_crawl(now: Column, days: int, key: Column, seed: int = 0) -> Column:
    """``days`` from now, plus or minus a tenth by the hash of ``key``."""
    spread = dealt(key, seed, 1_000_001) / 1_000_000.0
    return F.timestamp_seconds(F.unix_timestamp(now) + (days * 86400 * (0.9 + 0.2 * spread)).cast("long"))


def after_failure(now: Column, person: bool) -> Column:
    return now + F.expr("INTERVAL 12 HOURS" if person else "INTERVAL 10 DAYS")


def broken(entries: DataFrame, docs: DataFrame, like_folder) -> DataFrame:
    """Entries without a document whose path is no plausible package, or repeats itself."""
    parts = F.split("id", "/")
    n = F.size(parts)
    half = F.floor((n - 4) / 2).cast("int")
    odd_end = (n >= 4) & ~like_folder(F.element_at(parts, -1))
    twice = (n >= 6) & (n % 2 == 0) & (F.slice(parts, F.lit(4), F.greatest(half, F.lit(0))) == F.slice(parts, F.lit(4) + half + 1, F.greatest(half, F.lit(0))))
    return entries.join(docs.select(F.col("package").alias("id")), "id", "left_anti").filter(odd_end | twice)


def outcomes(results: DataFrame, stop: Column, pause: int = 10) -> DataFrame:
    """What follows from crawl results (part, seq, at, package, outcome, forbidden) of parts worked off in order.

    ``outcome``: ``invalid`` (a bad path), ``failed``, ``same`` (not modified) or
    ``ok``. Rows from the first one after ``stop`` on are not worked off. Adds
    ``action`` (delete or update), ``event`` of the history, ``next`` (what is
    scheduled: nothing for bad paths, ``failure`` or ``age``) and ``pauses``:
    after ``pause`` failures in a row, or one forbidden access, which both start
    the count anew; only successes interrupt a row.
    """
    order = Window.partitionBy("part").orderBy("seq")
    rows = results.withColumn("__late", F.max((F.col("at") > stop).cast("int")).over(order)).filter("__late = 0").drop("__late")
    failed = F.col("outcome") == "failed"
    good = F.col("outcome").isin("ok", "same")
    rows = rows.withColumn("__forbidden", failed & F.col("forbidden"))
    breaks = (good | F.lag("__forbidden", 1, False).over(order)).cast("int")
    rows = rows.withColumn("__run", F.sum(breaks).over(order))
    nth = F.sum(failed.cast("int")).over(Window.partitionBy("part", "__run").orderBy("seq"))
    return rows.withColumn("pauses", failed & (F.col("forbidden") | (nth % pause == 0))).drop("__run", "__forbidden").withColumns(
        {
            "action": F.when(F.col("outcome") == "invalid", "delete").when(F.col("outcome") == "ok", "update"),
            "event": F.when(good, "Success").when(failed, "Failed").otherwise("Invalid"),
            "next": F.when(failed, "failure").when(good, "age"),
        }
    )
