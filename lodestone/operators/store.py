"""The store of crawled packages and repositories: scans by site, updates, snapshots, packed values, imports from the web."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import paths
from ..sources.snapshots import Segments, exists, load, save
from . import schedule


def sites(records: DataFrame) -> DataFrame:
    """Distinct sites in code-point order."""
    return records.select("site").distinct().orderBy("site")


def of_site(records: DataFrame, site: str, *order: str) -> DataFrame:
    """The records of one site in the order of their names; a table partitioned by site reads that folder only."""
    return records.filter(F.col("site") == site).orderBy(*order)


def packages_of(records: DataFrame, site: str) -> DataFrame:
    return of_site(records, site, "path")


def repositories_of(records: DataFrame, site: str) -> DataFrame:
    return of_site(records, site, "user", "name")


def update(records: DataFrame, changes: DataFrame, key: list[str], change: dict[str, Column]) -> DataFrame:
    """Read, modify, write: records with a row in ``changes`` get the columns of ``change``; missing records start from nulls.

    ``change`` may use the record's columns and those of the changes, these
    under ``new``. Keys of ``changes`` are distinct.
    """
    own = records.withColumn("__there", F.lit(True))
    asked = changes.select(*key, F.struct(*[c for c in changes.columns if c not in key]).alias("new"))
    both = own.join(asked.withColumn("__asked", F.lit(True)), key, "full")
    return both.select(*[F.when(F.col("__asked"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in records.columns])


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of a store under ``path``, with a marker once all are whole."""
    for name, df in tables.items():
        save(df, f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(0).write.mode("overwrite").parquet(f"{path}/_whole")


def restore(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    if not exists(spark, f"{path}/_whole/_SUCCESS"):
        raise FileNotFoundError(f"no whole snapshot in {path}")
    return {name: load(spark, f"{path}/{name}", schema) for name, schema in schemas.items()}


def packed(records: DataFrame, *key: str) -> DataFrame:
    """Keys and one encoded value; a record that is to be deleted (``action`` delete) carries none."""
    value = F.encode(F.to_json(F.struct(*[c for c in records.columns if c not in (*key, "action")])), "UTF-8")
    if "action" in records.columns:
        return records.select(*key, "action", F.when(F.col("action") != "delete", value).alias("value"))
    return records.select(*key, value.alias("value"))


def unpacked(rows: DataFrame, schema: str) -> DataFrame:
    """The records of packed rows; a value that can't be read gives null fields and is left out."""
    out = rows.withColumn("__v", F.from_json(F.decode("value", "UTF-8"), schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    return out.filter("value IS NULL OR (__v IS NOT NULL AND __v.__bad IS NULL)").select(*[c for c in rows.columns if c != "value"], "__v.*").drop("__bad")


class CrawlTables:
    """The crawler's two tables, packages and persons; ``sync`` writes only what was put since the last time."""

    NAMES = ("package", "person")

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.root = root.rstrip("/")
        self.tables = {n: load(spark, f"{self.root}/{n}", schema) for n in self.NAMES}
        self.changed: set[str] = set()

    def put(self, name: str, new: DataFrame, key: str = "id") -> None:
        self.tables[name] = schedule.upsert(self.tables[name], new, key)
        self.changed.add(name)

    def delete(self, name: str, keys: DataFrame, key: str = "id") -> None:
        self.tables[name] = schedule.delete(self.tables[name], keys, key)
        self.changed.add(name)

    def sync(self) -> list[str]:
        """Names of the tables that were written."""
        done = sorted(self.changed)
        for name in done:
            df = self.tables[name]
            save(df, f"{self.root}/{name}")
            self.tables[name] = df.sparkSession.read.schema(df.schema).parquet(f"{self.root}/{name}")
        self.changed.clear()
        return done


def from_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """Packages of submitted lines: trimmed, and only valid remote paths."""
    return lines.select(paths.trim_name(F.col(col)).alias("package")).filter(paths.valid_remote(F.col("package")))


def submit(spark: SparkSession, root: str, text: str) -> tuple[int, str]:
    """The add page: valid lines go into an import segment of their own. Number of packages, and what to put back into the form."""
    found = from_lines(spark.createDataFrame([(x,) for x in text.split("\n")], "line string"))
    n = found.count()
    if n:
        segments = Segments(spark, root)
        name = segments.new_max()
        found.write.mode("append").json(f"{root}/{name}/packages")
        segments.finish(name)
        segments.announce(name)
    return n, "" if n else text


def drain(spark: SparkSession, root: str, entries: DataFrame, docs: DataFrame, now: Column, sink) -> int:
    """Packages of all finished import segments become new entries, given to ``sink``; then the segments go. Number of segments."""
    segments = Segments(spark, root)
    done = segments.done()
    if done:
        found = spark.read.schema("package string").json([f"{root}/{n}/packages" for n in done])
        sink(schedule.append_new(entries, found.select(F.col("package").alias("id")), docs, now).withColumn("found_way", F.lit("web")))
    for n in done:
        segments.remove(n)
    return len(done)
