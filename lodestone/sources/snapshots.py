"""Stored tables: snapshots in the shared folder, staged overwrites, segments with a done marker."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one only on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _own[0]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: a table that outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, new = _fs(spark, path)
    return fs.exists(new(path))


def load(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``; after a crash between remove and rename its finished staged copy, which takes its place; empty if neither is there."""
    if not exists(spark, path + "/_SUCCESS") and exists(spark, path + ".new/_SUCCESS"):
        fs, new = _fs(spark, path)
        fs.delete(new(path), True)
        fs.rename(new(path + ".new"), new(path))
    return spark.read.schema(schema).parquet(path) if exists(spark, path + "/_SUCCESS") else spark.createDataFrame([], schema)


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Staged overwrite: write aside, remove the old table, rename. ``df`` may read the old table."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path + ".new")
    fs, new = _fs(df.sparkSession, path)
    fs.delete(new(path), True)
    if not fs.rename(new(path + ".new"), new(path)):
        raise OSError(f"can't rename {path}.new")


def export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


class Segments:
    """Numbered folders under ``root``; one counts once it has a ``.done`` marker."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def order(name: str) -> tuple:
        """Numbers by value, after all other names."""
        return (1, int(name), "") if re.fullmatch(r"\d+", name) else (0, 0, name)

    def all(self) -> list[str]:
        fs, new = _fs(self.spark, self.root)
        if not fs.exists(new(self.root)):
            return []
        return sorted((s.getPath().getName() for s in fs.listStatus(new(self.root)) if s.isDirectory()), key=self.order)

    def is_done(self, name: str) -> bool:
        return exists(self.spark, f"{self.root}/{name}/.done")

    def done(self) -> list[str]:
        return [n for n in self.all() if self.is_done(n)]

    def max_done(self) -> str | None:
        return max(self.done(), key=self.order, default=None)

    def new(self) -> str:
        """The smallest number not in use."""
        used, n = set(self.all()), 0
        while str(n) in used:
            n += 1
        return self._make(str(n))

    def new_max(self) -> str:
        """One more than the greatest name; 0 if there is none or it is no number."""
        top = max(self.all(), key=self.order, default="")
        return self._make(str(int(top) + 1) if top.isdigit() else "0")

    def _make(self, name: str) -> str:
        fs, new = _fs(self.spark, self.root)
        fs.mkdirs(new(f"{self.root}/{name}"))
        return name

    def finish(self, name: str) -> None:
        fs, new = _fs(self.spark, self.root)
        fs.create(new(f"{self.root}/{name}/.done")).close()

    @property
    def inbox(self) -> str:
        """Where finished segments are announced, one small file each, for a stream to pick up."""
        return f"{self.root}-finished"

    def announce(self, name: str) -> None:
        """Says that a segment is finished. The file is written aside and renamed, as a stream reads a file once."""
        fs, new = _fs(self.spark, self.root)
        fs.mkdirs(new(self.inbox))
        aside = new(f"{self.inbox}/.{name}")
        stream = fs.create(aside, True)
        stream.write(bytearray(('{"segment": "' + name + '"}\n').encode()))
        stream.close()
        fs.rename(aside, new(f"{self.inbox}/{name}-{uuid.uuid4().hex}.json"))

    def remove(self, name: str) -> None:
        fs, new = _fs(self.spark, self.root)
        fs.delete(new(f"{self.root}/{name}"), True)

    def clear_undone(self) -> None:
        for n in set(self.all()) - set(self.done()):
            self.remove(n)

    def clear_outdated(self) -> None:
        top = self.max_done()
        for n in self.all():
            if n != top:
                self.remove(n)


def newest(names: DataFrame, col: str = "name") -> DataFrame:
    """The greatest segment name of a table of names, in the order of ``Segments.order``."""
    number = F.col(col).try_cast("int")
    return names.agg(F.max_by(col, F.struct(number.isNotNull(), number, F.col(col))).alias("name"))


def next_free(names: DataFrame, col: str = "name") -> DataFrame:
    """The smallest number that no name of a table of segment names is."""
    used = names.select(F.col(col).try_cast("int").alias("n")).filter("n >= 0").distinct()
    after = used.select((F.col("n") + 1).alias("n")).unionByName(names.sparkSession.range(1).select(F.col("id").cast("int").alias("n")))
    return after.join(used, "n", "left_anti").agg(F.min("n").alias("name"))


def next_max(names: DataFrame, col: str = "name") -> DataFrame:
    """One more than the greatest name; 0 if there is none or it is no number."""
    return newest(names, col).select(F.coalesce(F.col("name").try_cast("int") + 1, F.lit(0)).alias("name"))


def links(df: DataFrame, json_col: str) -> DataFrame:
    """Exploded elements of a JSON array of strings."""
    return df.select(F.explode(F.from_json(json_col, "array<string>")).alias("package"))


def listed(df: DataFrame, json_col: str) -> DataFrame:
    """Paths of a package list payload: ``{"results": [{"path": ...}]}``."""
    return df.select(F.explode(F.from_json(json_col, "results array<struct<path:string>>")["results"]).alias("r")).select(F.col("r.path").alias("package"))


def canned(requests: DataFrame, responses: DataFrame, on: str = "uri") -> DataFrame:
    """Requests with the stored body and status 200, or 404 without one."""
    return requests.join(responses, on, "left").withColumn("status", F.when(F.col("body").isNull(), 404).otherwise(200))


def cache_counts(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose contents the cache holds, files it misses, and signatures that are saved for these."""
    known = files.select("sha").join(cache.select("sha").withColumn("__hit", F.lit(True)), "sha", "left")
    return known.agg(F.count_if("__hit").alias("hit"), F.count_if(F.col("__hit").isNull()).alias("missed"), F.countDistinct(F.when(F.col("__hit").isNull(), F.col("sha"))).alias("sign_saved"))


def count_files(df: DataFrame) -> DataFrame:
    """Part files that hold rows, and rows."""
    return df.select(F.input_file_name().alias("f")).agg(F.countDistinct("f").alias("files"), F.count("*").alias("entries"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object for each row; the folder counts once its marker is there."""
    df.write.mode("overwrite").json(path)


def cached(files: DataFrame, cache: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """Parsed contents by signature: from the cache where it holds them, else by ``parse``; and what is new to the cache."""
    known = files.join(cache.withColumn("__hit", F.lit(True)), "sha", "left")
    fresh = parse(known.filter("__hit IS NULL").select(*files.columns)).select("sha", "info").dropDuplicates(["sha"])
    out = known.filter("__hit").select(*files.columns, "info").unionByName(files.join(fresh, "sha"))
    return out, fresh
