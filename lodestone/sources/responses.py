"""Saved responses of remote services as a data source.

``spark.read.format("responses").load(path)`` gives (kind, key, status, body).
Responses are stored by kind (search, user, repository, tree, contents ...) and
bucket of their key. Filters on kind and key are pushed down: only partitions
that may hold what is asked for are read, and each is a task. A request without
a saved response has no row; ``answered`` gives it the status 404.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "kind string, key string, status int, body string"
BUCKETS = 16


def save(responses: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Stores (kind, key, status, body) for the data source, the latest saved instead of what was there."""
    out = responses.select("kind", "key", F.col("status").cast("int").alias("status"), "body", F.col("kind").alias("of"), (F.crc32(F.col("key").cast("binary")) % buckets).cast("int").alias("bucket"))
    out.repartition("of", "bucket").write.mode("overwrite").partitionBy("of", "bucket").parquet(path)


class Partition(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class Reader(DataSourceReader):
    def __init__(self, path: str, buckets: int):
        self.path, self.buckets = path, buckets
        self.kinds: set[str] | None = None
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists of kinds and keys tell partitions apart and are applied to rows; all others stay with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("kind",), ("key",)):
                yield f
            elif f.attribute == ("kind",):
                self.kinds = values if self.kinds is None else self.kinds & values
            else:
                self.keys = values if self.keys is None else self.keys & values

    def partitions(self) -> list[Partition]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, root = FileSystem.from_uri(self.path)
        wanted = None if self.keys is None else {zlib.crc32(k.encode()) % self.buckets for k in self.keys if k is not None}
        out = []
        for kind in fs.get_file_info(FileSelector(root, allow_not_found=True)):
            if kind.type != FileType.Directory or not kind.base_name.startswith("of="):
                continue
            if self.kinds is not None and kind.base_name[3:] not in self.kinds:
                continue
            for bucket in fs.get_file_info(FileSelector(kind.path)):
                if bucket.base_name.startswith("bucket=") and (wanted is None or int(bucket.base_name[7:]) in wanted):
                    out.append(Partition(bucket.path))
        return sorted(out, key=lambda p: p.folder) or [Partition("")]

    def read(self, partition: Partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector, FileSystem

        if not partition.folder:
            return
        fs, _ = FileSystem.from_uri(self.path)
        for f in fs.get_file_info(FileSelector(partition.folder)):
            if not f.base_name.endswith(".parquet"):
                continue
            with fs.open_input_file(f.path) as file:
                for b in pq.ParquetFile(file).iter_batches(columns=["kind", "key", "status", "body"]):
                    for column, asked in (("kind", self.kinds), ("key", self.keys)):
                        if asked is not None:
                            b = b.filter(pc.is_in(b.column(column), pa.array(sorted(x for x in asked if x is not None), pa.string())))
                    if b.num_rows:
                        yield b


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("buckets", BUCKETS)))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)


def answered(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """(kind, key) with the saved status and body, 404 without one."""
    return requests.join(saved, ["kind", "key"], "left").withColumn("status", F.coalesce("status", F.lit(404)))
