"""Partitions by day, cut into files of equal rows, and their overwrite by late arrivals.

A table has one row for each key, that which arrived last. It is laid out in
folders by day, each sorted by time and key and cut into files of so many rows.
Rows that arrive late replace rows of days long written: those days, and only
those, are written anew.

A first shuffle (``repartitionAndSortWithinPartitions`` by key, sorted by key
and arrival) folds, in one streaming pass, the last early row and the last row
of every key. A second one (by day, time and key) cuts the files: its partitions
begin where files begin, so that a task streams whole files to Spark's writer
and holds none of them. Where files begin is read off ranks in a range
partitioning of the three sort columns. Overwriting is Spark's dynamic partition
overwrite, which replaces a day only when its job commits; the first fold is a
written table, so a lost executor repeats its own tasks only.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, shared_dir, unused

DAY = 86_400_000_000
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
#: Keys of which a task holds the winners before it sends them on; a key with very many rows sends few.
HELD = 20_000


def micros(col: str, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a time without a zone (taken as UTC) or with one."""
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"CAST(1000000 * CAST(CAST(`{col}` - {EPOCH} AS INTERVAL SECOND) AS DECIMAL(20, 6)) AS BIGINT)")
    return F.unix_micros(F.col(f"`{col}`").cast("timestamp"))


def from_micros(col: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, CAST(`{col}` AS DECIMAL(20, 0)) / 1000000)")
    return F.timestamp_micros(F.col(f"`{col}`"))


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampType | T.TimestampNTZType)


def winners(rows: DataFrame, cutoff: int, id_col: str, time_col: str, arrived_col: str) -> DataFrame:
    """(day, sold, key, started, kept, c0, c1 ...): the rows that some layout has, with times as microseconds.

    ``started``: the last of the key's rows that arrived before ``cutoff``
    (microseconds); ``kept``: the last of all. Rows of unknown arrival come
    before all others and aren't early; of equal arrivals one wins, the same in
    every run. Rows without a key are taken as one key.
    """
    spark, fields = rows.sparkSession, rows.schema.fields
    kinds = {f.name: f.dataType for f in fields}
    sold, arrived = micros(time_col, kinds[time_col]), micros(arrived_col, kinds[arrived_col])
    day = F.coalesce(F.floor(sold / F.lit(DAY).cast("decimal(20,0)")).cast("long"), F.lit(-1).cast("long"))
    carried = [(micros(f.name, f.dataType) if is_time(f.dataType) else F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)]
    # equal arrivals: by the hash of the whole row
    given = rows.select(F.col(f"`{id_col}`").alias("key"), arrived.alias("arrived"), F.xxhash64(*[F.col(f"`{f.name}`") for f in fields]).alias("tie"), day.alias("day"), sold.alias("sold"), *carried)

    def keyed(it: Iterator) -> Iterator:
        """Each key's winners so far, in a table of bounded size."""
        held: dict = {}
        for key, arrived, tie, *rest in it:
            early = arrived is not None and arrived < cutoff
            own = (key is not None, key, early)
            order = (arrived is not None, arrived, tie)
            if own not in held or held[own][0] < order:
                held[own] = (order, rest)
            if len(held) >= HELD:
                for (known, key, _), (order, rest) in held.items():
                    yield (known, key, *order), rest
                held.clear()
        for (known, key, _), (order, rest) in held.items():
            yield (known, key, *order), rest

    def fold(it: Iterator) -> Iterator:
        """Streams over the sorted rows of each key."""
        now, started, last = None, None, None

        def out():
            if started is not None and started is not last:
                yield (started[0], started[1], now[1], True, False, *started[2:])
            if last is not None:
                yield (last[0], last[1], now[1], started is last, True, *last[2:])

        for key, row in it:
            if key[:2] != now:
                yield from out()
                now, started, last = key[:2], None, None
            last = row
            if key[2] and key[3] < cutoff:
                started = row
        yield from out()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda key: key[1] if isinstance(key[1], int) else zlib.crc32(repr(key[1]).encode())  # noqa: E731  the same in every worker
    folded = given.rdd.mapPartitions(keyed).repartitionAndSortWithinPartitions(n, spread).mapPartitions(fold)
    own = [T.StructField(f"c{i}", T.LongType() if is_time(f.dataType) else f.dataType) for i, f in enumerate(fields)]
    head = [T.StructField("day", T.LongType()), T.StructField("sold", T.LongType()), T.StructField("key", kinds[id_col]), T.StructField("started", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    return spark.createDataFrame(folded, T.StructType(head + own), verifySchema=False)


def starts_of(rows: DataFrame, size: int) -> list[tuple]:
    """The first (day, sold, key) of every file, in order: at most total / size, and one for each day."""
    order = ["day", "sold", "key"]
    # a number in the upper bits is the range, in the lower the place in it
    ranged = materialize(rows.select(order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "late-ranges")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy("part", "day").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("day").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", "day", "first", F.coalesce(before, F.lit(0)).alias("before"))
    found = ranged.join(counts, ["part", "day"]).filter((F.col("before") + F.col("at") - F.col("first")) % size == 0).select(order).collect()
    discard(ranged)
    return sorted(place(*r) for r in found)


def place(day: int, sold: int | None, key) -> tuple:
    """Sort key of a row within all; rows without a time or key come first."""
    return day, sold is not None, sold, key is not None, key


def write_cut(rows: DataFrame, fields: list[T.StructField], root: str, size: int, mode: str) -> None:
    """Write ``rows`` (as ``winners`` has them) in folders by day, in files of ``size`` rows."""
    spark = rows.sparkSession
    starts = starts_of(rows, size)
    if not starts:
        return
    tasks = min(len(starts), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    dealt = lambda key: (bisect_right(starts, key) - 1) * tasks // len(starts)  # noqa: E731  whole files, neighbours together
    kept = rows.drop("started", "kept")
    cut = kept.rdd.map(lambda r: (place(r[0], r[1], r[2]), tuple(r))).repartitionAndSortWithinPartitions(tasks, dealt).values()
    out = spark.createDataFrame(cut, kept.schema, verifySchema=False)
    (day,) = unused([f.name for f in fields], "day")
    # the writer asks for rows sorted by folder; this order holds that, and the rows are in it already
    out = out.sortWithinPartitions("day", "sold", "key")
    columns = [(from_micros(f"c{i}", f.dataType) if is_time(f.dataType) else F.col(f"c{i}")).alias(f.name) for i, f in enumerate(fields)]
    out = out.select(*columns, F.col("day").alias(day))
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", size).partitionBy(day).parquet(root)


def lay_out(rows: DataFrame, cutoff: int, size: int, root: str, id_col: str = "sale_id", time_col: str = "sold_at", arrived_col: str = "arrived_at") -> DataFrame:
    """Write the early layout below ``root`` and overwrite what late rows touch; (day): the days written twice.

    Early rows arrived before ``cutoff`` (microseconds since 1970). A day is
    written anew if a late row is kept there, or if a row stood there at the
    start whose key is now elsewhere; a day that keeps no row is removed. Other
    files stay as they are. Rows without a time are of day -1. Empty tables
    leave an empty folder. Files have the columns of ``rows`` in their order,
    whatever these are called; the folders are called ``day``, or with
    underscores if there is such a column.
    """
    spark, fields = rows.sparkSession, rows.schema.fields
    path, hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    path(root).getFileSystem(hadoop).mkdirs(path(root))
    won = materialize(winners(rows, cutoff, id_col, time_col, arrived_col), "late-winners")
    write_cut(won.filter("started"), fields, root, size, "append")
    touched = materialize(won.filter("NOT (started AND kept)").select("day").distinct(), "late-days", slim=True)
    write_cut(won.filter("kept").join(touched, "day", "left_semi").select(won.columns), fields, root, size, "overwrite")
    (day,) = unused([f.name for f in fields], "day")
    for r in touched.join(won.filter("kept").select("day").distinct(), "day", "left_anti").collect():  # days, not rows
        gone = path(f"{root}/{day}={r['day']}")
        gone.getFileSystem(hadoop).delete(gone, True)
    discard(won)
    return touched


def digests(ids: DataFrame) -> DataFrame:
    """(path, ids_sha256) of (path, row, id): the ids of each file, comma-joined in file order, hashed as a stream."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        done: list[tuple] = []
        for b in it:
            for path, id_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = path, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(id_.encode())
        if now is not None:
            done.append((now, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], names=["path", "ids_sha256"])

    given = ids.select("path", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "row").repartition("path").sortWithinPartitions("path", "row")
    return given.select("path", "id").mapInArrow(run, "path string, ids_sha256 string")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def describe(spark: SparkSession, root: str, schema: T.StructType, touched: DataFrame, id_col: str = "sale_id", time_col: str = "sold_at", arrived_col: str = "arrived_at", amount_col: str = "total") -> DataFrame:
    """One row for each file below ``root``, read back from it.

    ``day``, ``file_no`` (in the order of the rows of the day), ``n_rows``,
    ``cents`` (sum of the amounts in hundredths, half up; null and non-finite
    amounts count 0), ``rows_crc`` (sum of the CRC-32 of key, time and arrival),
    ``path``, ``columns``, ``ids_sha256`` and ``rewritten``.
    """
    kinds = {f.name: f.dataType for f in schema.fields}
    (day,) = unused(schema.names, "day")
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField(day, T.LongType())])).parquet(root)
    sold, arrived = micros(time_col, kinds[time_col]), micros(arrived_col, kinds[arrived_col])
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    amount = F.col(f"`{amount_col}`").cast("double")
    cents = F.when(F.abs(amount) < 9e16, F.floor(100 * amount + 0.5)).otherwise(0)
    rows = read.select(
        F.col(f"`{day}`").alias("day"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.col(f"`{id_col}`").alias("id"), sold.alias("sold"),
        F.coalesce(cents, F.lit(0)).cast("long").alias("cents"), F.crc32(F.concat_ws(":", text(F.col(f"`{id_col}`")), text(sold), text(arrived)).cast("binary")).alias("crc"),
    )
    files = rows.groupBy("day", "path").agg(F.count("*").alias("n_rows"), F.sum("cents").alias("cents"), F.sum("crc").alias("rows_crc"), F.min(F.struct("sold", "id")).alias("first"))
    # files of a day, not rows
    files = files.withColumn("file_no", (F.row_number().over(Window.partitionBy("day").orderBy("first")) - 1).cast("long"))
    files = files.join(digests(rows), "path").join(touched.select("day", F.lit(True).alias("again")), "day", "left")
    return files.select("day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(",".join(schema.names)).alias("columns"), "ids_sha256", F.coalesce("again", F.lit(False)).alias("rewritten"))
