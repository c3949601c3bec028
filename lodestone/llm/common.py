"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java character class body.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(shared_dir, "_own", None) or tempfile.mkdtemp(prefix="lodestone-")
        shared_dir._own = path
        path = f"file://{path}" if path.startswith("/") else path
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    ``slim``: rows are a few numbers or keys; four files for each core of the cluster are enough.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df = df.coalesce(4 * max(1, spark.sparkContext.defaultParallelism)) if slim else df
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            spark = df.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unused(columns: list[str], *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores as set it apart from all ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(id_col: str) -> Column:
    """True for the rows whose labels must not be learned from (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space."""
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+")).cast("long")
