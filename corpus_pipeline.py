"""The corpus pipeline: quality classifier, near-dedup, decontamination, mixing, sharding.

Each stage reads what its predecessor wrote and works on all of it; all but the
last return the columns of ``documents``, whatever else these are called.

In every stage an empty table gives no rows, repeated rows are treated alike
(near-dedup keeps one of those equal in id and text), texts of any length are
read whole, and a null text counts as empty, but for near-dedup, where it stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, minhash, mixing, quality_classifier, sharding
from lodestone.llm.common import materialize, text_of, unused, word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects. It learns from the labelled rows of this stage's input.

    Without labels every score is 0.5, which is a rejection; null texts are judged as empty ones.
    """
    return quality_classifier.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that with the least id. Null texts and null ids stay."""
    return minhash.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in benchmark windows; texts without words stay."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or twice. Texts without words are not taken."""
    clash = [c for c in docs.columns if c.lower() in ("size", "sources", "source_sizes", "targets", "copies", "taken")]
    aside = dict(zip(clash, unused(docs.columns, *[f"in_{c}" for c in clash]), strict=True))
    mixed = mixing.mix_documents(docs.withColumnsRenamed(aside), word_count(text_of("text")))
    (copy,) = unused(mixed.columns, "copy_")
    repeated = mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row of the mix; null texts are sharded as empty ones."""
    return sharding.shard_documents(docs, carry=["doc_id", "source"])


STAGES = [("quality classifier", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
# No SQL: classifier, near-dedup and mixing can't be written in it; the tests hold each stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
