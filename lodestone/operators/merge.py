"""Merging documents with update and delete actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def merge(actions: DataFrame, *payload: str) -> DataFrame:
    """One row for each package: (package, last_updated, payload..., status).

    Any delete action deletes. Otherwise the latest row wins, the original on
    equal times. Status: ``deleted``, ``new`` (no original), ``updated`` (an
    action won over the original) or ``unchanged``.
    """
    original = F.col("action") == "original"
    live = F.col("action") != "delete"
    win = F.struct("last_updated", original.cast("int").alias("original"))
    row = F.struct("last_updated", original.alias("original"), *payload)
    found = actions.groupBy("package").agg(
        F.bool_or(F.col("action") == "delete").alias("gone"), F.bool_or(original).alias("known"),
        F.max_by(F.when(live, row), F.when(live, win)).alias("row"),
    )
    status = F.when(F.col("gone"), "deleted").when(~F.col("known"), "new").when(F.col("row.original"), "unchanged").otherwise("updated")
    return found.select("package", "row.last_updated", *[f"row.{c}" for c in payload], status.alias("status"))


def live(merged: DataFrame) -> DataFrame:
    return merged.filter("status <> 'deleted'")


def counters(merged: DataFrame) -> DataFrame:
    return merged.groupBy("status").agg(F.count("*").alias("n"))


def drop_matching(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """Packages that match none of the patterns."""
    return docs.filter(~F.col("package").rlike("|".join(f"({p})" for p in patterns))) if patterns else docs


STATUSES = ("new", "updated", "unchanged", "deleted")


def observed(merged: DataFrame) -> tuple[DataFrame, Observation]:
    """``merged`` with an observation of how many rows have each status: known once an action, such as writing, has run over it."""
    counts = Observation()
    return merged.observe(counts, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]), counts
