"""Missing values read as the zero value of their type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def number(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def strings(value: Column) -> Column:
    return F.coalesce(value, F.array().cast("array<string>"))
