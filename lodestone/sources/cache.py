"""A cache of parsed contents by signature, counted in the pass that uses it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .snapshots import keep


@dataclass
class Passed:
    """``rows``: files with their ``info``; ``fresh``: (sha, info) to be put into the cache; ``counts``: what happened."""

    rows: DataFrame
    fresh: DataFrame
    counts: dict[str, int]


def through(files: DataFrame, cache: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> Passed:
    """Files (sha, ...) through a cache (sha, info): what it holds is taken, what it misses is parsed, once for each signature.

    An entry without contents can't be read: it counts as ``get_error`` and its
    files are parsed. What parsing gives no contents for can't be saved
    (``set_error``). Counters come with the writing passes; the files are read
    once. ``parse`` makes (sha, info) of rows of ``files``.
    """
    seen, saved = Observation(), Observation()
    held = cache.select("sha", "info", F.lit(True).alias("__held"))
    known = files.join(held, "sha", "left")
    there, broken = F.col("__held").isNotNull(), F.col("__held").isNotNull() & F.col("info").isNull()
    known = known.observe(seen, F.count_if(there & ~broken).alias("hit"), F.count_if(~there).alias("missed"), F.count_if(broken).alias("get_error"))
    known = keep(known, "cache-pass")
    missed = known.filter("info IS NULL").select(*files.columns)
    # one file of each signature
    parsed = parse(missed.dropDuplicates(["sha"])).select("sha", "info")
    parsed = keep(parsed.observe(saved, F.count_if(F.col("info").isNotNull()).alias("sign_saved"), F.count_if(F.col("info").isNull()).alias("set_error")), "cache-new")
    rows = known.filter("info IS NOT NULL").drop("__held").unionByName(missed.join(parsed, "sha", "left"))
    return Passed(rows, parsed.filter("info IS NOT NULL"), {k: int(v) for k, v in (seen.get | saved.get).items()})
