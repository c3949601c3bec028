"""Minimax contiguous sharding of documents by bytes.

Groups of equal texts are atomic and ordered by a hash of their text; a group
larger than a fair share becomes a shard of its own. The smallest feasible
capacity over the ordered groups is found by binary search with a greedy check,
and the cuts are made under it.

The driver never holds all groups. It holds ranges of the hash with their sizes
(65,536 at first) and splits only those ranges that a cut may lie in, again and
again, until these are single groups. What is far from a cut needs no finer
ranges, so the capacity is that over the groups themselves; the cuts are a few
hash values, and a document's shard follows from comparisons with them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

#: Bits of the hash in the first ranges, and those that each split adds.
FIRST_BITS, MORE_BITS = 16, 8


def feasible(prefix: np.ndarray, start: int, shards: int, capacity: int) -> bool:
    """Whether the atoms from ``start`` on fit greedily into ``shards`` shards of ``capacity``."""
    n = len(prefix) - 1
    for _ in range(shards):
        if start >= n:
            return True
        start = int(np.searchsorted(prefix, prefix[start] + capacity, side="right")) - 1
    return start >= n


def minimax_capacity(sizes, shards: int) -> int:
    """The smallest capacity under which ordered ``sizes`` fit contiguously into ``shards``."""
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    total = int(prefix[-1])
    low = max(int(max(sizes, default=0)), -(-total // max(shards, 1)))
    high = max(low, total)
    while low < high:
        mid = (low + high) // 2
        if feasible(prefix, 0, shards, mid):
            high = mid
        else:
            low = mid + 1
    return low


def cuts(sizes, shards: int) -> list[int]:
    """Ends of the shards (atom positions): none above the minimax capacity, each near the mean of what is left."""
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    n, capacity, start, ends = len(prefix) - 1, minimax_capacity(sizes, shards), 0, []
    for k in range(shards, 0, -1):
        most = int(np.searchsorted(prefix, prefix[start] + capacity, side="right")) - 1
        share = prefix[start] + (prefix[n] - prefix[start]) / k
        near = int(np.searchsorted(prefix, share, side="left"))
        if near > start and near <= n and share - prefix[near - 1] < prefix[near] - share:
            near -= 1
        end = n if k == 1 else min(max(near, start), most)
        if not feasible(prefix, end, k - 1, capacity) and k > 1:
            end = most
        ends.append(end)
        start = end
    return ends


def reach(prefix: np.ndarray, shards: int, capacity: int, whole: bool) -> list[int]:
    """How far the first k shards of ``capacity`` get, for each k: in bytes, or only to ends of ranges (``whole``)."""
    out, at = [], 0
    for _ in range(shards):
        at += capacity
        if whole:
            at = int(prefix[np.searchsorted(prefix, at, side="right") - 1])
        out.append(min(at, int(prefix[-1])))
    return out


def undecided(sizes: np.ndarray, single: np.ndarray, shards: int) -> np.ndarray:
    """Positions of ranges of several groups in which a cut may lie, whatever their groups are."""
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    high = minimax_capacity(sizes, shards)
    low = max(-(-int(prefix[-1]) // max(shards, 1)), int(sizes[single].max(initial=0)))
    # no cut before where shards of the least capacity get by whole ranges, none behind where those of the highest get by bytes
    first, last = reach(prefix, shards - 1, low, True), reach(prefix, shards - 1, high, False)
    # cuts are made near the mean of what is left, so within one range of it too
    out = np.zeros(len(sizes), dtype=bool)
    for a, b in zip(first, last, strict=True):
        i, j = np.searchsorted(prefix, a, side="right") - 1, np.searchsorted(prefix, b, side="left")
        out[max(0, i - 1) : j + 1] = True
    return np.nonzero(out & ~single)[0]


def ordered_sizes(groups: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of hash ranges in order; those a cut may lie in are single groups.

    ``groups``: (h, s), one row for each group.
    """

    def ranges(df: DataFrame, bits: int):
        rows = df.groupBy(F.shiftright("h", 64 - bits).alias("range")).agg(F.min("h").alias("start"), F.sum("s").alias("size"), F.count("*").alias("n")).toPandas()
        rows["bits"] = bits
        return rows

    known = ranges(groups, FIRST_BITS).sort_values("start").reset_index(drop=True)
    while len(known):
        todo = undecided(known["size"].to_numpy(np.int64), (known["n"] == 1).to_numpy(), shards)
        if not len(todo):
            break
        split = known.loc[todo]
        fresh = []
        for bits, rows in split.groupby("bits"):
            wanted = [int(x) for x in rows["range"]]
            # at most shards ranges each way of every cut
            fresh.append(ranges(groups.filter(F.shiftright("h", 64 - int(bits)).isin(wanted)), min(64, int(bits) + MORE_BITS)))
        known = pd.concat([known.drop(index=todo), *fresh]).sort_values("start").reset_index(drop=True)
    return known["start"].to_numpy(np.int64), known["size"].to_numpy(np.int64)


def shard_documents(docs: DataFrame, n_shards: int = 24, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all) plus ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Size is the UTF-8 bytes of the text plus 8. Null text counts as empty and
    groups with it. Slots run from 0 without gaps in each shard; rows of one
    text may lie apart within their shard. Null, equal and repeated ids make no
    difference, repeated rows get slots of their own. An empty table gives no
    rows. A column of the input that has the name of a result column is replaced
    by it. ``grown_shard`` is null: the law is ``bytes``.
    """
    own = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in own]
    kept = [F.col(f"`{c}`") for c in names]
    hash_, slice_, before_ = unused([*names, *own], "hash_", "slice_", "before_")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = materialize(
        docs.select(*kept, (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias(hash_), F.spark_partition_id().alias(slice_)),
        "shard-slim",
    )
    groups = materialize(slim.groupBy(F.col(hash_).alias("h")).agg(F.sum("size").alias("s")), "shard-groups")
    largest = groups.orderBy(F.desc("s"), "h").limit(n_shards).collect()
    rest, left, giants = int(groups.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]), n_shards, []
    for g in largest:
        if left > 1 and g["s"] * left > rest:
            giants.append(g["h"])
            rest, left = rest - g["s"], left - 1
        else:
            break
    starts, sizes = ordered_sizes(groups.filter(~F.col("h").isin(giants)) if giants else groups, left)
    # the first hash of each shard but the first; a shard that gets nothing has none
    firsts = [int(starts[end]) for end in cuts(sizes, left)[:-1] if end < len(starts)]
    shard = F.lit(len(giants))
    for h in firsts:
        shard = shard + (F.col(hash_) >= h).cast("int")
    for k, h in enumerate(giants):
        shard = F.when(F.col(hash_) == h, k).otherwise(shard)
    rows = slim.withColumn("shard", shard.cast("int"))
    # slots: rows are numbered within (shard, slice of the table as it was written), and these are counted
    counts = rows.groupBy("shard", slice_).agg(F.count("*").alias("n"))
    up = Window.partitionBy("shard").orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", slice_, F.coalesce(F.sum("n").over(up), F.lit(0)).alias(before_))
    place = F.row_number().over(Window.partitionBy("shard", slice_).orderBy(hash_))
    rows = rows.withColumn("slot", place).join(counts, ["shard", slice_])
    return rows.select(*kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col(before_) + F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the documents as Parquet, one folder for each shard, rows by slot within each file.

    Large shards are several files, split by slot. An empty table writes no folders.
    """
    shard_documents(docs, **options).repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
