"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them). Token capacity flows from the patterns to the quotas of their sources;
the r-th repetition of a pattern costs r, so repeats are spread before anything
is taken a third time. Whole documents are then selected in seeded order until
a pattern's flow is used up.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

WEIGHTS = (3, 1, 2)


def targets(sizes: list[int], weights: list[float], budget: float, most: float = 2.0) -> list[float]:
    """Shares of ``budget`` by weight, none above ``most`` times its size; the excess is reshared by weight."""
    caps = [most * s for s in sizes]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > caps[i]]
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
            open_.discard(i)
    return out


class Network:
    """Arcs in arrays; arc ``e ^ 1`` is the reverse of arc ``e``."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def add(self, a: int, b: int, capacity: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.cap += [capacity, 0]
        return len(self.to) - 2

    def enlarge(self, source: int, sink: int) -> None:
        """Adds to the flow what still fits, by blocking flows over shortest paths."""
        to, cap, out = self.to, self.cap, self.out
        while True:
            level = [-1] * len(out)
            level[source] = 0
            row = [source]
            while row and level[sink] < 0:
                after = []
                for u in row:
                    for e in out[u]:
                        if cap[e] > 0 and level[to[e]] < 0:
                            level[to[e]] = level[u] + 1
                            after.append(to[e])
                row = after
            if level[sink] < 0:
                return
            seen = [0] * len(out)
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    # back to the first arc that is full
                    k = next(i for i, e in enumerate(path) if cap[e] == 0)
                    u = to[path[k] ^ 1]
                    del path[k:]
                    continue
                while seen[u] < len(out[u]):
                    e = out[u][seen[u]]
                    if cap[e] > 0 and level[to[e]] == level[u] + 1:
                        break
                    seen[u] += 1
                else:
                    if u == source:
                        break
                    level[u] = -1
                    u = to[path.pop() ^ 1]
                    continue
                path.append(e)
                u = to[e]


def route(patterns: list[tuple[list, int]], quotas: dict, repeats: int = 2) -> list[dict]:
    """For each (sources, size) the tokens it sends to each source. Unconnected parts are solved apart."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for names, _ in patterns:
        for s in names[1:]:
            parent[root(s)] = root(names[0])
    parts: dict = {}
    for i, (names, _) in enumerate(patterns):
        if names:
            parts.setdefault(root(names[0]), []).append(i)
    out: list[dict] = [{} for _ in patterns]
    for own in parts.values():
        sources = sorted({s for i in own for s in patterns[i][0]}, key=lambda s: (s is None, s))
        node = {s: 1 + len(own) + k for k, s in enumerate(sources)}
        sink = 1 + len(own) + len(sources)
        net = Network(sink + 1)
        takes = [net.add(0, 1 + k, 0) for k in range(len(own))]
        arcs = [(i, s, net.add(1 + k, node[s], repeats * patterns[i][1])) for k, i in enumerate(own) for s in patterns[i][0]]
        for s in sources:
            net.add(node[s], sink, int(quotas[s]))
        # only the arcs out of the source cost something, the r-th repetition r: a path costs what its first arc does,
        # so that the cheapest paths first is all of one repetition before any of the next
        for _ in range(repeats):
            for k, i in enumerate(own):
                net.cap[takes[k]] += patterns[i][1]
            net.enlarge(0, sink)
        for i, s, e in arcs:
            if net.cap[e ^ 1]:
                out[i][s] = net.cap[e ^ 1]
    return out


def mix_documents(
    docs: DataFrame, size: Column, member_col: str = "source", id_col: str = "doc_id", budget: float = 1.5, repeats: int = 2,
    weights=WEIGHTS, seed: int = 7, carry: list[str] | None = None, max_patterns: int = 100_000, bucket_docs: int = 500,
) -> DataFrame:
    """Columns ``carry`` (default: all) plus ``size``, ``sources``, ``source_sizes``, ``targets``, ``copies`` and ``taken``.

    ``member_col`` holds a source or an array of sources; a null source is a
    source of its own, last in order; sources in code-point order take
    ``weights`` in turn. ``copies`` is how often the mix repeats the document
    (0 to ``repeats``), ``taken`` = copies * size. Documents without words take
    nothing. Documents are ordered by a seeded hash of the whole row; rows that
    are equal in everything are selected by their number, one by one. Null or
    repeated ids make no difference. An empty table gives no rows. The number of membership
    patterns must not exceed ``max_patterns`` (it is what the driver holds);
    more raise ValueError. Input columns with a result's name are replaced.
    """
    spark = docs.sparkSession
    own = ("size", "sources", "source_sizes", "targets", "copies", "taken")
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in own]
    pattern, order, row, pid, whole, rest, buckets, bucket, cut, room, some, ties_, tie_size, slice_, before, place = unused(
        [*names, *own], "pattern_", "order_", "row_", "pid_", "whole_", "rest_", "buckets_", "bucket_", "cut_", "room_", "some_", "ties_", "tie_size_", "slice_", "before_", "place_"
    )
    col = lambda c: F.col(f"`{c}`")
    member = col(member_col)
    kind = dict(docs.dtypes)[member_col]
    member = F.array_sort(F.array_distinct(member)) if kind.startswith("array") else F.array(member.cast("string"))
    # the whole row is hashed, so that only rows that are equal in everything tie
    hashed = F.xxhash64(F.lit(seed), size, *[col(c) for c, t in docs.dtypes if not t.startswith("map")])
    slim = materialize(docs.select(*[col(c) for c in names], size.cast("long").alias("size"), F.to_json(member).alias(pattern), hashed.alias(order), F.monotonically_increasing_id().alias(row)), "mix-slim")
    found = slim.groupBy(pattern).agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    found = sorted(found, key=lambda r: r[pattern] or "")
    patterns = [(json.loads(r[pattern]) if r[pattern] else [], r["s"] or 0) for r in found]
    total: dict = {}
    for members, s in patterns:
        for m in members:
            total[m] = total.get(m, 0) + s
    sources = sorted(total, key=lambda m: (m is None, m.encode() if m is not None else b""))
    shares = dict(zip(sources, targets([total[m] for m in sources], [weights[i % len(weights)] for i in range(len(sources))], budget * sum(s for _, s in patterns), repeats), strict=True)) if sources else {}
    flows = route(patterns, {m: round(x) for m, x in shares.items()}, repeats)
    rows = []
    for number, (r, (members, s), flow) in enumerate(zip(found, patterns, flows, strict=True)):
        f = sum(flow.values())
        rows.append((r[pattern], number, f // s if s else 0, f % s if s else 0, max(1, r["n"] // bucket_docs), [m for m in members], [int(total[m]) for m in members], [float(shares[m]) for m in members]))
    # at most max_patterns rows, checked above
    plan = F.broadcast(spark.createDataFrame(rows, f"`{pattern}` string, `{pid}` int, `{whole}` long, `{rest}` long, `{buckets}` long, sources array<string>, source_sizes array<long>, targets array<double>"))
    slim = slim.join(plan, slim[pattern].eqNullSafe(plan[pattern])).drop(pattern).withColumn(bucket, F.pmod(order, buckets))
    # where the running size of a pattern's buckets crosses what is left of its flow: coarse blocks of buckets, then buckets
    fine = slim.groupBy(pid, bucket).agg(F.first(rest).alias("left"), F.sum("size").alias("s")).withColumn("block", F.floor(F.col(bucket) / 1024))
    coarse = fine.groupBy(pid, "block").agg(F.first("left").alias("left"), F.sum("s").alias("s"))
    crosses = "to > left AND to - s <= left"
    up = Window.partitionBy(pid).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    coarse = coarse.withColumn("to", F.sum("s").over(up)).filter(crosses).select(pid, "block", (F.col("left") - F.col("to") + F.col("s")).alias("left"))
    up = Window.partitionBy(pid).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    crossing = (
        fine.drop("left").join(coarse, [pid, "block"]).withColumn("to", F.sum("s").over(up)).filter(crosses)
        .select(pid, F.col(bucket).alias(cut), (F.col("left") - F.col("to") + F.col("s")).alias(room))
    )
    # one row for each pattern at most
    crossing = spark.createDataFrame(crossing.collect(), crossing.schema)
    slim = slim.join(F.broadcast(crossing), pid, "left")
    sure = slim.filter(F.col(cut).isNull() | (F.col(bucket) != F.col(cut))).withColumn("copies", F.col(whole) + F.coalesce((F.col(bucket) < F.col(cut)).cast("int"), F.lit(0)))
    edge = slim.filter(F.col(bucket) == F.col(cut))
    # the crossing bucket, equal rows counted: some 500 documents a pattern, however often one of them is there
    tied = edge.groupBy(pid, order, "size").agg(F.count("*").alias("n"), F.first(room).alias("room"))

    def fill(ties: pd.DataFrame) -> pd.DataFrame:
        """How many of each group of equal rows still fit, in seeded order."""
        ties = ties.sort_values([order, "size"], kind="stable").reset_index(drop=True)
        left, some_of = int(ties["room"].iloc[0]) if len(ties) else 0, []
        for s, n in zip(ties["size"], ties["n"], strict=True):
            k = min(int(n), left // int(s)) if s > 0 else 0
            left -= k * int(s)
            some_of.append(k)
        ties[some] = some_of
        return ties[[pid, order, "size", "n", some]]

    chosen = tied.groupBy(pid).applyInPandas(fill, f"`{pid}` int, `{order}` long, size long, n long, `{some}` long")
    chosen = materialize(chosen.withColumnsRenamed({"size": tie_size, "n": ties_}), "mix-chosen")
    edge = edge.join(chosen, (edge[pid] == chosen[pid]) & (edge[order] == chosen[order]) & (edge["size"] == chosen[tie_size])).drop(chosen[pid], chosen[order]).drop(tie_size)
    all_or_none = edge.filter((F.col(some) == 0) | (F.col(some) == F.col(ties_))).withColumn("copies", F.col(whole) + (F.col(some) > 0).cast("long"))
    # of a group that fits in part, the first rows; rows are numbered within slices of their table and slices are counted
    part = edge.filter((F.col(some) > 0) & (F.col(some) < F.col(ties_))).withColumn(slice_, F.floor(F.col(row) / 2**33))
    counts = part.groupBy(pid, order, slice_).agg(F.count("*").alias("here"))
    up = Window.partitionBy(pid, order).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(pid, order, slice_, F.coalesce(F.sum("here").over(up), F.lit(0)).alias(before))
    part = part.withColumn(place, F.row_number().over(Window.partitionBy(pid, order, slice_).orderBy(row))).join(counts, [pid, order, slice_])
    part = part.withColumn("copies", F.col(whole) + (F.col(before) + F.col(place) <= F.col(some)).cast("long"))
    result = [*[col(c) for c in names], "size", "sources", "source_sizes", "targets", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).cast("long").alias("copies"), (F.col("copies") * F.col("size")).alias("taken")]
    return sure.select(*result).unionByName(all_or_none.select(*result)).unionByName(part.select(*result))
