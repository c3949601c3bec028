"""Packing token pieces into sequences by a grouping genetic algorithm on islands.

Texts become token ids, longer ones are cut into pieces of the sequence length
(the first piece takes the rest). Full pieces are sequences of their own. Of the
others only lengths matter, so what is searched is a *template*: with ``K``
copies, a template takes ``1 / K`` of the pieces of every length, rounded down,
and what is left over is less than half, which the next template takes with a
smaller ``K``. A template has at most ``template`` pieces, whatever the size of
the corpus, and there are as many as the logarithm of that size.

Each template is packed by several islands, one task each: a crossover injects
whole well-filled sequences of one parent into another, sequences that hold any
of their pieces again are dissolved, and what that displaces is put where it
fits best. After each epoch the elite of an island moves to the next one. The
populations are a written table, so an epoch can be run again anywhere.

The k-th piece of a length finds its template, copy, sequence and place by
arithmetic on k. Pieces are numbered by counts of each task and length, so no
length, however frequent, meets in one task.
"""

from __future__ import annotations

import os
import random
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, unused

#: White space of Unicode, as the tokenizer's own pattern has it.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits that a stop never joins.
PLAIN = r"0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Parts that the tokenizer never joins: a word with the blank before it, stops behind it, other white space.
WORD = re.compile(rf" ?[{PLAIN}]+(?=[.,;:]*(?:[{BLANK}]|\Z))|[.,;:]+(?=[{BLANK}]|\Z)| ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: A blank where a text can be parted.
GAP = re.compile(rf"(?<=[^{BLANK}]) (?=[^{BLANK}])")
#: Characters looked at a time, and words that are remembered with their ids.
STRETCH, MEMO = 1 << 20, 1 << 20
#: Ids of words, kept by a worker from task to task, for each tokenizer file.
KNOWN: dict[str, dict[str, bytes]] = {}


def byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones of Latin-1 as they are, the others, in order, from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = byte_letters()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers; ids of words are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.known = Tokenizer.from_file(path), KNOWN.setdefault(path, {})
        # strings with ids of their own part a text before anything else does
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        # such tokenizers hand words of letters to their model as they are, written in bytes
        self.direct = isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and not self.tokenizer.pre_tokenizer.add_prefix_space and self.tokenizer.normalizer is None

    def ids(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return b"".join(self.special_ids[t] if k % 2 else self.plain(t) for k, t in enumerate(self.special.split(text)))

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of new words."""
        others, known = [], self.known
        if self.direct:
            tokenize = self.tokenizer.model.tokenize
            for w in words:
                if (w.isascii() or max(w) <= "\u024f") and w[-1:].isalpha() and w.replace(" ", "", 1).isalpha():
                    ids = [t.id for t in tokenize(w.encode().decode("latin-1").translate(BYTES))]
                    known[w] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    others.append(w)
        else:
            others = list(words)
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            ids = e.ids
            known[w] = struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bytes:
        out, start, known = [], 0, self.known
        while start < len(text):
            gap = GAP.search(text, start + STRETCH)
            end = gap.start() if gap else len(text)
            words = WORD.findall(text, start, end)
            new = set(words).difference(known)
            if new:
                if len(known) > MEMO:
                    known.clear()
                    new = set(words)
                self.learn(new)
            out.append(b"".join(map(known.__getitem__, words)))
            start = end
        return b"".join(out)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, place): place counts the pieces of the same length in their task."""
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32", "task", "place"] + ["ids"] * with_ids
    schema = f"id {dict(given.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids binary" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(path), Counter()
        task = TaskContext.get().partitionId()
        for b in it:
            for at in range(0, b.num_rows, 256):  # few texts at a time, as their pieces are held
                part = b.slice(at, 256)
                rows, own = [], []
                for i, text in enumerate(part.column(1)):
                    ids = encoder.ids(text.as_py() or "") + end
                    n = len(ids) // 4
                    cut = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for piece, (a, z) in enumerate(zip(cut, cut[1:], strict=False)):
                        data = ids[4 * a : 4 * z]
                        rows.append((i, piece, a, z - a, zlib.crc32(data), task, seen[z - a]))
                        own.append(data)
                        seen[z - a] += 1
                row, piece, start, length, crc, tasks, place = zip(*rows, strict=True)
                columns = [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(tasks, pa.int32()), pa.array(place, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, names=names)

    return given.mapInArrow(batches, schema)


def templates(counts: dict[int, int], most: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, pieces of each length) of the templates that together take all pieces; each has ``most`` pieces at most."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        copies = -(-sum(left.values()) // most)
        own = {k: n // copies for k, n in left.items() if n >= copies}
        # fewer than copies of each length stay: less than half of all while lengths are half as many as pieces of a template
        left = {k: n - copies * own.get(k, 0) for k, n in left.items() if n > copies * own.get(k, 0)}
        out.append((copies, own))
    return out


def best_fit(bins: list[list[int]], loose: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """``bins`` with the ``loose`` items, each in turn where least room is left, else in a new bin."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, items in enumerate(bins):
        free = capacity - sum(lengths[i] for i in items)
        by_free[free].append(b)
        mask |= 1 << free
    for i in loose:
        size = lengths[i]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            b, free = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_free[free - size].append(b)
        mask |= 1 << (free - size)
    return bins


def fitness(bins: list[list[int]], lengths: list[int]) -> tuple[int, int]:
    """Fewer bins first, then fuller ones (the sum of squared fills)."""
    return -len(bins), sum(sum(lengths[i] for i in items) ** 2 for items in bins)


def crossover(to: list[list[int]], donor: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole bins of the fuller half of ``donor`` go into ``to``; what they displace is put where it fits best."""
    fullest = sorted(donor, key=lambda items: -sum(lengths[i] for i in items))
    half = max(1, (len(donor) + 1) // 2)
    taken = rng.sample(fullest[:half], rng.randint(1, half))
    injected = {i for items in taken for i in items}
    kept, displaced = [list(items) for items in taken], []
    for items in to:
        if injected.isdisjoint(items):
            kept.append(list(items))
        else:
            displaced += [i for i in items if i not in injected]
    return best_fit(kept, ordered(displaced, lengths, rng), lengths, capacity)


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The emptiest bins and a few others are dissolved and their items put where they fit best."""
    by_fill = sorted(bins, key=lambda items: sum(lengths[i] for i in items))
    few = rng.randint(1, max(1, len(bins) // 20))
    gone = {*range(few), *rng.sample(range(len(bins)), few)}
    kept = [list(items) for k, items in enumerate(by_fill) if k not in gone]
    loose = [i for k in gone for i in by_fill[k]]
    return best_fit(kept, ordered(loose, lengths, rng), lengths, capacity)


def ordered(loose: list[int], lengths: list[int], rng: random.Random) -> list[int]:
    """Longest first, with some disorder that tells children apart."""
    return sorted(loose, key=lambda i: -lengths[i] * (1 + 0.1 * rng.random()))


def evolve(lengths: list[int], population: list[list[list[int]]], capacity: int, size: int, generations: int, seed: int) -> list[list[list[int]]]:
    """An epoch of one island: the population after so many children, best first."""
    rng = random.Random(seed)
    everything = list(range(len(lengths)))
    if not population:
        population = [best_fit([], sorted(everything, key=lambda i: -lengths[i]), lengths, capacity)]
    while len(population) < size:
        population.append(best_fit([], ordered(everything, lengths, rng), lengths, capacity))
    least = -(-sum(lengths) // capacity)
    ranked = sorted(((fitness(p, lengths), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)[:size]
    for child in range(generations):
        if -ranked[0][0][0] <= least or len(lengths) < 2:
            break
        pick = lambda: min(rng.randrange(len(ranked)), rng.randrange(len(ranked)))  # noqa: E731  the better of two
        a, b = ranked[pick()][2], ranked[pick()][2]
        made = mutate(a, lengths, capacity, rng) if a is b or rng.random() < 0.25 else crossover(a, b, lengths, capacity, rng)
        score = fitness(made, lengths)
        if score > ranked[-1][0] and all(score != r[0] for r in ranked):
            ranked[-1] = (score, size + child, made)
            ranked.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    return [p for _, _, p in ranked]


def islands(spark: SparkSession, wanted: list[list[int]], capacity: int, count: int, size: int, epochs: int, generations: int, elite: int, seed: int) -> DataFrame:
    """(template, n_bins, bins): the best packing found of the lengths of each template; bins has the bin of each item."""

    def epoch(turn: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            template, island = int(rows["template"].iloc[0]), int(rows["island"].iloc[0])
            lengths, population = [int(x) for x in rows["lengths"].iloc[0]], []
            for own in rows.sort_values(["origin", "place"])["bins"]:
                if own is not None and len(own):
                    bins: list[list[int]] = [[] for _ in range(int(max(own)) + 1)]
                    for item, b in enumerate(own):
                        bins[b].append(item)
                    population.append(bins)
            out = []
            for place, bins in enumerate(evolve(lengths, population, capacity, size, generations, seed + 1000 * turn + 97 * template + island)):
                where = np.empty(len(lengths), dtype=np.int32)
                for b, items in enumerate(bins):
                    where[items] = b
                out.append((template, island, island, place, len(bins), lengths, where))
            return pd.DataFrame(out, columns=["template", "island", "origin", "place", "n_bins", "lengths", "bins"])

        return run

    schema = "template int, island int, origin int, place int, n_bins int, lengths array<int>, bins array<int>"
    start = spark.createDataFrame([(t, i, i, 0, 0, x, []) for t, x in enumerate(wanted) for i in range(count)], schema)
    least = {t: -(-sum(x) // capacity) for t, x in enumerate(wanted)}
    now = None
    for turn in range(epochs):
        if now is not None:
            moved = now.filter(F.col("place") < elite).withColumn("island", ((F.col("island") + 1) % count).cast("int"))
            start = now.unionByName(moved)
        # a task for each island
        after = materialize(start.repartition(len(wanted) * count, "template", "island").groupBy("template", "island").applyInPandas(epoch(turn), schema), "pack-islands")
        discard(now)
        now = after
        reached = {r["template"]: r["n"] for r in now.groupBy("template").agg(F.min("n_bins").alias("n")).collect()}
        if all(reached[t] <= n for t, n in least.items()):
            break
    best = now.groupBy("template").agg(F.min_by(F.struct("n_bins", "lengths", "bins"), F.struct("n_bins", "place", "island")).alias("x"))
    return best.select("template", "x.n_bins", "x.lengths", "x.bins")


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False,
    template: int = 4096, island_count: int = 4, population: int = 8, epochs: int = 3, generations: int = 60, elite: int = 2, seed: int = 7,
) -> DataFrame:
    """One row for each piece of each document: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is the ids of its whole text and ``end_id``; a null or empty text
    is ``end_id`` alone. ``start`` counts the ids of the document before the
    piece, ``offset`` those of the sequence. Pieces of a sequence fill it from 0
    on without gaps and have at most ``capacity`` ids together. Sequence ids are
    gapless from 0. Repeated rows and null ids are packed like any others; an
    empty table gives no rows; other columns are left out. ``with_ids`` adds
    ``ids``, the ids of the piece as little-endian unsigned 32-bit numbers.

    ``tokenizer`` is a file that the executors can read. ``template`` is at
    least ``2 * capacity``; smaller values are raised to that.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pack-pieces")
    by_task = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "pack-counts", slim=True)
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    full = counts.pop(capacity, 0)
    plan = templates(counts, max(template, 2 * capacity))
    lengths = [[k for k in sorted(own, reverse=True) for _ in range(own[k])] for _, own in plan]
    # where the pieces of each length begin: (template, first piece, copies, pieces in a copy)
    taken: Counter = Counter()
    begins: dict[int, list] = {k: [] for k in counts}
    for t, (copies, own) in enumerate(plan):
        for k, n in own.items():
            begins[k].append((t, taken[k], n))
            taken[k] += copies * n
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = cut.join(offsets, ["task", "length"]).withColumn("k", F.col("before") + F.col("place"))
    alone = numbered.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("k"), "offset": F.lit(0).cast("long")})
    out = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    named = dict(zip(out, [id_col, *unused([id_col], *out[1:])], strict=True))
    if not plan:
        return alone.select(*[F.col(c).alias(named[c]) for c in out])
    best = materialize(islands(spark, lengths, capacity, island_count, population, epochs, generations, elite, seed), "pack-best")
    base, firsts = full, []
    for r in best.select("template", "n_bins").orderBy("template").collect():
        firsts.append((r["template"], base, r["n_bins"]))
        base += plan[r["template"]][0] * r["n_bins"]
    # the pieces of a template by length and number: bin and place in it; at most 4,096 rows for each template
    items = best.select("template", F.posexplode(F.arrays_zip("lengths", "bins")).alias("item", "x")).select("template", "item", F.col("x.lengths").cast("long").alias("length"), F.col("x.bins").alias("bin"))
    in_bin = Window.partitionBy("template", "bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    slots = items.select(
        "template", "length", "bin", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).alias("offset"),
        (F.row_number().over(Window.partitionBy("template", "length").orderBy("item")) - 1).cast("long").alias("slot"),
    )
    begin = spark.createDataFrame([(k, [{"t": t, "first": first, "n": n} for t, first, n in x]) for k, x in begins.items()], "length long, begins array<struct<t int, first long, n long>>")
    bases = spark.createDataFrame(firsts, "template int, base long, n_bins int")
    mine = F.element_at(F.filter("begins", lambda x: x["first"] <= F.col("k")), -1)
    rest = numbered.filter(F.col("length") < capacity).join(F.broadcast(begin), "length").withColumn("mine", mine)
    rest = rest.withColumns({"template": F.col("mine.t"), "copy": F.expr("(k - mine.first) div mine.n"), "slot": (F.col("k") - F.col("mine.first")) % F.col("mine.n")})
    rest = rest.join(F.broadcast(slots), ["template", "length", "slot"]).join(F.broadcast(bases), "template")
    rest = rest.withColumn("sequence_id", F.col("base") + F.col("copy") * F.col("n_bins") + F.col("bin"))
    return alone.select(*out).unionByName(rest.select(*out)).select(*[F.col(c).alias(named[c]) for c in out])


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, from what ``pack`` returns with ``with_ids``."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(held, "")).alias("ids"))
