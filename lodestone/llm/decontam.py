"""Benchmark decontamination by Wu-Manber search over words.

Symbols are words. For the windows of one length, a shift table over blocks of
three words skips positions at which no window can end; a block that ends a
window selects a bucket of windows by the hash of their other words, and direct
comparison confirms each occurrence.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, unused

WINDOW = 13
#: Lower-cases A-Z and turns every ASCII byte that is neither a digit nor a letter into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def prefix_hash(words) -> int:
    return zlib.crc32(b" ".join(words))


class WuManber:
    """Search tables for the word windows of a block of items.

    All words stand in one list; a window is its first position there. Equal
    windows are held once, with the items that have them.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.words: list[bytes] = []
        by_length: dict[int, dict[bytes, tuple[int, set]]] = {}
        one: dict[bytes, bytes] = {}
        for item, text in items:
            own = [one.setdefault(w, w) for w in words_of(text)]
            if own:
                m, base = min(window, len(own)), len(self.words)
                self.words += own
                known = by_length.setdefault(m, {})
                for i in range(len(own) - m + 1):
                    digest = xxhash.xxh3_128_digest(b" ".join(own[i : i + m]))
                    known.setdefault(digest, (base + i, set()))[1].add(item)
        self.groups = []
        for m, windows in sorted(by_length.items()):
            b = min(3, m)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, list[tuple[int, int, tuple]]] = {}
            for at, ids in windows.values():
                for end in range(b, m + 1):
                    block = tuple(self.words[at + end - b : at + end])
                    if shift.get(block, m) > m - end:
                        shift[block] = m - end
                buckets.setdefault(block, []).append((prefix_hash(self.words[at : at + m - b]), at, tuple(sorted(ids))))
            for block, found in buckets.items():
                found.sort()
            self.groups.append((m, b, shift, buckets))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words (end exclusive) inside occurrences, merged for each length, and the items found."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        n, held = len(words), self.words
        for m, b, shift, buckets in self.groups:
            skip, end = m - b + 1, m
            while end <= n:
                block = tuple(words[end - b : end])
                step = shift.get(block, skip)
                if step:
                    end += step
                    continue
                start = end - m
                found = buckets[block]
                own = prefix_hash(words[start : end - b])
                for k in range(bisect_left(found, (own,)), len(found)):
                    h, at, ids = found[k]
                    if h != own:
                        break
                    if held[at : at + m] == words[start:end]:
                        items.update(ids)
                        if spans and spans[-1][0] <= start <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], end)
                        else:
                            spans.append((start, end))
                end += 1
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: What ``words_of`` takes for a word, as a pattern.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
OWN = tuple(FOUND.names)


def in_pieces(text: str, size: int, window: int) -> Iterator[str]:
    """A text in pieces of about ``size`` bytes that overlap by ``window`` - 1 words, so that no window is lost."""
    words, at = words_of(text), 0
    while True:
        end, n = at, 0
        while end < len(words) and (n <= size or end - at < window):
            n += len(words[end]) + 1
            end += 1
        yield b" ".join(words[at:end]).decode("utf-8", "surrogatepass")
        if end >= len(words):
            return
        at = end - window + 1


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int = WINDOW) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most about ``block_bytes`` bytes of text; a larger item comes in overlapping pieces."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        # each turn brings about one block to the driver
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == k)
        block, size = [], 0
        for r in part.toLocalIterator():
            whole = len(r["text"].encode("utf-8", "surrogatepass"))
            for text in [r["text"]] if whole <= block_bytes else in_pieces(r["text"], block_bytes, window):
                own = min(whole, block_bytes)
                if block and size + own > block_bytes:
                    yield block
                    block, size = [], 0
                block.append((r["item"], text))
                size += own
        if block:
            yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = 2_000_000, carry: list[str] | None = None,
) -> DataFrame:
    """Columns ``carry`` (default: all) plus ``n_words``, ``spans`` (word spans inside benchmark windows) and ``items``.

    Every whole text is searched for every window. The search tables of one
    block of items are broadcast at a time (some 400 bytes a word, about 120 MB
    at the default ``block_bytes``). A larger benchmark takes a pass over the
    source for each block, which keeps only the spans found, by digest of the
    text; texts are never written. Null or word-less texts have no words and no
    spans; null or word-less items have no windows; a null item id is reported
    as ``null``; equal item ids count once. Repeated rows each get their result;
    an empty table gives no rows. A column of the input that has the name of a
    result column is replaced by it.
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in OWN]
    kept = [F.col(f"`{c}`") for c in names]
    text_, key_, found_ = unused([*names, *OWN], "text_", "key_", "found_")
    text = F.col(f"`{text_col}`").cast("string")
    blocks = item_blocks(benchmark, item_id_col, item_text_col, block_bytes, window)
    first, second = next(blocks, []), next(blocks, None)
    send = lambda block: spark.sparkContext.broadcast(WuManber(block, window))
    if second is None:
        given = docs.select(*kept, text.alias(text_))
        schema = T.StructType([*given.schema.fields[:-1], *FOUND.fields])
        return given.mapInArrow(searcher(send(first), schema, False), schema)
    keyed = docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    schema = T.StructType([T.StructField("key", T.BinaryType()), *FOUND.fields])
    hits = None
    for k, block in enumerate(itertools.chain([first, second], blocks)):
        one = materialize(keyed.mapInArrow(searcher(send(block), schema, True), schema).dropDuplicates(["key"]).withColumn("block", F.lit(k)), "decontam-hits")
        hits = one if hits is None else hits.unionByName(one)
    # one row for each block and text with a hit
    hits = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = materialize(hits.mapInArrow(unite, hits.schema), "decontam-found")
    hits = hits.select(F.col("key").alias(key_), F.struct("spans", "items").alias(found_))
    out = docs.select(*kept, F.unhex(F.md5(text)).alias(text_), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")).join(hits, F.col(text_) == F.col(key_), "left")
    none = F.struct(F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    return out.withColumn(found_, F.coalesce(found_, none)).select(*kept, "n_words", F.col(f"{found_}.spans").alias("spans"), F.col(f"{found_}.items").alias("items"))


def searcher(tables, schema: T.StructType, only_hits: bool):
    """Replaces the last column (the text) by ``n_words``, ``spans`` and ``items``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = tables.value.find
        types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                words = words_of(text)
                spans, items = find(words)
                rows.append((len(words), [{"start": a, "end": b} for a, b in merged(spans)], sorted(items)))
            found = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=schema.names)
            yield out.filter(pa.array([bool(r[2]) for r in rows], pa.bool_())) if only_hits else out

    return search


def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks merged."""
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in row])] for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, batch.schema.field(1).type), batch.column(2)], schema=batch.schema)


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def is_contaminated() -> Column:
    """At least a twentieth of the words lie inside benchmark windows."""
    return (hit_words() > 0) & (20 * hit_words() >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with, whatever their names.

    Null and word-less texts are not contaminated; repeated rows stay or go
    together; an empty table gives no rows, an empty benchmark keeps all.
    """
    clash = [c for c in docs.columns if c.lower() in OWN]
    aside = dict(zip(clash, unused(docs.columns, *[f"in_{c}" for c in clash]), strict=True))
    found = find_contamination(docs.withColumnsRenamed(aside), benchmark, **options).filter(~is_contaminated())
    return found.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
