"""Ranked lexical search over inverted treaps.

The postings of a term form a treap: a search tree by document (in the order of
ids) that is at the same time a heap by impact, so that the root of every
subtree has the highest impact in it. A query walks the treaps of its terms
together. A range of documents is described by one subtree for each term; the
weighted sum of their roots bounds the score of every document of the range, and
a range whose bound can't enter the best k is dropped. Otherwise the document at
the strongest root is scored, and the range is parted there. Ranges are taken in
the order of their bounds, many at a time, as arrays.

Documents are searched in blocks of bounded size within each task, the best k of
a query are carried from block to block, and the tasks' lists are merged at the
end. Only terms of the queries are indexed; queries come in blocks of so many
terms, with a pass over the documents for each.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of, unused

#: Letters, digits and bytes above ASCII stay, capitals of ASCII become small, all others part terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are looked at a time.
PIECE = 1 << 20
#: Documents and postings of a block at most (one document may have more), and ranges that are parted at a time.
BLOCK_DOCS, BLOCK_POSTINGS, STEP = 1 << 16, 1 << 21, 512


def terms_of(text: str) -> Counter:
    """Terms of a whole text with their numbers of occurrence."""
    plain = text.encode("utf-8", "surrogatepass").translate(FOLD)
    out, start = Counter(), 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE)  # a term is not cut
        end = len(plain) if end < 0 else end
        out.update(plain[start:end].split())
        start = end
    return out


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts): n counts all terms of the text, the others are those of the vocabulary."""
    given = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, terms, counts = [], [], []
            for text in b.column(1):
                found = terms_of(text.as_py())
                own = sorted((vocabulary[w], c) for w, c in found.items() if w in vocabulary)
                n.append(found.total())
                terms.append([t for t, _ in own])
                counts.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "n", "terms", "counts"])

    return given.mapInArrow(batches, f"id {dict(given.dtypes)['id']}, n long, terms array<int>, counts array<long>")


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a unit of a term's weight adds for tf occurrences in a document of n terms."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Treaps:
    """The treaps of all terms of a block of documents; documents are places in the order of ids.

    Nodes are numbered by term and document. Equal impacts are ordered at
    random, so that many of them don't make a list of the tree.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        # one more node, reached by -1: no document, no impact
        self.doc = np.append(doc[order], -1)
        self.impact = np.append(impact[order], 0)
        n = len(order)
        left, right, roots = [-1] * (n + 1), [-1] * (n + 1), {}
        heap = ((impact[order] << 24) | np.random.default_rng(len(order)).integers(0, 1 << 24, n)).tolist()
        stack: list[int] = []
        last = None
        for i, t in enumerate(term[order].tolist()):
            if t != last:
                if stack:
                    roots[last] = stack[0]
                stack, last = [], t
            below = -1
            while stack and heap[stack[-1]] < heap[i]:
                below = stack.pop()
            left[i] = below
            if stack:
                right[stack[-1]] = i
            stack.append(i)
        if stack:
            roots[last] = stack[0]
        self.left, self.right, self.roots = np.array(left, np.int32), np.array(right, np.int32), roots

    def within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The roots of what the subtrees have from ``low`` to below ``high``."""
        out = nodes.ravel().copy()
        low, high = np.repeat(low, nodes.shape[1]), np.repeat(high, nodes.shape[1])
        at = np.flatnonzero(out >= 0)
        while len(at):
            now = out[at]
            doc = self.doc[now]
            to_left = doc >= high[at]
            moved = to_left | (doc < low[at])
            at, now, to_left = at[moved], now[moved], to_left[moved]
            out[at] = np.where(to_left, self.left[now], self.right[now])
            at = at[out[at] >= 0]
        return out.reshape(nodes.shape)

    def search(self, terms: list[int], weights: list[int], n_docs: int, keep, offer) -> int:
        """Offers the scores of documents that may enter the best; the number of documents that were scored.

        ``keep(bounds, lows)`` tells which ranges may still have such documents,
        ``offer(scores, docs)`` takes scores.
        """
        own = [(self.roots[t], w) for t, w in zip(terms, weights, strict=True) if t in self.roots and w > 0]
        if not own:
            return 0
        nodes, w = np.array([[r for r, _ in own]], np.int32), np.array([x for _, x in own], np.int64)
        low, high = np.zeros(1, np.int64), np.full(1, n_docs, np.int64)
        bound, scored = (self.impact[nodes] * w).sum(axis=1), 0
        while len(bound):
            first = np.argpartition(-bound, STEP)[:STEP] if len(bound) > STEP else np.arange(len(bound))
            rest = np.ones(len(bound), dtype=bool)
            rest[first] = False
            n, lo, hi = nodes[first], low[first], high[first]
            strongest = np.argmax(self.impact[n] * w, axis=1)
            pivot = self.doc[n[np.arange(len(n)), strongest]].astype(np.int64)
            offer((self.impact[self.within(n, pivot, pivot + 1)] * w).sum(axis=1), pivot)
            scored += len(pivot)
            before, behind = self.within(n, lo, pivot), self.within(n, pivot + 1, hi)
            nodes = np.concatenate([nodes[rest], before, behind])
            low, high = np.concatenate([low[rest], lo, pivot + 1]), np.concatenate([high[rest], pivot, hi])
            bound = np.concatenate([bound[rest], (self.impact[before] * w).sum(axis=1), (self.impact[behind] * w).sum(axis=1)])
            stay = keep(bound, low)
            nodes, low, high, bound = nodes[stay], low[stay], high[stay], bound[stay]
        return scored


class Best:
    """The k highest scores above 0 of a query, equal ones by ascending id (null last)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def bound_to(self, ids: list):
        """``keep`` and ``offer`` of a search in a block with such ids, in order."""
        order = [(i is None, i) if i is None else (False, i) for i in ids]

        def keep(bounds: np.ndarray, lows: np.ndarray) -> np.ndarray:
            if len(self.rows) < self.k:
                return bounds > 0
            score, key = -self.rows[-1][0], self.rows[-1][1]
            # of equal scores only lower ids count
            return (bounds > score) | ((bounds == score) & (lows < bisect_left(order, key)))

        def offer(scores: np.ndarray, docs: np.ndarray) -> None:
            stay = np.flatnonzero(keep(scores, docs))
            stay = stay[np.lexsort((docs[stay], -scores[stay]))][: self.k]
            self.rows = sorted(self.rows + [(-int(scores[i]), order[docs[i]]) for i in stay], key=lambda r: r)[: self.k]

        return keep, offer


def best_of_tasks(rows: DataFrame, asked: list[tuple[list[int], list[int]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): the best k of each query in each task of ``rows`` (id, n, terms, counts)."""

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, docs, posts = [], 0, 0
        for b in it:
            at = 0
            while at < b.num_rows:
                sizes = np.cumsum(np.diff(b.column(2).slice(at).offsets.to_numpy()))
                fit = max(1 - bool(held), min(int(np.searchsorted(sizes, BLOCK_POSTINGS - posts, side="right")), BLOCK_DOCS - docs))
                part = b.slice(at, fit)
                if part.num_rows:
                    held.append(part)
                    docs, posts, at = docs + part.num_rows, posts + int(sizes[part.num_rows - 1]), at + part.num_rows
                if at < b.num_rows:
                    yield pa.Table.from_batches(held)
                    held, docs, posts = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        id_type = None
        for t in blocks(it):
            id_type = t.schema.field("id").type
            t = t.sort_by([("id", "ascending")]).combine_chunks()  # nulls last
            lists = t.column("terms").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(t.num_rows), sizes)
            term, tf = lists.flatten().to_numpy(), t.column("counts").combine_chunks().flatten().to_numpy()
            treaps = Treaps(doc, term, impacts(tf, t.column("n").to_numpy()[doc], n_docs, n_terms))
            ids = t.column("id").to_pylist()
            for own, (terms, weights) in zip(best, asked, strict=True):
                treaps.search(terms, weights, t.num_rows, *own.bound_to(ids))
        out = [(i, key[1], -score) for i, own in enumerate(best) for score, key in own.rows]
        if out:
            item, ids, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, id_type), pa.array(score, pa.int64())], names=["item", "id", "score"])

    return rows.mapInArrow(run, f"item int, id {dict(rows.dtypes)['id']}, score long")


def rank(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", max_terms: int = 200_000,
) -> DataFrame:
    """The ``k`` best documents of each query: ``query_id``, ``rank`` (from 1), ``id_col``, ``score`` (above 0).

    Equal scores rank by ascending id, null ids last. A null text, of documents
    or queries, has no terms: such documents are in no list, such queries have
    none. Repeated documents are listed each, repeated queries get a list each.
    Whole texts count, however long. Empty tables give no rows; other columns
    are left out. Ids may be of any type that has an order.

    Queries are read in blocks of at most ``max_terms`` different terms (or one
    query); each block takes a pass over the documents.
    """
    spark = docs.sparkSession
    (out_id,) = unused([query_id], id_col)
    named = unused([query_id, out_id], "rank", "score")
    types = dict(queries.dtypes)[query_id], dict(docs.dtypes)[id_col]
    schema = f"`{query_id}` {types[0]}, `{named[0]}` int, `{out_id}` {types[1]}, `{named[1]}` long"
    found = None

    def ranked(block: list, vocabulary: dict[bytes, int]) -> DataFrame:
        rows = materialize(postings(docs, vocabulary, id_col, text_col), "search-postings")
        n_docs, n_terms = rows.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # max_terms numbers at most
        dfs = {r["t"]: r["df"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        weights = {t: weight(df, n_docs) for t, df in dfs.items()}
        asked = [([vocabulary[w] for w in own], [c * weights.get(vocabulary[w], 0) for w, c in own.items()]) for _, own in block]
        best = best_of_tasks(rows.filter(F.size("terms") > 0), asked, n_docs, n_terms, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        items = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"item int, query {types[0]}")
        return best.join(items, "item").select(F.col("query").alias(query_id), F.col("rank").alias(named[0]), F.col("id").alias(out_id), F.col("score").alias(named[1]))

    block, vocabulary = [], {}
    for q, text in queries.select(F.col(f"`{query_id}`"), text_of(f"`{query_text}`")).toLocalIterator():
        own = terms_of(text)
        if block and len(vocabulary) + sum(w not in vocabulary for w in own) > max_terms:
            part = ranked(block, vocabulary)
            found = part if found is None else found.unionByName(part)
            block, vocabulary = [], {}
        if own:
            block.append((q, own))
            for w in own:
                vocabulary.setdefault(w, len(vocabulary))
    if block:
        part = ranked(block, vocabulary)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found
