"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver over a bounded sample of labelled rows (only
their statistics are collected) and flattened into arrays; scoring walks all
trees of all documents of a batch at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_of, unused
from .quality_rules import STOP_WORDS

STATISTICS = (
    "words", "word_length", "distinct_words", "adjacent_repeats", "stop_words", "lines", "duplicate_lines", "line_length",
    "upper", "digits", "other_ascii", "exclamations", "stops", "commas", "non_ascii", "spaces", "bytes_entropy", "longest_word", "capitalised", "top_word",
)


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``STATISTICS`` for each whole text."""
    stop = frozenset(STOP_WORDS)
    out = np.zeros((len(texts), len(STATISTICS)), dtype=np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
        words = text.split()
        n, size = len(words), int(raw.sum())
        lines = [x for x in text.split("\n") if x.strip()]
        upper, lower, digits = raw[65:91].sum(), raw[97:123].sum(), raw[48:58].sum()
        spaces = raw[9:14].sum() + raw[32]
        marks = raw[33] + raw[46] + raw[44]
        p = raw[raw > 0] / size
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        m = max(n, 1)
        out[row] = (
            np.log1p(n), sum(map(len, words)) / m, len(counts) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
            sum(c for w, c in counts.items() if w.lower() in stop) / m, np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)),
            upper / size, digits / size, (raw[:128].sum() - upper - lower - digits - spaces - marks) / size, raw[33] / m, raw[46] / m, raw[44] / m,
            raw[128:].sum() / size, spaces / size, -(p * np.log2(p)).sum(), np.log1p(max(map(len, counts), default=0)),
            sum(c for w, c in counts.items() if w[0].isupper()) / m, max(counts.values(), default=0) / m,
        )
    return out


class Trees:
    """Boosted trees in flat arrays; a leaf points to itself."""

    def __init__(self, base: float, feature, threshold, left, right, value, roots, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = (np.asarray(a) for a in (feature, threshold, left, right, value, roots))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        z = np.full(len(x), self.base)
        if len(self.roots):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            z = z + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Trees:
    """Newton boosting of the log loss; splits are searched in histograms of quantile bins."""
    n, width = x.shape
    if not n:
        return Trees(0.0, [], [], [], [], [], [], 0)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    z = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(value)
        for a, b in ((feature, 0), (threshold, np.float32(0)), (left, k), (right, k), (value, v)):
            a.append(b)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        k = node(rate * sum_g / (sum_h + ridge))
        if level == depth or len(rows) < 2 * least:
            return k
        best = (1e-3, None, None)
        for j in range(width):
            b = binned[rows, j]
            size = len(edges[j]) + 1
            gs, hs, ns = np.cumsum(np.bincount(b, g[rows], size))[:-1], np.cumsum(np.bincount(b, h[rows], size))[:-1], np.cumsum(np.bincount(b, minlength=size))[:-1]
            gain = np.where((ns >= least) & (len(rows) - ns >= least), gs**2 / (hs + ridge) + (sum_g - gs) ** 2 / (sum_h - hs + ridge) - sum_g**2 / (sum_h + ridge), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        _, j, cut = best
        if j is None:
            return k
        goes = binned[rows, j] <= cut
        feature[k], threshold[k], value[k] = j, edges[j][cut], 0.0
        left[k] = grow(rows[goes], g, h, level + 1)
        right[k] = grow(rows[~goes], g, h, level + 1)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        roots.append(grow(np.arange(n), y - p, p * (1 - p), 0))
        z = np.log((q := Trees(base, feature, np.float32(threshold), left, right, value, roots, depth).score(x)) / (1 - q))
    return Trees(base, feature, np.float32(threshold), left, right, value, roots, depth)


def learnable(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    return labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col))


def labelled(docs: DataFrame, labels: DataFrame, label: str, text_col: str, id_col: str, max_rows: int) -> DataFrame:
    """(id, text, y) of at most ``max_rows`` learnable labels of known documents, by hash of the id; none is held out.

    Of documents that share an id, one is taken, so that no more rows than labels come out.
    """
    known = learnable(labels, label, id_col).select(F.col(id_col), F.col(label).cast("int").alias("y")).join(docs.select(id_col).distinct(), id_col, "left_semi")
    rows = known.orderBy(F.xxhash64(id_col), id_col, "y").limit(max_rows)
    # at most max_rows rows of two numbers
    rows = rows.select(F.col(id_col).alias("label_of"), F.col("y").alias("label_is"))
    clear = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    own = clear.join(F.broadcast(rows.select("label_of").distinct()), clear["id"] == F.col("label_of"), "left_semi")
    once = own.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return once.join(F.broadcast(rows), once["id"] == rows["label_of"]).select("id", "text", F.col("label_is").alias("y"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text_col: str = "text", id_col: str = "doc_id", max_rows: int = 20_000) -> Trees:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = statistics(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], names=["y", "x"])

    rows = labelled(docs, labels, label, text_col, id_col, max_rows).select("y", "text").mapInArrow(batches, "y int, x array<float>").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float32).reshape(-1, len(STATISTICS))
    y = rows["y"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))  # the same trees in whatever order the rows arrive
    return fit(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.7, carry: list[str] | None = None, max_rows: int = 20_000) -> DataFrame:
    """Columns ``carry`` (default: all) plus ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``).

    Learns from at most ``max_rows`` labels that are not held out; scores every
    whole text. A null text counts as empty and has all statistics 0. Without
    labels every score is 0.5. Labels of unknown ids and values other than 0
    and 1 are passed over; a repeated label counts as often as it stands there.
    Input columns named ``score`` or ``predicted`` are replaced.
    """
    trees = train(docs, labels, label, text_col, id_col, max_rows)
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("score", "predicted")]
    kept = [F.col(f"`{c}`") for c in names]
    (text,) = unused([*names, "score"], "text_")
    given = docs.select(*kept, text_of(text_col).alias(text), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast((trees.base, trees.feature, trees.threshold, trees.left, trees.right, trees.value, trees.roots, trees.depth))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*sent.value)
        for b in it:
            texts = b.column(b.num_columns - 2).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(statistics(texts)))], schema=b.schema)

    out = given.mapInArrow(batches, given.schema)
    return out.select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they came with, whatever their names.

    A null text counts as empty and is judged as such; equal texts are judged
    alike, repeated rows stay or go together; an empty table gives no rows;
    without labels every score is 0.5 and nothing reaches the threshold.
    """
    clash = [c for c in docs.columns if c.lower() in ("score", "predicted")]
    aside = dict(zip(clash, unused(docs.columns, *[f"in_{c}" for c in clash]), strict=True))
    out = score(docs.withColumnsRenamed(aside), labels, **options).filter("predicted = 1")
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
