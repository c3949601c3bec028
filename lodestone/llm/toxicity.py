"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text.
The second is laid before the first, so that what both hold lies equally near.
A window (a word with its borders) is compressed with either; the bytes saved by
the toxic dictionary, over all windows of the whole text, are mapped to a score
by a logistic calibration. Equal windows have equal lengths and are compressed
once while they stay in a bounded memo.

Toxic documents are ordinary text for the most part, so a dictionary trained on
all of it holds ordinary text. Compression itself picks the windows to train on:
the windows of toxic documents (pairs of words) are dealt into two halves, a
dictionary trained on one half tells how many bytes the windows of the other
save, and those stay that save more than ordinary windows do. The toxic
dictionary is trained on these, and picks again, some rounds over.

Bytes are repeated ``STRETCH`` times before they are compressed: a match costs
about as much as three literal bytes, which would hide short words otherwise.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused
from .quality_classifier import labelled, learnable

STRETCH = 3
#: Words of a training window; of an ordinary sample; most bytes of a window.
PAIR, RUN, LONGEST = 2, 8, 48
BASE_BYTES, TOXIC_BYTES, SEARCH_BYTES = 49_152, 4_096, 131_072
#: Bytes of ordinary windows, spread over all of the sample, that the base dictionary is trained on (the sample itself is larger).
BASE_TEXT = 8_000_000
#: zstandard trains no smaller dictionary.
LEAST_BYTES = 256
ROUNDS = 4
#: Windows are picked from that saving on at which they are this many times as frequent in toxic as in ordinary text.
TIMES = 2.0
#: Savings whose frequency is a feature.
STEPS = (4, 6, 9, 12, 15, 20)
FEATURES = 3 + 2 * len(STEPS)
MEMO = 1 << 18
#: ASCII bytes other than letters and digits become spaces, A-Z are lowered.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of the folded text; longer ones come in pieces of ``LONGEST`` bytes."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    if all(len(w) <= LONGEST for w in words):
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def windows(words: list[bytes], size: int) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def stretched(window: bytes) -> bytes:
    return np.repeat(np.frombuffer(window, dtype=np.uint8), STRETCH).tobytes()


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_BTOPT, min_match=5, window_log=18, hash_log=16, chain_log=18, search_log=3, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


def lengths(tool: zstandard.ZstdCompressor, samples: list[bytes]) -> np.ndarray:
    return np.fromiter((len(tool.compress(s)) for s in samples), dtype=np.int64, count=len(samples))


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of at most ``size`` bytes and a quarter of the samples.

    Few samples are repeated until zstandard can count in them. Where it trains
    none all the same, samples spread evenly over all are joined.
    """
    total = sum(map(len, samples))
    if 0 < total < 32 * LEAST_BYTES:
        samples = samples * -(-32 * LEAST_BYTES // total)
        total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(LEAST_BYTES, min(size, total // 4)), samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        warnings.warn(f"zstandard trained no dictionary from {len(samples)} samples; they are joined", stacklevel=2)
    return b"".join(samples[:: 1 + total // size])[:size] or b"\0" * 8


class Saved(dict):
    """Bytes that the toxic dictionary saves on a word; a bounded memo."""

    def __init__(self, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor):
        self.plain, self.bad = ordinary.compress, toxic.compress

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        window = stretched(b" " + word + b" ")
        n = self[word] = len(self.plain(window)) - len(self.bad(window))
        return n


class Distance:
    def __init__(self, ordinary: bytes, toxic: bytes, weights):
        self.dictionaries = (ordinary, toxic)
        self.saved = Saved(compressor(ordinary), compressor(toxic))
        self.weights = np.asarray(weights, dtype=float)

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        memo = self.saved
        for row, text in enumerate(texts):
            words = words_of(text or "")
            if words:
                saved = np.fromiter((memo[w] for w in words), dtype=np.int64, count=len(words))
                at_least = np.array([(saved >= s).sum() for s in STEPS])
                best = np.sort(saved[np.argpartition(saved, -min(3, len(saved)))[-3:]])
                out[row] = (best[-1], best.mean(), np.log1p(len(words)), *np.log1p(at_least), *(at_least / len(words)))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.weights[0] + self.features(texts) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def least_saving(toxic: np.ndarray, ordinary: np.ndarray, least: int = 8) -> int:
    """The least saving that is ``TIMES`` times as frequent among toxic windows, or else that with the highest ratio."""
    best, at = 0.0, 1
    for g in range(1, max(2, int(toxic.max(initial=1)) + 1)):
        n = int((toxic >= g).sum())
        rate, other = n / max(len(toxic), 1), (ordinary >= g).sum()
        if n >= least and rate >= TIMES * (other + 0.5) / max(len(ordinary), 1):
            return g
        ratio = rate / ((other + 5) / max(len(ordinary), 1))
        if ratio > best:
            best, at = ratio, g
    return at


def dictionaries(bad: list[str], plain: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    runs = [stretched(w) for t in plain for w in windows(words_of(t), RUN)]
    base = trained(runs[:: 1 + sum(map(len, runs)) // BASE_TEXT], BASE_BYTES, 32 * STRETCH)
    # each pair of words once, so that copies of a document count as one; the order does not depend on that of the rows
    toxic, ordinary = (sorted({w for t in texts for w in windows(words_of(t), PAIR)}) for texts in (bad, plain))
    half = [np.array([xxhash.xxh32_intdigest(w) & 1 for w in ws], dtype=int) for ws in (toxic, ordinary)]
    toxic, ordinary = [stretched(w) for w in toxic], [stretched(w) for w in ordinary]
    known = compressor(base)
    before = (lengths(known, toxic), lengths(known, ordinary))
    picked = np.arange(len(toxic))
    for turn in range(ROUNDS):
        saved = [np.zeros(len(toxic), dtype=int), np.zeros(len(ordinary), dtype=int)]
        for f in (0, 1):
            own = [toxic[i] for i in picked if half[0][i] == f]
            if not own:
                continue
            if turn == 0:
                # as much ordinary as toxic text
                there = [w for w, h in zip(ordinary, half[1], strict=True) if h == f]
                there = there[:: max(1, sum(map(len, there)) // max(1, sum(map(len, own))))]
                one, two = compressor(trained(there, SEARCH_BYTES, 32 * STRETCH)), compressor(trained(own, SEARCH_BYTES, 32 * STRETCH))
            else:
                one, two = None, compressor(trained(own, TOXIC_BYTES, 24 * STRETCH) + base)
            for k, ws in enumerate((toxic, ordinary)):
                at = np.nonzero(half[k] != f)[0]
                given = [ws[i] for i in at]
                saved[k][at] = (before[k][at] if one is None else lengths(one, given)) - lengths(two, given)
        picked = np.nonzero(saved[0] >= least_saving(*saved))[0]
    return base, trained([toxic[i] for i in picked], TOXIC_BYTES, 24 * STRETCH) + base


def calibrate(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and weights of a logistic regression; ``n`` weighs the rows."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(a.shape[1])
    penalty = ridge * np.diag([1e-6, *[1.0] * x.shape[1]])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (n * (y - p)) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return np.r_[w[0] - (w[1:] * mean / scale).sum(), w[1:] / scale]


def train(rows: list[tuple[str, int]], shares: dict[int, float] | None = None) -> Distance:
    """From (text, label) pairs. ``shares`` of the labels correct for a sample that holds another mix.

    With one class only, the score is that class's smoothed rate.
    """
    rows = sorted(set(rows))
    rate = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    bad, plain = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not any(map(words_of, bad)) or not any(map(words_of, plain)):
        return Distance(b"\0" * 8, b"\0" * 8, [math.log(rate / (1 - rate)), *[0.0] * FEATURES])
    model = Distance(*dictionaries(bad, plain), [0.0] * (1 + FEATURES))
    y = np.array([y for _, y in rows], dtype=float)
    held = {1: y.mean(), 0: 1 - y.mean()}
    n = np.array([(shares or held).get(int(v), held[int(v)]) / held[int(v)] for v in y])
    model.weights = calibrate(model.features([t for t, _ in rows]), y, n)
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, text_col: str, id_col: str, max_rows: int, max_bytes: int) -> list[tuple[str, int]]:
    """At most ``max_rows`` texts of each label, by hash of their ids, with ``max_bytes`` of text in all.

    A text of more than eight mean shares of ``max_bytes`` is passed over.
    """
    out: list[tuple[str, int]] = []
    for y in (1, 0):
        size = 0
        rows = labelled(docs, labels.filter(F.col(label) == y), label, text_col, id_col, max_rows).select(F.col("text").alias("t"), F.xxhash64("id").alias("h"))
        for r in rows.filter(F.octet_length("t") <= 8 * max_bytes // max_rows).orderBy("h", "t").toLocalIterator():
            size += len(r["t"].encode("utf-8", "surrogatepass"))
            if 2 * size <= max_bytes:
                out.append((r["t"], y))
    return out


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.3, carry: list[str] | None = None, max_rows: int = 2_500, max_bytes: int = 16_000_000) -> DataFrame:
    """Columns ``carry`` (default: all) plus ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``).

    Learns from a bounded sample of labels that are not held out (``max_rows``,
    ``max_bytes``); scores every window of every text. A null or empty text has
    no windows and gets the score of a text that saves nothing. Without labels
    every score is 0.5; where the labels are all alike, it is their smoothed
    rate. A repeated (text, label) counts once in training. An empty table
    gives no rows; repeated rows each get their score. Input columns named
    ``score`` or ``predicted`` are replaced, all others stay, whatever their names.
    """
    counts = {r[label]: r["n"] for r in learnable(labels, label, id_col).groupBy(label).agg(F.count("*").alias("n")).collect()}
    shares = {y: n / sum(counts.values()) for y, n in counts.items()}
    model = train(sample(docs, labels, label, text_col, id_col, max_rows, max_bytes), shares)
    sent = docs.sparkSession.sparkContext.broadcast((*model.dictionaries, model.weights))
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("score", "predicted")]
    (text,) = unused([*names, "score"], "text_")
    kept = [F.col(f"`{c}`") for c in names]
    given = docs.select(*kept, text_of(text_col).alias(text), F.lit(0.0).alias("score"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Distance(*sent.value)
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own.score(b.column(b.num_columns - 2).to_pylist()))], schema=b.schema)

    out = given.mapInArrow(batches, given.schema)
    return out.select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
