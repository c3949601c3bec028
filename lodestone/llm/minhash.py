"""Near-duplicate classes by Order MinHash and banded alignment.

k-mers are runs of five words, labelled with their occurrence number. A sketch
samples the ``LENGTH`` smallest labelled k-mers under one hash function and
keeps them in text order, so that a match depends on shared k-mers and on their
order. Texts that agree in a sketch are candidates. Each candidate pair is
aligned within a band that holds every pair of the wanted similarity; the pair
is linked if the k-mers inside aligned runs make up ``LEAST`` of all.

Exact copies meet first. Within a bucket, texts are compared with a centre
(a few times, with better centres); what then still lies in different classes is
compared pair by pair. Texts of wide buckets are first dealt anew by their rarest
k-mers, in a common order: one for each that two similar texts may not share, and
one more, so that such texts meet for certain and those that only share a passage
don't. So no candidate is left out and a large group of near copies costs a few
comparisons for each text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, unused

K = 5
LEAST = 0.8
#: Rounds in which the texts of a bucket are compared with a centre, in the first and again in the second buckets.
STARS = 2
#: Sketches and k-mers in each; texts of up to ``SHORT`` k-mers also get sketches of two.
SKETCHES, LENGTH = 24, 6
SHORT, SHORT_SKETCHES, SHORT_LENGTH = 40, 12, 2
#: Texts from buckets of more than ``WIDE`` texts in several classes are dealt anew by their rarest k-mers: a passage
#: that many unlike texts share fills such buckets.
WIDE = 16
#: Second family of sketches, longer ones, which part texts that only share a passage.
WIDE_SKETCHES, WIDE_LENGTH = 100, 12
#: Of so few k-mers, twelve are too rarely those of a near copy: texts of up to ``WIDE_SHORT`` k-mers get shorter
#: sketches besides, those of up to ``SHORT`` twice as many.
WIDE_SHORT, WIDE_SHORT_SKETCHES, WIDE_SHORT_LENGTH = 200, 24, 4
#: Cells of the bit sets that bound how many k-mers two texts of wide buckets share.
BITS = 4096
#: Bytes, or ranks, that are worked on at a time: what a very long text takes besides grows with its words only.
PIECE = 1 << 20
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; ASCII characters other than letters and digits part them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(FOLD).split()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


ODD = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
#: One for each place of a k-mer in its sketch, so that the order counts.
PLACES = ODD[-WIDE_LENGTH:]


def word_hashes(text: str) -> np.ndarray:
    """Hashes of ``words_of`` a text: the sum of the mixed bytes of a word with their places in it."""
    plain = text.lower().encode("utf-8", "surrogatepass").translate(FOLD)
    folded = np.frombuffer(plain, dtype=np.uint8)
    out, start = [], 0
    while start < len(folded):
        end = plain.find(b" ", start + PIECE)  # a word is not cut
        end = len(folded) if end < 0 else end
        at = np.flatnonzero(folded[start:end] != 32)
        if len(at):
            first = np.ones(len(at), dtype=bool)
            first[1:] = at[1:] != at[:-1] + 1
            starts = np.flatnonzero(first)
            place = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
            letters = folded[start:end][at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)
            out.append(mix(np.add.reduceat(mix(letters), starts)))
        start = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def kmers(w: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers of a text with such word hashes, one at least; a text of fewer than five words is one k-mer."""
    k = min(K, len(w))
    n = len(w) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = mix(h + w[j : j + n] * ODD[j])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """k-mer hashes told apart by occurrence number."""
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    at = np.arange(len(s))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), at, 0))
    out = np.empty_like(h)
    out[order] = mix(s + (at - first).astype(np.uint64) * ODD[20])
    return out


def sketches(h: np.ndarray, wide: bool = False) -> np.ndarray:
    """One value for each sketch of a text, of the first or the second family."""
    own = labelled(h)
    if wide:
        sets = [(WIDE_SKETCHES, WIDE_LENGTH, 64)]
        if len(h) <= WIDE_SHORT:
            sets.append((WIDE_SHORT_SKETCHES * (2 if len(h) <= SHORT else 1), WIDE_SHORT_LENGTH, 192))
    else:
        sets = [(SKETCHES, LENGTH, 0)]
        if len(h) <= SHORT:
            sets.append((SHORT_SKETCHES, SHORT_LENGTH, 32))
    out = []
    for count, length, offset in sets:
        size = min(length, len(h))
        seeds = ODD[offset : offset + count, None]
        step = max(1, PIECE // len(h))
        picked = np.concatenate([np.argpartition(mix(own[None, :] * seeds[i : i + step]), size - 1, axis=1)[:, :size] for i in range(0, count, step)])
        picked.sort(axis=1)
        together = np.add.reduce(mix(own[picked] * PLACES[:size]), axis=1)
        out.append(mix(together + mix(seeds[:, 0] + np.uint64(size))))
    return np.concatenate(out)


def increasing(values: list[int]) -> int:
    """Length of the longest increasing subsequence of different numbers."""
    ends: list[int] = []
    for v in values:
        if not ends or v > ends[-1]:
            ends.append(v)
        else:
            ends[bisect_left(ends, v)] = v
    return len(ends)


def aligned_similarity(a: list, b: list, least: float = LEAST) -> float:
    """k-mers inside aligned runs over all k-mers of both texts; 0 where it is surely below ``least``."""
    if a == b:
        return 1.0
    na, nb = len(a) - K + 1, len(b) - K + 1
    if na < 1 or nb < 1 or min(na, nb) < least * max(na, nb):
        return 0.0
    ka, kb = list(zip(*(a[j : j + na] for j in range(K)), strict=True)), list(zip(*(b[j : j + nb] for j in range(K)), strict=True))
    ca, cb = Counter(ka), Counter(kb)
    common = (ca & cb).total()
    if common < least * (na + nb - common):
        return 0.0
    # k-mers that are there once in both are aligned in increasing order: no more of them than the longest such run has
    place = {k: j for j, k in enumerate(kb) if cb[k] == 1 and ca[k] == 1}
    once = [place[k] for k in ka if k in place]
    most = increasing(once) + common - len(once)
    if most < least * (na + nb - most):
        return 0.0
    # furthest-reaching paths by number of edits; (x, k-mers, run) for each diagonal
    band = int((1 - least) * (na + nb)) + 4 * K
    best: dict[int, tuple[int, int, int]] = {1: (0, 0, 0)}
    for d in range(band + 1):
        for k in range(-d, d + 1, 2):
            down, right = best.get(k + 1, (-1, 0, 0)), best.get(k - 1, (-1, 0, 0))
            if k == -d or (k != d and (right[0] + 1, right[1]) < (down[0], down[1])):
                x, s = down[0], down[1]
            else:
                x, s = right[0] + 1, right[1]
            if x < 0:
                continue
            y = x - k
            run = 0
            while x < len(a) and 0 <= y < len(b) and a[x] == b[y]:
                x, y, run = x + 1, y + 1, run + 1
            s += max(0, run - K + 1)
            best[k] = (x, s, run)
            if x >= len(a) and y >= len(b):
                return s / (na + nb - s)
    return 0.0


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``key`` (of the exact text), ``n`` (k-mers) and ``values``; texts without words have none."""
    text = F.col(f"`{text_col}`").cast("string")
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    schema = "id {}, key binary, n long, values array<long>".format(dict(given.dtypes)["id"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            counts, values = [], []
            for text in b.column(2):
                w = word_hashes(text.as_py() or "")
                h = kmers(w) if len(w) else w
                counts.append(len(h))
                values.append(sketches(h).view(np.int64) if len(h) else np.empty(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["id", "key", "n", "values"])

    return given.mapInArrow(batches, schema)


def verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose texts align."""
    left, right = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            last: tuple = (None, None)
            keep = []
            for ta, tb in zip(b.column(2), b.column(3), strict=True):
                ta, tb = ta.as_py(), tb.as_py()
                if last[0] != ta:
                    last = (ta, words_of(ta))
                keep.append(aligned_similarity(last[1], words_of(tb)) >= LEAST)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(batches, "a binary, b binary"), name)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``key`` and ``label`` (the least key it is connected with) of all ends of ``edges`` (a, b).

    Alternating large-star and small-star steps until nothing changes. With
    ``rounds``, as many steps: equal labels are then connected, but connected
    keys may have different labels, and links are lost in them. The least
    neighbours are written before they are joined, so that the links of a node
    with very many can be split among tasks.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", slim=True)
    state, turn = None, 0
    while rounds is None or turn < rounds:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc", slim=True)
        # every node keeps a link to the least of its neighbours
        large = materialize(both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc", slim=True)
        discard(now, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc", slim=True)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc", slim=True)
        discard(large, least)
        if rounds is None:
            new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if new == state:
                break
            state = new
    ends = now.groupBy("u").agg(F.min("v").alias("label"))
    # a least key that is itself an end of a longer chain has the label found for it
    heads = now.select(F.col("v").alias("key")).distinct().join(ends.select(F.col("u").alias("key")), "key", "left_anti")
    out = materialize(ends.select(F.col("u").alias("key"), "label").unionByName(heads.select("key", F.col("key").alias("label"))), "omh-labels", slim=True)
    discard(now)
    return out


def several(own: DataFrame) -> DataFrame:
    """(v, size) of the buckets that hold several classes; written, so that joins with it can split large buckets."""
    return materialize(own.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("v", "size"), "omh-several", slim=True)


def bits_of(own: np.ndarray) -> np.ndarray:
    """The labelled k-mers as a set of ``BITS`` cells, in words of 64."""
    cells = np.zeros(BITS, dtype=np.uint8)
    cells[(own >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(cells).view(np.int64)


def undecided(own: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets (v, key, n, c, s) that still hold several classes; texts of wide ones are dealt anew by k-mers.

    In wide buckets, k-mers that no text of another class has are counted out;
    the others stand in one order for all texts, the rarest first. ``s`` counts
    those of a text from the bucket's k-mer on, so that two texts share no more
    than the lesser ``s`` of the bucket of the first k-mer they share. Where
    ``s`` is too low for the wanted similarity, a text needs no bucket: it has
    at most one for each five of its k-mers, and one. Also (key, bits): the
    k-mers of texts of wide buckets as bits.
    """
    rows = materialize(own.join(several(own), "v").select("v", "key", "n", "c", "size"), "omh-undecided")
    wide = rows.filter(F.col("size") > WIDE).select("key", "n", "c").distinct()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = [labelled(kmers(word_hashes(t.as_py()))) for t in b.column(3)]
            halves = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=">i8").astype(np.int64).reshape(-1, 2)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ([o.view(np.int64) for o in own], [bits_of(o) for o in own])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(halves[:, 0]), pa.array(halves[:, 1]), *lists], names=["key", "n", "c", "k1", "k2", "kmers", "bits"])

    again = wide.join(texts, "key").select("key", "n", "c", "text").mapInArrow(batches, "key binary, n long, c binary, k1 long, k2 long, kmers array<long>, bits array<long>")
    again = materialize(again, "omh-wide")
    # a k-mer that is there once has one owner: the least of either half of its owner's key is that key's
    alone = again.select("k1", "k2", F.explode("kmers").alias("h")).groupBy("h").agg(F.count("*").alias("m"), F.min("k1").alias("k1"), F.min("k2").alias("k2")).filter("m = 1").groupBy("k1", "k2").agg(F.count("*").alias("u"))
    kept = again.join(alone, ["k1", "k2"], "left").filter(F.col("n") - F.coalesce("u", F.lit(0)) >= LEAST * F.col("n"))
    kept = materialize(kept.select("key", "n", "c", "kmers", "bits"), "omh-bits")
    discard(again)
    held = kept.select(F.explode("kmers").alias("v"), "key", "n", "c")
    from_last = Window.partitionBy("key").orderBy(F.desc("size"), F.desc("v"))
    dealt = held.join(several(held), "v").withColumn("s", F.row_number().over(from_last).cast("long")).filter(F.col("s") >= LEAST * F.col("n"))
    again = materialize(dealt.select("v", "key", "n", "c", "s"), "omh-wide")
    again = again.join(several(again).select("v"), "v")
    return rows.filter(F.col("size") <= WIDE).select("v", "key", "n", "c", F.col("n").alias("s")).unionByName(again.select("v", "key", "n", "c", "s")), kept.select("key", "bits")


def enough(shared: Column, n: Column, m: Column) -> Column:
    """Whether so many shared k-mers make texts of n and m similar enough (a tie does, whatever the rounding).

    ``shared`` stands here once: what a condition has twice, Spark works out for every row, also where it isn't asked for.
    """
    return shared >= LEAST / (1 + LEAST) * (n + m) - 0.001


def alike(n: Column, m: Column, s: Column, t: Column) -> Column:
    """Whether texts of n and m k-mers, of which at most s and t can be shared, may be similar enough."""
    return (F.least(n, m) >= LEAST * F.greatest(n, m)) & enough(F.least(s, t), n, m)


def to_centre(own: DataFrame, edges: DataFrame | None, turn: int) -> DataFrame:
    """In each bucket of several classes, the pairs of its centre with the texts of other classes.

    The centre is the text with most links so far: it is nearest to what the
    others were copied from.
    """
    order = F.struct(F.lit(0).alias("d"), F.xxhash64("key", F.lit(turn)).alias("h"))
    if edges is not None:
        own = own.join(edges.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("d")), "key", "left")
        order = F.struct(-F.coalesce("d", F.lit(0)).alias("d"), F.xxhash64("key", F.lit(0)).alias("h"))
    centre = own.groupBy("v").agg(F.min(F.struct(order.alias("o"), "key", "n", "c", "s")).alias("z"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("v", "z")
    # written before it is joined, so that a large bucket can be split among tasks
    centre = materialize(centre, "omh-centres", slim=True)
    pairs = own.join(centre, (own["v"] == centre["v"]) & (F.col("c") != F.col("z.c")) & alike(F.col("n"), F.col("z.n"), F.col("s"), F.col("z.s")))
    return pairs.select(F.least("key", "z.key").alias("a"), F.greatest("key", "z.key").alias("b"))


def may_share(n: Column, m: Column, x: Column, y: Column) -> Column:
    """Whether the bits of two texts leave room for enough common k-mers (unknown bits do).

    A k-mer whose cell the other text doesn't hold is not in that text, so the
    bound is never too low.
    """
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, k: t + k)
    return F.coalesce(enough(F.least(n - apart(x, y), m - apart(y, x)), n, m), F.lit(True))


def across(own: DataFrame, bits: DataFrame) -> DataFrame:
    """Every pair of texts of different classes in a bucket whose lengths, rare k-mers and bits leave it similar enough."""
    left = own.join(several(own), "v").select("v", "key", "n", "c", "s").join(bits, "key", "left")
    left = materialize(left, "omh-across")
    right = left.select(F.col("v").alias("v2"), F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("s").alias("s2"), F.col("bits").alias("bits2"))
    near = alike(F.col("n"), F.col("n2"), F.col("s"), F.col("s2")) & may_share(F.col("n"), F.col("n2"), F.col("bits"), F.col("bits2"))
    pairs = left.join(right, (F.col("v") == F.col("v2")) & (F.col("c") < F.col("c2")) & near)
    return pairs.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """One row (``id_col``, ``class_id``, ``class_size``) for each document.

    ``class_id`` is the least id of the class. Exact copies are in one class,
    also those of an empty text. A document with a null text is a class of its
    own, as is one whose text has no near copy; texts without words have no near
    copies. Ids are not nulls; a row with a null id gives a null class if no
    other row of its class has an id. Repeated rows stay. An empty table gives
    no rows; other columns are left out. ``with_key`` adds the digest of the text.
    """
    slim = materialize(sketched(docs, id_col, text_col), "omh-sketches")
    worded = slim.filter("key IS NOT NULL AND n > 0")
    # copies fall together before anything is dealt by bucket, and meet by bucket and text, not in one task
    rows = worded.select("key", "n", F.explode("values").alias("v")).distinct()
    shared = materialize(rows.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1").select("v"), "omh-shared", slim=True)
    members = materialize(rows.join(shared, "v"), "omh-buckets")
    discard(shared)
    # one row of each text; copies are told apart by the hash of their id, so that a text with very many is spread
    chosen = worded.select("key", F.xxhash64("id").alias("r")).groupBy("key").agg(F.min("r").alias("r")).join(members.select("key").distinct(), "key", "left_semi")
    texts = docs.select(F.unhex(F.md5(F.col(f"`{text_col}`").cast("string"))).alias("key"), F.xxhash64(F.col(f"`{id_col}`")).alias("r"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chosen = materialize(chosen, "omh-chosen", slim=True)
    # as many as there are texts with candidates: never broadcast, at whatever size
    texts = materialize(texts.join(chosen.hint("merge"), ["key", "r"]).drop("r").dropDuplicates(["key"]), "omh-texts")
    discard(chosen)
    spent = [slim, members, texts]
    own = members.withColumns({"s": F.col("n"), "c": F.col("key")})
    edges = done = label = bits = None
    for turn in range(2 * STARS + 1):
        if turn == STARS:
            own, bits = undecided(own, texts)
            own = members = materialize(own, "omh-mixed")
            spent.append(members)
        pairs = across(own, bits) if turn == 2 * STARS else to_centre(own, edges, turn)
        pairs = pairs.distinct()
        pairs = materialize(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "omh-pairs", slim=True)
        found = verified(pairs, texts, "omh-links")
        spent += [pairs, found]
        done = pairs if done is None else done.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        # labels of one step are hints that keep only some of the links; whole labels start from all links
        links = edges if turn == 2 * STARS - 1 else found
        known = links if label is None else links.unionByName(label.select(F.col("key").alias("a"), F.col("label").alias("b")))
        label = components(known, rounds=1 if turn < 2 * STARS - 1 else None)
        spent.append(label)
        own = members.drop("c").join(label, "key", "left").withColumns({"c": F.coalesce("label", "key"), "s": F.col("s") if "s" in members.columns else F.col("n")}).drop("label")
    keyed = slim.select("id", "key").join(label, "key", "left").select("id", "key", F.coalesce("label", "key").alias("class"))
    keyed = materialize(keyed, "omh-keyed")
    heads = materialize(keyed.filter("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "omh-classes")
    discard(*spent)
    out = keyed.join(heads, "class", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), *[F.col("key")] * with_key)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that with the least id, with the columns it came with.

    Rows equal in id and text count as one document. Rows with a null id or a
    null text stay. Empty texts are one class, texts of any length are compared
    whole. An empty table gives no rows.
    """
    (own,) = unused(docs.columns, "key_")
    given, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    found = materialize(classes(docs, id_col, text_col, with_key=True), "omh-found").filter(F.col("key").isNotNull())
    head = F.col(id_col) == F.col("class_id")
    gone = found.filter(~head).select(F.col(id_col).alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    again = found.filter(head).groupBy(F.col(id_col).alias("gone_id"), F.col("key").alias("gone_key")).agg(F.count("*").alias("n")).filter("n > 1").select("gone_id", "gone_key")
    marked = docs.withColumn(own, F.unhex(F.md5(text)))
    on = lambda other: (given == other["gone_id"]) & (F.col(own) == other["gone_key"])
    drop = gone.unionByName(again)
    once = marked.join(drop, on(drop), "left_anti")
    return once.unionByName(marked.join(again, on(again), "left_semi").dropDuplicates([id_col, own])).drop(own)
