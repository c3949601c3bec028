"""Texts of wide buckets meet by their rarest shared k-mers: few rows for each text, no similar pair lost."""

import random

from pyspark.sql import functions as F

from lodestone.llm import minhash


def test_wide_buckets_are_dealt_by_few_k_mers(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(124)]
    texts = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(12), rng.randint(0, 3)):
            w[10 * j : 10 * j + 3] = [f"x{j}_{rng.randint(0, 2)}_{q}" for q in range(3)]
        texts.append(" ".join(w))
    texts = sorted(set(texts))
    keys = {bytes([i]) * 16: t for i, t in enumerate(texts)}
    own = {k: set(minhash.labelled(minhash.kmers(minhash.word_hashes(t))).tolist()) for k, t in keys.items()}
    table = spark.createDataFrame(list(keys.items()), "key binary, text string")
    bucket = spark.createDataFrame([(1, k, len(own[k]), k) for k in keys], "v long, key binary, n long, c binary")
    dealt, bits = minhash.undecided(bucket, table)
    rows = [(bytes(r["key"]), r["n"], r["s"]) for r in dealt.collect()]
    count = {k: sum(key == k for key, _, _ in rows) for k in keys}
    # a fifth of the k-mers and one more (100 sketches and more for each text before)
    assert rows and all(count[k] <= len(own[k]) // 5 + 1 for k in keys)
    met = {(bytes(r["a"]), bytes(r["b"])) for r in minhash.across(dealt, bits).collect()}
    similar = {(a, b) for a in keys for b in keys if a < b and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])}
    assert similar and similar <= met and len(met) < len(keys) * (len(keys) - 1) // 2


def test_bounds_let_ties_through(spark):
    # 28 of 35 k-mers, 56 of 70 and so on are just similar enough
    ties = spark.range(1, 2000).select((4 * F.col("id")).alias("s"), (F.col("id") * 9 - F.col("id") * 5).alias("n"), (5 * F.col("id")).alias("m"))
    alike = minhash.alike(F.col("n"), F.col("m"), F.col("s"), F.col("s"))
    assert ties.filter(~alike).count() == 0
    assert ties.filter(minhash.alike(F.col("n"), F.col("m"), F.col("s") - 1, F.col("s"))).count() == 0
