"""The training-data operators: brute force, round trips, edge cases."""

import collections
import os
import random
import re
import time

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lodestone.llm import chat, decontam, licenses, minhash, mixing, pii, quality_classifier, quality_rules, queries, sharding, toxicity
from lodestone.llm.common import held_out, text_of, word_count

DATA = os.environ.get("LODESTONE_DATA", "/root/testdata/sf0.001")
ODD = [None, "", " \n\t", "one", "a b\na b\n", "é ü ñ " * 9, "x" * 60_000, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 400]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and odd texts, a null id, repeated rows and columns with the operators' own names."""
    rows = [(i, t, "s%d" % (i % 3) if i % 3 else None, 7, "x") for i, t in enumerate(ODD)] + [(None, "some text", "s1", 7, "x"), (3, "one", "s0", 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, score string").withColumns({c: F.lit("own") for c in ("spans", "items", "shard", "kept", "licenses", "n_words", "taken")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


LABELS = "doc_id long, quality int, toxic int"


def all_operators(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1)], LABELS)
    bench = spark.createDataFrame([(1, "w1 w2 w3"), (None, "é ü"), (2, None), (3, "")], "item_id long, text string")
    yield "rules", quality_rules.apply_rules(docs)
    yield "mix", mixing.mix_documents(docs, word_count(text_of("text")))
    yield "classes", minhash.classes(docs)
    yield "decontam", decontam.find_contamination(docs, bench)
    yield "toxic", toxicity.score(docs, labels)
    yield "quality", quality_classifier.score(docs, labels)
    yield "shards", sharding.shard_documents(docs)
    yield "licenses", licenses.scan(docs)
    yield "pii", pii.find_pii(docs)


def test_odd_rows_stay(spark, odd):
    for name, df in all_operators(spark, odd):
        assert len(df.collect()) == odd.count(), name


def test_empty_tables(spark, empty):
    for name, df in all_operators(spark, empty):
        assert df.collect() == [], name
    assert minhash.dedup(empty).count() == 0


def brute_repeats(words):
    seen = collections.defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)})


def test_rules(spark):
    random.seed(1)
    texts = [t for t in ODD if t] + ["\n".join(" ".join(random.choice("abc") for _ in range(random.randint(0, 9))) for _ in range(12)) for _ in range(40)]
    rows = quality_rules.apply_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in rows:
        t = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), brute_repeats(words))
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_targets_and_flow():
    got = mixing.targets([100, 10, 50], [3, 1, 2], 240)
    # the second source is full at twice its size; the others share the rest 3 to 2
    assert got[1] == 20.0 and abs(got[0] - 132) < 1e-9 and abs(got[2] - 88) < 1e-9
    flows = mixing.route([(["a"], 10), (["a", "b"], 10), (["b"], 10)], {"a": 25, "b": 30})
    assert sum(f.get("a", 0) for f in flows) == 25 and sum(f.get("b", 0) for f in flows) == 30
    # both sources need 55 of 60: no pattern gives more than twice its size
    assert all(sum(f.values()) <= 20 for f in flows)
    # convex costs: nothing is repeated while something else is unused
    flows = mixing.route([(["a"], 10), (["a", "b"], 10)], {"a": 15, "b": 5})
    assert sorted(sum(f.values()) for f in flows) == [10, 10]


def best_mix(patterns, quotas, repeats):
    """Largest flow and least repetition cost over all integer assignments."""
    import itertools

    names = sorted(quotas)
    arcs = [(i, s) for i, (own, _) in enumerate(patterns) for s in own]
    best = (0, 0)
    for flow in itertools.product(*[range(min(repeats * patterns[i][1], quotas[s]) + 1) for i, s in arcs]):
        used = [sum(f for f, (j, _) in zip(flow, arcs, strict=True) if j == i) for i in range(len(patterns))]
        if any(u > repeats * patterns[i][1] for i, u in enumerate(used)) or any(sum(f for f, (_, t) in zip(flow, arcs, strict=True) if t == s) > quotas[s] for s in names):
            continue
        cost = sum(r * min(max(u - r * patterns[i][1], 0), patterns[i][1]) for i, u in enumerate(used) for r in range(1, repeats))
        best = max(best, (sum(flow), -cost))
    return best


def test_flow_against_all_assignments():
    random.seed(15)
    for _ in range(25):
        patterns = [(random.sample("abc", random.randint(1, 2)), random.randint(0, 3)) for _ in range(3)]
        quotas = {s: random.randint(0, 5) for s in "abc"}
        got = mixing.route(patterns, quotas)
        used = [sum(f.values()) for f in got]
        assert all(sum(f.get(s, 0) for f in got) <= quotas[s] for s in quotas) and all(u <= 2 * patterns[i][1] for i, u in enumerate(used))
        assert (sum(used), -sum(max(0, u - patterns[i][1]) for i, u in enumerate(used))) == best_mix(patterns, quotas, 2)


def test_flow_of_many_patterns():
    random.seed(16)
    names = [f"s{i}" for i in range(40)]
    patterns = [(random.sample(names, random.randint(1, 4)), random.randint(1, 1000)) for _ in range(10_000)]
    total = sum(n for _, n in patterns)
    began = time.perf_counter()
    got = mixing.route(patterns, {s: round(1.5 * total / 40) for s in names})
    assert time.perf_counter() - began < 20
    assert sum(sum(f.values()) for f in got) > 1.45 * total


def test_mixing_of_equal_rows(spark):
    # a third of the rows has one id and text, others have none
    rows = [(7, "w w w", "a")] * 1000 + [(None, "x y", "a")] * 500 + [(i, "z " * (i % 9), "a" if i % 2 else "b") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_documents(df, word_count(text_of("text")), bucket_docs=50).collect()
    by, goals = collections.Counter(), {r["source"]: r["targets"][0] for r in out}
    for r in out:
        by[r["source"]] += r["taken"]
        assert 0 <= r["copies"] <= 2
    assert len(out) == 3000 and all(abs(by[s] - goals[s]) <= 9 for s in goals)
    again = mixing.mix_documents(df.repartition(5), word_count(text_of("text")), bucket_docs=50).collect()
    count = lambda rs: collections.Counter((r["doc_id"], r["text"], r["source"], r["copies"]) for r in rs)
    assert count(out) == count(again)


def test_mixing(spark):
    random.seed(2)
    rows = [(i, "w " * random.randint(0, 30), random.choice(["a", "b", "c", "d", None, "a", "a"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(df, word_count(text_of("text")), carry=["doc_id", "source"], bucket_docs=100)
    out = got.collect()
    by = collections.defaultdict(int)
    for r in out:
        by[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    goals = {r["source"]: r["targets"][0] for r in out}
    assert all(abs(by[s] - goals[s]) <= 5 for s in goals)
    again = mixing.mix_documents(df.repartition(7), word_count(text_of("text")), carry=["doc_id"], bucket_docs=100)
    assert {(r["doc_id"], r["taken"]) for r in out} == {(r["doc_id"], r["taken"]) for r in again.collect()}
    two = df.withColumn("source", F.array("source", F.lit("z")))
    assert mixing.mix_documents(two, word_count(text_of("text"))).count() == 3000


def test_minhash_finds_copies(spark):
    random.seed(3)
    vocab = ["w%d" % i for i in range(4000)]
    text = lambda n: [random.choice(vocab) for _ in range(n)]
    shared, docs, base = text(60), [], text(200)
    for i in range(300):  # one large group of near copies
        w = list(base)
        for j in random.sample(range(200), 2):
            w[j] = f"x{i}_{j}"
        docs.append(w)
    docs += [text(40) + shared + text(40) for _ in range(120)]  # unlike texts with a common passage
    pairs = []
    for n in (4, 8, 30, 120, 900):
        a = text(n)
        b = list(a)
        if n > 100:
            b[n // 2] = "changed"
            b.insert(n // 3, "new")
        pairs.append((len(docs), len(docs) + 1))
        docs += [a, b]
    swapped = text(200)
    docs += [swapped, swapped[100:] + swapped[:100]]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = [minhash.words_of(t) for _, t in rows]
    for i in range(len(docs)):
        for j in range(i):
            if 0.8 <= len(words[i]) / len(words[j]) <= 1.25 and minhash.aligned_similarity(words[i], words[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in range(len(docs))}
    assert all(got[a] == got[b] for a, b in pairs)


def test_word_hashes_stand_for_the_words(monkeypatch):
    rng = random.Random(31)
    letters = "abB9é \n.-ß\U0001f600"
    texts = ["", " .,", "x" * 50] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    whole = [minhash.word_hashes(t).tolist() for t in texts]
    known = {}
    for text, hashes in zip(texts, whole, strict=True):
        words = minhash.words_of(text)
        assert len(words) == len(hashes) and all(known.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
    assert len(set(known.values())) == len(known)
    sketched = [minhash.sketches(minhash.kmers(np.array(h, dtype=np.uint64)), wide=True).tolist() for h in whole if h]
    # long texts come in pieces, and long matrices of ranks in blocks
    monkeypatch.setattr(minhash, "PIECE", 7)
    assert [minhash.word_hashes(t).tolist() for t in texts] == whole
    assert [minhash.sketches(minhash.kmers(np.array(h, dtype=np.uint64)), wide=True).tolist() for h in whole if h] == sketched


def test_second_family_finds_short_texts():
    rng = np.random.default_rng(12)

    def lost(shared, own, tries, wide=True):
        """Pairs of ``shared + own`` k-mers, ``shared`` in common, without a common sketch."""
        n = 0
        for _ in range(tries):
            h = rng.integers(0, 2**63, shared + 2 * own, dtype=np.int64).astype(np.uint64)
            a, b = h[: shared + own], np.concatenate([h[:shared], h[shared + own :]])
            n += not set(minhash.sketches(a, wide=wide).tolist()) & set(minhash.sketches(b, wide=wide).tolist())
        return n

    # similarity 0.8 at 45, 90 and 180 k-mers (100 sketches of 12 alone lose about 18, 5 and 3 of 2,000)
    assert lost(40, 5, 2000) == lost(80, 10, 2000) == lost(160, 20, 2000) == 0


def test_minhash_follows_chains(spark):
    rng = random.Random(11)
    rows, parent = [], {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for chain in range(60):
        w = [f"c{chain}_{i}" for i in range(150)]
        own = []
        for step in range(9):
            own.append((len(rows), list(w)))
            rows.append((len(rows), " ".join(w)))
            # copies of copies: neighbours are similar, texts further apart are not
            if step % 3 != 2:
                at = rng.randrange(0, 130)
                w[at : at + 8] = [f"n{chain}_{step}_{i}" for i in range(8)]
            else:
                w = list(own[rng.randrange(len(own))][1])
                w[70:78] = [f"n{chain}_{step}_{i}" for i in range(8)]
        for i, _ in own:
            parent[i] = i
        for i, a in own:
            for j, b in own:
                if i < j and minhash.aligned_similarity(a, b) >= 0.8:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i, _ in rows}


def test_bits_never_bound_too_low(spark):
    rng = random.Random(21)
    vocab = ["v%d" % i for i in range(300)]
    base = [rng.choice(vocab) for _ in range(400)]
    hashes = []
    for _ in range(12):
        w = list(base)
        for j in rng.sample(range(400), rng.randint(0, 20)):
            w[j] = rng.choice(vocab)
        hashes.append(minhash.labelled(minhash.kmers(minhash.word_hashes(" ".join(w)))))
    rows = [(i, len(h), [int(x) for x in minhash.bits_of(h)]) for i, h in enumerate(hashes)] + [(99, 300, None)]
    a = spark.createDataFrame(rows, "i int, n long, x array<long>")
    b = a.withColumnsRenamed({"i": "j", "n": "m", "x": "y"})
    got = {(r["i"], r["j"]): r["ok"] for r in a.crossJoin(b).select("i", "j", minhash.may_share(F.col("n"), F.col("m"), F.col("x"), F.col("y")).alias("ok")).collect()}
    similar = lambda p, q: len(set(p.tolist()) & set(q.tolist())) / len(set(p.tolist()) | set(q.tolist()))
    pairs = [(i, j) for i in range(12) for j in range(12)]
    assert all(got[i, j] for i, j in pairs if similar(hashes[i], hashes[j]) >= minhash.LEAST)
    assert all(got[99, j] for j in range(12))
    assert not all(got[i, j] for i, j in pairs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_minhash_recall_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], minhash.words_of(r["text"])) for r in docs.filter("text IS NOT NULL").collect()]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    n = found = 0
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and minhash.aligned_similarity(x, y) >= minhash.LEAST:
                n, found = n + 1, found + (got[a] == got[b])
    assert n > 5 and found >= 0.99 * n


def test_dedup_keeps_one(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, None), (5, "other words"), (5, "a b c d e f g"), (None, "a b c d e f g"), (1, "a b c d e f g")]
    got = sorted(minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: (r["doc_id"] or 0, r["text"] or ""))
    assert [tuple(r) for r in got] == [(None, "a b c d e f g"), (1, "a b c d e f g"), (3, None), (4, None), (5, "other words")]


def test_alignment():
    a = [b"%d" % i for i in range(500)]
    assert minhash.aligned_similarity(a, a) == 1.0
    b = a[:250] + [b"x"] + a[250:]
    assert 0.97 < minhash.aligned_similarity(a, b) < 1
    assert minhash.aligned_similarity(a, a[250:] + a[:250]) < 0.8
    assert minhash.aligned_similarity(a, [b"y"] * 500) == 0.0


def brute_hits(text, items):
    w = decontam.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        b = decontam.words_of(t)
        m = min(13, len(b))
        windows = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_decontamination(spark, block):
    random.seed(4)
    items = [(str(i), " ".join(random.choice("abcd") + random.choice("xy") for _ in range(random.choice([0, 1, 2, 5, 13, 30])))) for i in range(12)]
    texts = [" ".join(random.choice("abcd") + random.choice("xy") for _ in range(60)) for _ in range(20)]
    texts += [t + " " + random.choice(items)[1].upper() + " É " + t for t in texts[:10]] + [None, "", "---"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for r in decontam.find_contamination(docs, bench, block_bytes=block).collect():
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) == brute_hits(texts[r["doc_id"]], items)


def test_decontamination_of_a_giant_item(spark):
    random.seed(14)
    words = [random.choice("abcd") + random.choice("xyz") + random.choice("pq") for _ in range(3000)]
    docs = [" ".join(words[i : i + 20]) for i in range(0, 2900, 97)] + [" ".join(reversed(words[:50]))]
    docs += docs[:3]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([("big", " ".join(words))], "item_id string, text string")
    for r in decontam.find_contamination(df, bench, block_bytes=500).collect():
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) == brute_hits(docs[r["doc_id"]], [("big", " ".join(words))])


def test_chat_round_trip(spark):
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "[\\INST] <\\\\s> [TURN]x[/TURN]"), (None, None), ("assistant", ""), ("us[TURN]er", "tail <"), ("assistant", "s> end ["), ("user", "last")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, "user", "only"), (None, 0, "assistant", "x")]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = made.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")).orderBy("conv_id", "example").collect()
    mine = [r for r in got if r["conv_id"] == 1]
    assert [(t["role"], t["text"]) for t in mine[-1]["turns"]] == [(r or "", t or "") for r, t in turns]
    assert [r["loss"] for r in mine] == ["[\\INST] <\\\\s> [TURN]x[/TURN]", "", "s> end [", ""]
    assert [r["n_turns"] for r in mine] == [2, 4, 6, 7]
    assert [r["loss"] for r in got if r["conv_id"] == 2] == [""]


def test_trees():
    rng = np.random.default_rng(5)
    x = rng.random((800, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    model = quality_classifier.fit(x[:600], y[:600])
    assert ((model.score(x[600:]) > 0.5) == y[600:]).mean() > 0.95

    def walk(row):
        z = model.base
        for k in model.roots:
            while model.left[k] != k:
                k = model.left[k] if row[model.feature[k]] <= model.threshold[k] else model.right[k]
            z += model.value[k]
        return 1 / (1 + np.exp(-z))

    assert np.allclose([walk(r) for r in x[:50]], model.score(x[:50]))
    assert quality_classifier.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_toxicity_by_compression():
    random.seed(6)
    plain = ["".join(random.choice(["lo", "ra", "mi", "tu", "se"]) for _ in range(3)) for _ in range(300)]
    bad = ["grumblefax", "snotterwick", "blaggardly"]
    rows = []
    for i in range(400):
        w = [random.choice(plain) for _ in range(80)]
        if i % 4 == 0:
            for j in random.sample(range(80), 4):
                w[j] = random.choice(bad)
        rows.append((" ".join(w), int(i % 4 == 0)))
    model = toxicity.train(rows[:300])
    p = model.score([t for t, _ in rows[300:]])
    y = np.array([y for _, y in rows[300:]])
    assert ((p >= 0.3) == (y == 1)).mean() > 0.9
    assert len(model.score([None, ""])) == 2 and toxicity.train([]).score(["x"])[0] == 0.5


def test_toxic_dictionary_is_trained_at_small_sizes():
    random.seed(8)
    rows = [(" ".join(random.choice(["grumblefax", "snotterwick", "blaggardly"] if i % 2 and j % 5 == 0 else ["lora", "mitu", "sela", "ramitu"]) for j in range(80)), i % 2) for i in range(200)]
    ordinary, toxic = toxicity.train(rows).dictionaries
    magic = b"\x37\xa4\x30\xec"
    assert ordinary.startswith(magic) and toxic.startswith(magic)


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_toxicity_at_any_share_of_labels(spark, share):
    random.seed(9)
    plain = ["".join(random.choice(["lo", "ra", "mi", "tu", "se", "ki"]) for _ in range(3)) for _ in range(400)]
    bad, rows = ["grumblefax", "snotterwick", "blaggardly", "twonkish"], []
    for i in range(900):
        w = [random.choice(plain) for _ in range(60)]
        y = int(random.random() < share)
        if y:
            for j in random.sample(range(60), 4):
                w[j] = random.choice(bad)
        rows.append((i, " ".join(w), y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(docs.drop("toxic"), docs.select("doc_id", "toxic")).join(docs.filter(held_out("doc_id")).select("doc_id", "toxic"), "doc_id").collect()
    p, y = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    assert len(set(p.round(3))) > 2 and p[y == 1].mean() > p[y == 0].mean() + 0.6
    assert ((p >= 0.5) == (y == 1)).mean() > 0.95


def test_toxic_dictionary_holds_what_compression_picked():
    random.seed(10)
    plain = ["".join(random.choice(["lo", "ra", "mi", "tu", "se"]) for _ in range(3)) for _ in range(200)]
    bad = [" ".join(random.choice(["snotterwick", random.choice(plain)]) if j % 9 == 0 else random.choice(plain) for j in range(60)) for _ in range(150)]
    base, both = toxicity.dictionaries(bad, [" ".join(random.choice(plain) for _ in range(60)) for _ in range(150)])
    word = toxicity.stretched(b"snotterwick")
    assert both.endswith(base) and word in both and word not in base
    one, two = toxicity.compressor(base), toxicity.compressor(both)
    saved = lambda w: len(one.compress(toxicity.stretched(w))) - len(two.compress(toxicity.stretched(w)))
    assert saved(b" snotterwick ") > max(saved(b" " + w.encode() + b" ") for w in plain[:50])


def test_toxicity_sample(spark):
    rows = [(i, "é" * 50, int(i % 10 == 0)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    learned = labels.filter(~held_out("doc_id")).groupBy("toxic").count().collect()
    there = {r["toxic"]: r["count"] for r in learned}
    count = lambda **how: collections.Counter(y for _, y in toxicity.sample(docs, labels, "toxic", "text", "doc_id", **how))
    # of either class up to max_rows, whatever its share of the labels
    assert count(max_rows=60, max_bytes=10**6) == {1: 60, 0: 60} and there[1] >= 60
    # half of max_bytes for each class, in bytes; one class never takes the other's place
    assert count(max_rows=60, max_bytes=4000) == {1: 20, 0: 20}
    flipped = labels.withColumn("toxic", 1 - F.col("toxic"))
    assert collections.Counter(y for _, y in toxicity.sample(docs.drop("toxic"), flipped, "toxic", "text", "doc_id", 50, 10**6)) == {1: 50, 0: 50}


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_minimax(shards):
    random.seed(shards)

    def brute(sizes):
        best = {(0, 0): 0}
        for k in range(1, shards + 1):
            for j in range(len(sizes) + 1):
                best[j, k] = min((max(best.get((i, k - 1), 10**9), sum(sizes[i:j])) for i in range(j + 1)), default=10**9)
        return best[len(sizes), shards]

    for _ in range(6):
        sizes = [random.randint(0, 20) for _ in range(random.randint(0, 14))]
        ends = sharding.cuts(sizes, shards)
        starts = [0, *ends[:-1]]
        assert len(ends) == shards and ends[-1] == len(sizes) and all(a <= b for a, b in zip(starts, ends, strict=True))
        assert max(sum(sizes[a:b]) for a, b in zip(starts, ends, strict=True)) == sharding.minimax_capacity(sizes, shards)
        if len(sizes) and shards < 24:
            assert sharding.minimax_capacity(sizes, shards) == brute(sizes)


def test_shards(spark):
    rows = [(i, "text %d" % (i % 700)) for i in range(2000)] + [(10_000 + i, "hot") for i in range(1500)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id", "text"]).collect()
    where, slots, sizes = {}, collections.defaultdict(list), collections.Counter()
    for r in out:
        assert where.setdefault(r["text"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert len(out) == 3500 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    others = [n for s, n in sizes.items() if s != where["hot"]]
    assert max(others) < 1.1 * min(others)


@pytest.mark.parametrize("bits", [(2, 1), (4, 2), (16, 8)])
def test_capacity_is_that_over_all_groups(spark, monkeypatch, bits):
    random.seed(17)
    monkeypatch.setattr(sharding, "FIRST_BITS", bits[0])
    monkeypatch.setattr(sharding, "MORE_BITS", bits[1])
    texts = ["t%d " % random.randint(0, 400) * random.randint(1, 20) for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = df.select("doc_id", F.xxhash64("text").alias("h")).collect()
    by = collections.Counter()
    for r in hashes:
        by[r["h"]] += len(texts[r["doc_id"]].encode()) + 8
    sizes = collections.Counter()
    shard_of = {}
    for r in sharding.shard_documents(df, n_shards=9).collect():
        sizes[r["shard"]] += r["size"]
        shard_of[r["text"]] = r["shard"]
    order = [by[h] for h in sorted(by)]
    assert max(order) * 9 < sum(order)
    assert max(sizes.values()) == sharding.minimax_capacity(order, 9)


def test_shards_of_null_and_equal_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, None), (1, ""), (1, ""), (2, "b" * 50)], "doc_id long, text string")
    out = sharding.shard_documents(df, n_shards=3).collect()
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 6 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in out if not r["text"]}) == 1
    sharding.write_shards(df, f"file://{tmp_path}/s", n_shards=3)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 6


def test_licenses(spark):
    scanner = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            words = licenses.words_of(t)
            found = scanner.find([b"noise"] * 400 + words + [b"noise"] * 400 + words)
            assert found[0][1:] == (400, 400 + len(words), 1.0) and len(found) == 2, name
            assert found[0][0] == name
    words = licenses.words_of(licenses.TEMPLATES["MIT"][1])
    words[10] = words[30] = b"changed"
    assert scanner.find(words)[0][0] == "MIT"
    assert scanner.find(licenses.words_of("the license of the software and the public general version under")) == []
    # words of a template over and over are no license, and cost no alignment for each of them
    began = time.perf_counter()
    assert scanner.find([b"software", b"the", b"of", b"copyright"] * 20_000) == [] and time.perf_counter() - began < 10
    a, b = list("abcXdefg"), list("abcdYefg")
    assert patience_ok(licenses.patience(a, b), a, b)


def patience_ok(pairs, a, b):
    return all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs) == 7


def luhn(s):
    return sum((int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_pii(t):
    out = []
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in kinds:
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark):
    random.seed(7)
    bits = ["a@b.co", "a@b.c@d.e", "x_y@z.org_q@r.st", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.1.1.1", "4539 1488 0343 6467", "4539-1488-0343-6467-1", "+1 (345) 678-9012", "+12", "+1+23456789", "é", " ", ",", "..", "-", "7" * 17]
    texts = ["".join(random.choice(bits) for _ in range(12)) for _ in range(300)] + ["9" * 3000 + "." * 50 + "a" * 3000]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in rows:
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]]
        assert got == brute_pii(texts[r["doc_id"]])
    r = pii.find_pii(spark.createDataFrame([(1, "Mr. John Smith has password=abc123xyz and a@b.co")], "doc_id int, text string")).select(pii.redact(F.col("text"), F.col("spans")).alias("t")).first()
    assert r["t"].endswith("and [email]") and "[secret]" in r["t"]


def test_pii_further_kinds_are_whole(spark):
    secrets = ["password=" + "aB3" * 40, 'token = "abc def 123456"', "token='q1w2e3r4'", "secret= s3cr3t99", "api_key=k1k2k3k4k5", 'token = "' + "z9" * 60 + '"']
    ibans = ["NO9386011117947", "BE68539007547034", "NL91ABNA0417164300", "CH9300762011623852957", "DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "IT60X0542811101000000123456", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606"]
    rows = [(i, f"my key: {t} , then") for i, t in enumerate(secrets + ibans)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = pii.candidates(docs, "text", [F.col("doc_id"), F.col("text")]).collect()
    kinds = {pii.KINDS.index("secret"): secrets, pii.KINDS.index("iban"): ibans}
    got = {r["text"][s["start"] : s["end"]] for r in found for s in r["spans"] if s["kind"] in kinds}
    assert got == set(secrets + ibans)
    r = pii.find_pii(docs).select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {x["t"] for x in r if x["doc_id"] < len(secrets)} == {"my key: [secret] , then"}


def test_pii_against_brute_force_where_kinds_overlap(spark):
    random.seed(13)
    bits = ["a@b.co", "password=abc123xyz", "token=q1w2e3@r4.de", "1.2.3.4", "123-45-6789", "Mr. John Smith", "4539 1488 0343 6467", "+1 (345) 678-9012", " ", ", ", "é", "DE89370400440532013000"]
    texts = ["".join(random.choice(bits) for _ in range(25)) for _ in range(60)]
    rows = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "text", [F.col("doc_id")]).collect()
    alone = [pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "text", [F.col("doc_id")])]
    assert len(alone[0].collect()) == len(rows)
    for r in rows:
        t, spans = texts[r["doc_id"]], r["spans"]
        base = [s for s in spans if s["base"]]
        more = [s for s in spans if s["kind"] >= len(pii.BASE)]
        assert all(m["end"] <= b["start"] or b["end"] <= m["start"] for m in more for b in base)
        # whatever matches and overlaps no base span is there
        for k, (_, _, pattern) in enumerate(pii.EXTRA, len(pii.BASE)):
            want = [m.span() for m in regex.finditer(pattern, t) if all(m.end() <= b["start"] or b["end"] <= m.start() for b in base)]
            assert [(s["start"], s["end"]) for s in more if s["kind"] == k] == want


def test_pii_many_matches_in_one_text(spark):
    text = " ".join(f"user{i}@host{i}.org" for i in range(16_000))
    began = time.perf_counter()
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("spans", pii.redact(F.col("text"), F.col("spans")).alias("t")).first()
    assert len(r["spans"]) == 16_000 and time.perf_counter() - began < 20
    assert all(text[s["start"] : s["end"]] == f"user{i}@host{i}.org" for i, s in enumerate(r["spans"])) and r["t"] == " ".join(["[email]"] * 16_000)


def test_scanned(spark):
    for n in (0, 1, 2, 7, 100):
        r = spark.range(1).select(F.expr(f"transform(sequence(1, {n}), x -> cast(x as int))" if n else "cast(array() as array<int>)").alias("x")).select(pii.scanned(F.col("x"), F.lit(0), lambda a, x: a + x).alias("s")).first()
        assert r["s"] == [i * (i + 1) // 2 for i in range(n)]


def test_held_out(spark):
    import zlib

    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_and_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, DATA)
        rel = c.execute(sql)
        names = [d[0] for d in rel.description]
        want = sorted((tuple(r[names.index(x)] for x in df.columns) for r in rel.fetchall()), key=repr)
        assert sorted(map(tuple, df.collect()), key=repr) == want, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(p.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, DATA).persist()
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert after and set(after) <= before, name
        assert i == len(p.STAGES) - 1 or docs.columns == columns
        if name == "near-dedup":
            again = minhash.classes(docs).collect()
            assert len({r["class_id"] for r in again}) == len(again)
        if name == "decontamination":
            assert decontam.find_contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter(decontam.is_contaminated()).count() == 0
