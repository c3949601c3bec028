"""Operators and pipeline stages: any column names, empty tables, odd rows, and the stages against plain versions."""

import collections
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import chat, decontam, licenses, minhash, mixing, pii, quality_classifier, quality_rules, sharding, toxicity
from lodestone.llm.common import text_of, unused, word_count

DATA = os.environ.get("LODESTONE_DATA", "/root/testdata/sf0.001")
BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
#: Names that the operators use on the way, and those of their results.
NAMES = (
    "text_ counts_ key_ found_ pattern_ order_ row_ pid_ whole_ rest_ buckets_ bucket_ cut_ room_ some_ hash_ slice_ before_ spans_ copy_ in_score in_size __text __spans __bucket __pattern __m __y __id __key "
    "score predicted size sources source_sizes targets copies taken spans items n_words licenses shard slot law kept base_failed n key v c s label class id block here place slice h y block_"
).split()


@pytest.fixture(scope="module")
def crowded(spark):
    texts = ["one two three four five six", "one two three four five six", None, "", "a b\na b\n", "mail me@x.org or +1 345 678 9012", "w " * 300]
    docs = spark.createDataFrame([(i, t, "s%d" % (i % 2)) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return docs.withColumns({n: F.lit("own " + n) for n in NAMES})


def outputs(spark, docs):
    bench, labels = spark.createDataFrame([(1, "one two three")], BENCH), spark.createDataFrame([(0, 1, 0), (3, 0, 1)], LABELS)
    yield quality_rules.apply_rules(docs)
    yield mixing.mix_documents(docs, word_count(text_of("text")))
    yield decontam.find_contamination(docs, bench)
    yield decontam.find_contamination(docs, spark.createDataFrame([(i, f"one two w{i}") for i in range(5)], BENCH), block_bytes=20)
    yield toxicity.score(docs, labels)
    yield quality_classifier.score(docs, labels)
    yield sharding.shard_documents(docs)
    yield licenses.scan(docs)
    yield pii.find_pii(docs)
    yield minhash.dedup(docs)


RESULTS = "score predicted size sources source_sizes targets copies taken spans items n_words licenses shard slot law kept base_failed".split()


def test_columns_of_any_name_come_through(spark, crowded):
    for out in outputs(spark, crowded):
        assert len(set(out.columns)) == len(out.columns)
        kept = [c for c in NAMES if c in out.columns and c not in RESULTS]
        assert len(kept) == len(NAMES) - len(RESULTS)
        for r in out.select(*kept).collect():
            assert all(r[c] == "own " + c for c in kept)


def test_chat_of_any_table(spark):
    schema = "conv_id long, turn long, role string, text string, example string, formatted string, n_turns string, __pieces string"
    assert chat.examples(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 0, "user", "hi", "x", "y", "z", "p"), (1, 1, "assistant", "there", "x", "y", "z", "p"), (None, 0, None, None, "x", "y", "z", "p")]
    got = chat.examples(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 2
    with pytest.raises(ValueError, match="result column"):
        chat.examples(spark.createDataFrame(rows, schema), id_col="example")


def test_unused_names():
    assert unused(["A_", "b"], "a_", "b", "c", "c") == ("a__", "b_", "c", "c_")


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (4, 0, 0), (None, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "three four five"), (None, None)], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_and_odd_tables(spark, crowded, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, crowded.filter("false"), folder).collect() == []
    twice = crowded.unionByName(crowded.filter("doc_id = 0")).unionByName(crowded.filter("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    out = stage(spark, twice, folder)
    rows = out.collect()
    if name != "sharding":
        assert out.columns == crowded.columns
    ids = collections.Counter(r["doc_id"] for r in rows)
    if name == "near-dedup":
        assert ids == {0: 1, None: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    if name == "decontamination":
        assert ids == {2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    if name == "mixing":
        assert 2 not in ids and 3 not in ids and ids
    if name == "sharding":
        assert len(rows) == 9


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = {i: minhash.words_of(t) for i, t in rows if t is not None}
    same = collections.defaultdict(list)
    for i, t in rows:
        if t is not None:
            same[t].append(i)
    for ids in same.values():
        for i in ids[1:]:
            parent[max(root(i), root(ids[0]))] = min(root(i), root(ids[0]))
    ids = list(words)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = words[i], words[j]
            if a and b and root(i) != root(j) and 0.8 <= len(a) / len(b) <= 1.25 and minhash.aligned_similarity(a, b) >= minhash.LEAST:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


def brute_hits(words, windows):
    hit = set()
    for m, own in windows.items():
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in own:
                hit.update(range(i, i + m))
    return len(hit)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    trees = quality_classifier.train(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    def walk(x):
        z = trees.base
        for k in trees.roots:
            while trees.left[k] != k:
                k = trees.left[k] if x[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
            z += trees.value[k]
        return z

    good = stages["quality classifier"](spark, docs, DATA).persist()
    # probability 0.7 is log(7 / 3); a score that near the threshold is not in the tables
    assert ids(good) == sorted(i for i, t in rows if walk(quality_classifier.statistics([t or ""])[0]) >= 0.8472978603872037)

    once = stages["near-dedup"](spark, good, DATA).persist()
    classes = brute_classes([(r["doc_id"], r["text"]) for r in good.collect()])
    assert ids(once) == sorted(i for i, c in classes.items() if i == c)

    clean = stages["decontamination"](spark, once, DATA).persist()
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = decontam.words_of(r["text"])
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[m].add(tuple(w[i : i + m]))
    want = []
    for r in once.collect():
        w = decontam.words_of(r["text"])
        n = brute_hits(w, windows)
        if not (n and 20 * n >= len(w)):
            want.append(r["doc_id"])
    assert ids(clean) == sorted(want)

    mixed = stages["mixing"](spark, clean, DATA).persist()
    taken = collections.Counter(r["doc_id"] for r in mixed.collect())
    sizes = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in clean.collect()}
    total = collections.Counter()
    for source, n in sizes.values():
        total[source] += n
    goals = dict(zip(sorted(total), mixing.targets([total[s] for s in sorted(total)], [mixing.WEIGHTS[i % 3] for i in range(len(total))], 1.5 * sum(total.values())), strict=True))
    got = collections.Counter()
    for i, k in taken.items():
        assert k <= 2
        got[sizes[i][0]] += k * sizes[i][1]
    # short of its goal by less than the longest document, and never above it
    longest = max(n for _, n in sizes.values())
    assert all(goals[s] - longest <= got[s] <= goals[s] + 1 for s in total)

    out = stages["sharding"](spark, mixed, DATA).collect()
    by_shard, shard_of = collections.Counter(), {}
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    groups = collections.Counter()
    for r in out:
        by_shard[r["shard"]] += r["size"]
        assert shard_of.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
        groups[text[r["doc_id"]]] += r["size"]
    assert len(out) == sum(taken.values()) and max(by_shard.values()) <= sum(groups.values()) / 24 + 2 * max(groups.values())
