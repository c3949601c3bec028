"""Posting blocks, versioned tables, draining of segments and saved responses."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import scores
from lodestone.operators import blocks, search, store
from lodestone.plans import stored
from lodestone.plans.engine import Engine
from lodestone.sources import responses, versions
from lodestone.sources.snapshots import Segments
from lodestone.streaming import jobs

DATA = os.environ.get("LODESTONE_DATA", "/root/testdata/sf0.001")

# --- posting blocks


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = rng.sample(["oak", "elm", "fir", "ash", "yew"], rng.randint(1, 4))
        rows.append((i, i, round(10 - i / 50, 3), rng.choice(["oak", "pine", "moss"]), "p/" + rng.choice("xyz"), " ".join(rng.sample(words, rng.randint(0, len(words)))), "", words))
    docs = spark.createDataFrame(rows, "doc_id int, place int, prior double, name string, path string, synopsis string, sentences string, words array<string>").withColumn("range", blocks.range_of(F.col("place"), 16))
    posts = docs.select(F.lit("text").alias("field"), F.explode("words").alias("token"), "doc_id")
    return rows, docs.drop("words").cache(), blocks.of_postings(posts, docs, 16).cache(), blocks.of_docs(docs, 16).cache()


IDFS = {"oak": (0.7, 0.9), "elm": (0.4, 0.4), "fir": (1.2, 0.2), "none": (2.0, 2.0)}


def score_of(row, tokens):
    _, _, prior, name, path, synopsis, _, _ = row
    s = 0.02 * len(tokens) if tokens else 1.0
    for t in sorted(tokens):
        text, named = IDFS[t]
        s += 0.25 * text * (t in synopsis) + 0.25 * named * (t in name) + 0.1 * text * (t in path)
    return round(prior * s, 6)


@pytest.mark.parametrize("tokens", [["oak"], ["elm", "oak"], ["elm", "fir", "oak"], ["none"], ["none", "oak"], []])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_best_hits_from_blocks(spark, corpus, tokens, k):
    rows, docs, posts, ranges = corpus
    query = [(t, *IDFS[t]) for t in tokens]
    text = lambda c: (F.col(c), F.filter(F.split(c, "[^a-z]+"), lambda x: x != ""))
    fields = {c: text(c) for c in ("synopsis", "sentences", "name", "path")}
    score = lambda df: df.withColumn("score", F.round(F.col("prior") * scores.match_score(query, fields), 6))
    found = blocks.top(posts, ranges, docs, query, k, score, [F.asc("doc_id")], 16, at_first=2)
    want = sorted(((-score_of(r, tokens), r[0]) for r in rows if set(tokens) <= set(r[7])))[:k]
    assert sorted((-r["score"], r["doc_id"]) for r in found.hits.collect()) == want
    if k == 1 and tokens in (["oak"], ["elm", "oak"]):
        n = blocks.counts(found, posts, tokens).first()
        assert 0 < n["read"] < n["total"] / 2


def test_blocks_are_bounded_and_cover_all(corpus):
    rows, _, posts, _ = corpus
    got = posts.collect()
    assert all(r["n"] == len(r["places"]) <= 16 and r["first"] == r["places"][0] and r["last"] == r["places"][-1] for r in got)
    assert sorted((r["token"], p) for r in got for p in r["places"]) == sorted((w, r[1]) for r in rows for w in r[7])


def test_search_writes_nothing(spark, tmp_path):
    from lodestone.operators.index import DOC

    doc = lambda pkg: (pkg[-1], pkg, None, None, 0, "a tree", "a tree", "", "", "", [], [], None)
    engine = Engine(spark, f"file://{tmp_path}/index")
    engine.index(spark.createDataFrame([doc("h.org/u/a"), doc("h.org/u/b"), doc("h.org/u/b/c")], DOC), F.lit("2024-01-01").cast("timestamp"))
    files = lambda: {p for p in tmp_path.rglob("*")} | {p for p in shared.rglob("*")}
    from pathlib import Path

    from lodestone.sources.snapshots import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = files()
    page = engine.results("tree")
    assert [(d["rank"], d["package"], d["subs"]) for d in page["docs"]] == [(1, "h.org/u/a", []), (2, "h.org/u/b", ["h.org/u/b/c"])]
    assert [r["package"] for r in engine.top("tree", 2).orderBy("rank").collect()] == ["h.org/u/a", "h.org/u/b"]
    assert {p for p in files() - before if "temporary" not in str(p)} == set()


def test_lists_of_all_packages_come_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "RUN", 3)
    engine = Engine(spark, f"file://{tmp_path}/index")
    names = ['h.org/u/"a"\\b', "h.org/ü/c\n"] + [f"h.org/u/p{i}" for i in range(9, 0, -1)]
    engine.hits = spark.createDataFrame([(p, i) for i, p in enumerate(names)], "package string, doc_id long").repartition(4)
    want = json.dumps(names, ensure_ascii=False, separators=(",", ":"))
    assert engine.api("packages") == (200, want) and tuple(engine.answer("Packages").first()) == (200, want)
    assert tuple(engine.answer("packages", callback="c-b").first()) == engine.api("packages", callback="c-b") == (200, f"cb(200, {want});")
    engine.hits = engine.hits.limit(0)
    assert engine.api("packages") == (200, "[]") and tuple(engine.answer("packages").first()) == (200, "[]")
    assert tuple(engine.answer("what").first()) == engine.api("what")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_list_of_packages_is_not_sent_by_the_driver(spark, monkeypatch):
    # a task that carries a body above spark.rpc.message.maxSize is refused on a cluster
    stored.engine(spark, DATA)
    sent, make = [], SparkSession.createDataFrame
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *a, **b: sent.extend(str(r) for r in data) or make(self, data, *a, **b))
    bodies = {r["action"]: r["body"] for r in stored.engine_api(spark, DATA).collect()}
    assert len(json.loads(bodies["packages"])) == stored.engine(spark, DATA).total() and max(map(len, sent)) < 100 < len(bodies["packages"])


# --- versioned tables


def table_at(spark, tmp_path, buckets=4):
    return versions.Table(spark, f"file://{tmp_path}/t", StructType.fromDDL("package string, n long"), "package", buckets)


def rows_of(df):
    return {r["package"]: r["n"] for r in df.collect()}


def put(rows, changes):
    return rows.join(changes.select("package"), "package", "left_anti").select("package", "n").unionByName(changes.select("package", "n"))


def test_versions(spark, tmp_path):
    t = table_at(spark, tmp_path)
    df = lambda rows: spark.createDataFrame(rows, "package string, n long")
    assert rows_of(t.read()) == {} and t.numbers() == []
    t.overwrite(df([("a", 1), ("b", 2), (None, 3), ("", 4)]))
    t.append(df([("c", 5)]))
    assert t.change(df([("a", 10), ("d", 6)]), put, mark=("w", 0)) == 3
    assert t.change(df([("a", 99)]), put, mark=("w", 0)) is None  # the batch is there
    assert rows_of(t.read()) == {"a": 10, "b": 2, None: 3, "": 4, "c": 5, "d": 6}
    assert rows_of(t.read(1)) == {"a": 1, "b": 2, None: 3, "": 4} and rows_of(t.read(2))["a"] == 1
    assert rows_of(t.read(keys=["a", "zz"])) == {"a": 10}
    assert len(t.read(keys=["a"]).inputFiles()) < len(t.read().inputFiles())
    assert t.change(df([]), put) == 4 and rows_of(t.read()) == rows_of(t.read(3))
    t.expire(1)
    assert t.numbers() == [4] and rows_of(t.read())["d"] == 6
    t.overwrite(df([]))
    assert rows_of(t.read()) == {}


def test_a_change_leaves_other_buckets_alone(spark, tmp_path):
    t = table_at(spark, tmp_path, 16)
    t.overwrite(spark.range(200).select(F.concat(F.lit("p"), "id").alias("package"), F.col("id").alias("n")))
    old = t.manifest()
    t.change(spark.createDataFrame([("p7", -7)], "package string, n long"), put)
    new = t.manifest()
    assert [b for b in old.buckets if old.buckets[b] != new.buckets[b]] == [str(spark.createDataFrame([("p7",)], "k string").select(versions.bucket_of(F.col("k"), 16)).first()[0])]


def test_two_writers_and_a_reader(spark, tmp_path):
    t = table_at(spark, tmp_path)
    t.overwrite(spark.createDataFrame([("sum", 0)], "package string, n long"))
    pinned = t.read(1)
    failed = []

    def add(rows, changes):
        return rows.join(changes.withColumnRenamed("n", "more"), "package").select("package", (F.col("n") + F.col("more")).alias("n"))

    def writer(k):
        try:
            for _ in range(3):
                t.change(spark.createDataFrame([("sum", k)], "package string, n long"), add, tries=30)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in (1, 100)]
    for x in threads:
        x.start()
    seen = [rows_of(t.read())["sum"] for _ in range(5)]
    for x in threads:
        x.join(120)
    # no change is lost, no reader met a table that isn't there, the first version is as it was
    assert not failed and rows_of(t.read()) == {"sum": 303} and t.numbers() == list(range(1, 8))
    assert seen == sorted(seen) and rows_of(pinned) == {"sum": 0}


def test_a_lost_race_is_a_conflict(spark, tmp_path):
    t = table_at(spark, tmp_path)
    t.overwrite(spark.createDataFrame([("a", 1)], "package string, n long"))
    with pytest.raises(versions.Conflict):
        t._create(versions.Manifest(1))
    assert rows_of(t.read()) == {"a": 1}


# --- segments as a stream


def test_drain_counts_a_segment_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/web"
    t = versions.Table(spark, f"file://{tmp_path}/entries", StructType.fromDDL("package string, found_way string"), "package", 4)
    t.overwrite(spark.createDataFrame([("a.org/known", "before")], "package string, found_way string"))
    assert store.submit(spark, root, "a.org/known\na.org/x\n\nnot a path")[0] == 2
    segments = Segments(spark, root)
    segments.new_max()  # one that is not finished
    entries = lambda found: found.withColumn("found_way", F.lit("web"))
    run = lambda: jobs.drain_segments(spark, root, t, entries, f"{tmp_path}/cp").start()
    real = Segments.remove

    def stop(self, name):
        raise RuntimeError("stopped between write and removal")

    monkeypatch.setattr(Segments, "remove", stop)
    with pytest.raises(Exception, match="stopped"):
        run().awaitTermination()
    assert t.manifest().number == 2 and len(segments.done()) == 1
    monkeypatch.setattr(Segments, "remove", real)
    run().awaitTermination()
    assert t.manifest().number == 2 and segments.done() == [] and len(segments.all()) == 1
    store.submit(spark, root, "a.org/x\na.org/y")
    run().awaitTermination()
    assert t.manifest().number == 3
    assert {r["package"]: r["found_way"] for r in t.read().collect()} == {"a.org/known": "before", "a.org/x": "web", "a.org/y": "web"}


def test_newest_segment(spark):
    class Loaded:
        def __init__(self):
            self.spark, self.n, self.seen = spark, 0, threading.Event()

        def reload(self):
            self.n += 1
            self.seen.set()

    engine = Loaded()
    running = jobs.newest_segment(engine, 1).start()
    try:
        assert engine.seen.wait(60)
    finally:
        running.stop()


# --- saved responses


def test_saved_responses(spark, tmp_path):
    path = f"file://{tmp_path}/saved"
    rows = [("user", f"u{i}", 200, f'{{"id": {i}}}') for i in range(40)] + [("tree", "u1", 200, "{}"), ("tree", None, 404, None)]
    responses.save(spark.createDataFrame(rows, responses.SCHEMA), path, 8)
    responses.register(spark)
    read = lambda: spark.read.format("responses").option("buckets", 8).load(path)
    assert sorted(map(tuple, read().collect()), key=repr) == sorted(rows, key=repr)
    few = read().filter("kind = 'user' AND key IN ('u1', 'u2') AND body LIKE '%1%'")
    assert [tuple(r) for r in few.collect()] == [rows[1]]
    # only the asked partitions are read, each as a task
    assert few.rdd.getNumPartitions() <= 2 < read().rdd.getNumPartitions()
    assert read().filter("kind = 'none'").collect() == []
    asked = spark.createDataFrame([("user", "u3"), ("user", "gone"), ("tree", "u3")], "kind string, key string")
    assert {(r["kind"], r["key"]): r["status"] for r in responses.answered(asked, read()).collect()} == {("user", "u3"): 200, ("user", "gone"): 404, ("tree", "u3"): 404}


# --- counters


def test_counters_come_with_writing(spark):
    from lodestone.operators import merge
    from lodestone.sources import cache

    files = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5), ("d", 6), (None, 7)], "sha string, n int")
    held = spark.createDataFrame([("a", "A"), ("b", None), ("z", "Z")], "sha string, info string")
    asked = []

    def parse(rows):
        asked.append(rows)
        return rows.withColumn("info", F.when(F.col("sha") != "c", F.upper("sha")))

    passed = cache.through(files, held, parse)
    assert passed.counts == {"hit": 2, "missed": 4, "get_error": 1, "sign_saved": 2, "set_error": 2}
    assert {r["n"]: r["info"] for r in passed.rows.collect()} == {1: "A", 2: "A", 3: "B", 4: None, 5: "D", 6: "D", 7: None}
    assert {tuple(r) for r in passed.fresh.collect()} == {("b", "B"), ("d", "D")} and asked[0].count() == 4
    rows = spark.createDataFrame([("p", 1, "original"), ("p", 2, "update"), ("q", 1, "update"), ("r", 1, "original"), ("s", 1, "original"), ("s", 2, "delete")], "package string, last_updated int, action string")
    merged, counts = merge.observed(merge.merge(rows))
    merged.write.format("noop").mode("overwrite").save()
    assert counts.get == {"new": 1, "updated": 1, "unchanged": 1, "deleted": 1}


def test_blocks_have_the_places_of_their_range(spark):
    random.seed(4)
    docs = spark.createDataFrame([(1000 + i, i, float(500 - i)) for i in range(400)], "doc_id long, place long, prior double")
    held = {(t, i) for t, share in (("a", 1.0), ("b", 0.4), ("c", 0.02), ("d", 0.01)) for i in range(400) if random.random() < share}
    posts = spark.createDataFrame([("text", t, 1000 + i) for t, i in held] * 2, "field string, token string, doc_id long")
    for size in (32, 64, 128, 200):
        want = {}
        for t, i in held:
            want.setdefault((t, i // size), []).append(i)
        got = {(r["token"], r["range"]): r for r in blocks.of_postings(posts, docs, size).collect()}
        assert {k: r["places"] for k, r in got.items()} == {k: sorted(x) for k, x in want.items()}
        assert all((r["first"], r["last"], r["n"], r["best"]) == (min(want[k]), max(want[k]), len(want[k]), 500.0 - min(want[k])) for k, r in got.items())
    made = blocks.of_postings(posts, docs)
    assert {r["token"]: r["df"] for r in blocks.frequencies(made).collect()} == {t: sum(x == t for x, _ in held) for t in "abcd"}
