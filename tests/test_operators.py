"""Operators against small fixtures and brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, history, merge, repos, schedule, search, store, tops
from lodestone.operators.index import DOC
from lodestone.plans.engine import Engine
from lodestone.sources import snapshots
from lodestone.sources.snapshots import Segments, cached, canned, load, newest, save
from lodestone.sources.versions import Table
from lodestone.streaming import jobs

T0 = dt.datetime(2024, 1, 10)
DAY = dt.timedelta(days=1)


def test_effective_imports_against_the_fold(spark):
    random.seed(3)
    hosts = ["github.com/{a}/{p}", "github.com/{a}/{p}/x", "gopkg.in/{p}.v1", "{a}.org"]
    rows = [(random.choice(hosts).format(a=random.choice("abcde"), p=random.choice("pqrs")), f"github.com/a/{random.choice('pq')}") for _ in range(300)]
    rows = sorted(set(rows))
    from lodestone.functions import paths

    df = spark.createDataFrame(rows, "importer string, imported string")
    names = df.select("importer", "imported", paths.author(F.col("importer")).alias("a"), paths.project(F.col("importer")).alias("p"), paths.author(F.col("imported")).alias("oa"), paths.project(F.col("imported")).alias("op")).collect()
    want: dict = {}
    for pkg in {r["imported"] for r in names}:
        owners, projects, s = set(), set(), 0.0
        for r in sorted((r for r in names if r["imported"] == pkg), key=lambda r: r["importer"]):
            if r["a"] and r["a"] in owners:
                continue
            owners.add(r["a"])
            if r["p"] in projects:
                continue
            projects.add(r["p"])
            s += 0.5 if (r["a"] and r["a"] == r["oa"]) or r["p"] == r["op"] else 1.0
        want[pkg] = s
    assert {r["package"]: r["effective"] for r in graph.effective_imported(df).collect()} == want


def test_folding_against_the_walk(spark):
    random.seed(5)
    for _ in range(4):
        names = list({"h/" + "/".join(random.choice("ab") for _ in range(random.randint(1, 5))) for _ in range(25)})
        random.shuffle(names)
        hits = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "package string, rank int")
        got = {r["package"]: r["parent"] for r in search.folded(hits).collect()}
        shown, want = [], {}
        for n in names:
            ups = [s for s in shown if n.startswith(s + "/")]
            want[n] = max(ups, key=len, default=None)
            if want[n] is None:
                shown.append(n)
        assert got == want


def test_merge(spark):
    rows = [("a", "original", T0, 1), ("a", "update", T0 + DAY, 2), ("b", "original", T0, 1), ("b", "update", T0, 2), ("c", "update", T0, 3), ("d", "original", T0, 1), ("d", "delete", T0 - DAY, None), ("e", "original", T0, 1), ("e", "update", T0 - DAY, 9)]
    got = {r["package"]: (r["status"], r["stars"]) for r in merge.merge(spark.createDataFrame(rows, "package string, action string, last_updated timestamp, stars int"), "stars").collect()}
    assert got["a"] == ("updated", 2) and got["b"] == ("unchanged", 1) and got["c"] == ("new", 3) and got["d"][0] == "deleted" and got["e"] == ("unchanged", 1)


def test_queue_and_ages(spark):
    rows = [("github.com/a", "github.com", T0, 5), ("github.com/b", "github.com", T0 + 9 * DAY, 5), ("github.com/c", "github.com", T0 + 9 * DAY, 4), ("github.com/vendor/x", "github.com", T0, 5), ("x.org/a", "x.org", T0, 5)]
    entries = spark.createDataFrame(rows, "id string, host string, schedule_time timestamp, version int").withColumn("etag", F.lit("e"))
    q = schedule.queue(entries, spark.createDataFrame([("github.com/a",)], "package string"), F.lit(T0 + DAY), ["github.com"])
    got = {r["id"]: (r["in_docs"], r["etag"]) for r in q.collect()}
    assert got == {"github.com/a": (True, "e"), "github.com/c": (False, "")}
    s = schedule.age_statistics(q, F.lit(T0 + DAY)).first()
    assert s["max_age"] == 24.0 and s["max_id"] == "github.com/a" and s["n"] == 2 and s["n_new"] == 1


def test_history(spark):
    rows = [(1, T0, 0, "None"), (1, T0 + DAY, 1, "Success"), (1, T0 + 2 * DAY, 2, "Failed")]
    events = spark.createDataFrame(rows, "key long, ts timestamp, event_id long, action string")
    s = history.summary(events).first()
    assert (s["found_time"], s["events"], s["latest_success"], s["latest_failed"]) == (T0, 2, T0 + DAY, T0 + 2 * DAY)
    assert [e["action"] for e in history.lists(events).first()["events"]] == ["Failed", "Success"]
    old = spark.createDataFrame([("k", None, None)], "key string, found_time timestamp, found_way string")
    r = history.fill_found(old, spark.createDataFrame([("k", T0)], "id string, schedule_time timestamp")).first()
    assert (r["found_time"], r["found_way"]) == (T0 - 10 * DAY, "unknown")


def test_repositories(spark):
    rows = [("a", "x", T0 - 3 * DAY), ("b", "y", None), ("c", "z", T0 - 40 * DAY), ("d", "w", T0 - 4 * DAY)]
    got = repos.most_overdue(spark.createDataFrame(rows, "user string, name string, crawl_time timestamp"), 2).collect()
    assert [r["name"] for r in got] == ["y", "z"]
    cases = [
        (None, T0, T0, "OutOfDate"), (T0 - 6 * DAY, T0 - DAY, T0 - 3 * DAY, "OutOfDate"), (T0 - 6 * DAY, T0 - DAY, T0 - 8 * DAY, "UpToDate"),
        (T0 - 3 * DAY, T0 - 20 * DAY, T0, "UpToDate"), (T0 - 8 * DAY, T0 - 20 * DAY, T0 - 30 * DAY, "OutOfDate"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "k int, c timestamp, i timestamp, u timestamp")
    assert [r["s"] for r in df.select("k", repos.status(F.col("c"), F.col("i"), F.col("u"), F.lit(T0)).alias("s")).orderBy("k").collect()] == [c[3] for c in cases]
    files = [("m.go", "ParseSuccess", "p", "top", ["x.org/y", "a.org/b"], False), ("m_test.go", "ParseSuccess", "p", "", ["t.org/t"], True), ("low/n.go", "ParseSuccess", "q", "", [], False), ("low/i.go", "ShouldIgnore", "z", "", ["no.org"], False), ("two/a.go", "ParseSuccess", "r", "", [], False), ("two/b.go", "ParseSuccess", "s", "", [], False)]
    found = {r["folder"]: (r["name"], r["imports"], r["test_imports"], r["error"]) for r in repos.folders(spark.createDataFrame(files, "path string, status string, name string, description string, imports array<string>, is_test boolean")).collect()}
    assert found == {"": ("p", ["a.org/b", "x.org/y"], ["t.org/t"], None), "/low": ("q", [], [], None), "/two": (None, [], [], "conflicting names")}


def test_segments(spark, tmp_path):
    s = Segments(spark, f"file://{tmp_path}/seg")
    assert s.max_done() is None and s.new() == "0" and s.new() == "1" and s.new_max() == "2"
    s.finish("0")
    assert s.max_done() == "0"
    s.finish("2")
    assert s.max_done() == "2"
    s.clear_undone()
    assert s.all() == ["0", "2"]
    s.clear_outdated()
    assert s.all() == ["2"]
    s._make("abc")
    assert s.new_max() == "3"
    assert newest(spark.createDataFrame([("9",), ("10",), ("x",)], "name string")).first()["name"] == "10"


def test_tables_recover(spark, tmp_path):
    path, df = f"file://{tmp_path}/t", spark.createDataFrame([(1,)], "a int")
    assert load(spark, path, df.schema).count() == 0
    df.write.parquet(path + ".new")
    assert load(spark, path, df.schema).count() == 1
    save(load(spark, path, df.schema).unionByName(df), path)
    assert load(spark, path, df.schema).count() == 2


def test_canned_and_cache(spark):
    got = canned(spark.createDataFrame([("u",), ("w",)], "uri string"), spark.createDataFrame([("u", "b")], "uri string, body string"))
    assert {r["uri"]: r["status"] for r in got.collect()} == {"u": 200, "w": 404}
    files = spark.createDataFrame([("f", "s1"), ("g", "s2"), ("h", "s2")], "path string, sha string")
    out, fresh = cached(files, spark.createDataFrame([("s1", "known")], "sha string, info string"), lambda d: d.withColumn("info", F.concat(F.lit("new "), F.col("sha"))))
    assert {r["path"]: r["info"] for r in out.collect()} == {"f": "known", "g": "new s2", "h": "new s2"} and fresh.count() == 1


POND, REEDS, LILY, FROG = "github.com/mo/pond", "github.com/mo/pond/reeds", "github.com/mo/lily", "github.com/kim/frog"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    doc = lambda name, pkg, imports, tests, text="": (name, pkg, None, T0, 0, "", text, "https://" + pkg, "README.md", "# About\n\nReads needles.", imports, tests, None)
    docs = [doc("pond", POND, [LILY, POND], None), doc("main", REEDS, [POND, LILY], [LILY]), doc("lily", LILY, None, []), doc("frog", FROG, [LILY], [POND, FROG], " ")]
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('idx')}/index")
    assert e.search("x").count() == 0 and e.total() == 0
    e.index(spark.createDataFrame(docs, DOC), F.lit(T0))
    return e


def test_index(engine):
    rows = {r["package"]: r for r in engine.hits_full.collect()}
    assert {(r["package"], r["importer"], r["test"]) for r in engine.importers.collect()} == {(LILY, POND, False), (LILY, REEDS, False), (LILY, FROG, False), (POND, REEDS, False), (POND, FROG, True)}
    assert [r["package"] for r in engine.packages().collect()] == [LILY, POND, FROG, REEDS]
    assert {k: (r["imported_len"], r["test_imported_len"]) for k, r in rows.items()} == {LILY: (3, 0), POND: (1, 1), FROG: (0, 0), REEDS: (0, 0)}
    assert rows[POND]["imports"] == [LILY] and rows[REEDS]["test_imports"] == [] and rows[FROG]["test_imports"] == [POND]
    # lily: 1 for frog's owner, half for its own, who also wrote pond; pond: half for its own program
    assert {k: (round(r["static_score"], 6), r["static_rank"]) for k, r in rows.items()} == {LILY: (2.6, 0), POND: (1.6, 1), FROG: (1.1, 2), REEDS: (1.0, 3)}
    assert "imported" not in engine.hits.columns


def test_search_and_api(engine):
    assert {r["package"] for r in engine.search("needles pond").collect()} == {POND, REEDS}
    assert engine.search("").count() == 4
    page = engine.results("needles")
    assert page["total"] == 4 and page["folded"] == 1 and {d["package"]: d["subs"] for d in page["docs"]} == {LILY: [], POND: [REEDS], FROG: []}
    code, body = engine.api("package", id=POND)
    got = json.loads(body)
    assert code == 200 and got["StaticRank"] == 2 and got["Imports"] == [LILY] and got["Imported"] == [REEDS] and got["TestImported"] == [FROG]
    assert engine.api("package", id="none") == (404, '"Package none not found!"') and engine.api("what")[0] == 400
    assert engine.api("packages", callback="c-b")[1] == 'cb(200, ["' + '","'.join([LILY, POND, FROG, REEDS]) + '"]);'
    found = json.loads(engine.api("search", q=" needles ")[1])
    assert found["query"] == "needles" and [h["package"] for h in found["hits"]] == [LILY, POND, FROG, REEDS]
    assert list(found["hits"][0]) == ["name", "package", "author", "synopsis", "description", "projecturl"]
    lists = {x["Name"]: x for x in json.loads(engine.api("tops")[1])}
    assert [i["Package"] for i in lists["Hot"]["Items"]] == [LILY, POND] and lists["Hot"]["Items"][0]["Info"] == "3 0"
    assert lists["Sites"]["Items"] == [{"Index": 1, "Name": "github.com", "Package": "", "Link": "http://github.com", "Info": "4"}]
    assert [d["Package"] for d in json.loads(engine.api("package_depends")[1])] == [LILY, POND, FROG, REEDS]
    assert engine.view(POND).first()["show_readme"] is True
    assert "rank 2" in engine.badge(POND).first()["svg"]
    assert engine.depends(LILY).first()["imported"] == [FROG, POND, REEDS]
    assert engine.totals().first()["packages"] == 4


@pytest.mark.parametrize("action,params", [("package", {"id": POND}), ("packages", {"callback": "f"}), ("package_depends", {}), ("search", {"q": "needles"}), ("tops", {}), ("what", {})])
def test_answer_is_the_api_as_a_row(engine, action, params):
    assert tuple(engine.answer(action, **params).first()) == engine.api(action, **params)


def test_hot_list_against_the_walk(spark):
    random.seed(8)
    for _ in range(3):
        names = list({"h/" + "/".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(30)})
        rows = [(n, "x", float(random.randint(1, 5)), random.randint(0, 3)) for n in names]
        got = [r["package"] for r in tops.hot(spark.createDataFrame(rows, "package string, name string, s double, i int"), "s", 12, "i", F.col("package")).collect()]
        taken: list = []
        for n, _, _, i in sorted(rows, key=lambda r: (-r[2], r[0])):
            if i and len(taken) < 12 and not any(n == t or n.startswith(t + "/") for t in taken):
                taken.append(n)
        assert got == taken


def test_ranks_of_equal_scores_across_ranges(spark):
    random.seed(9)
    rows = [(f"p{i:04d}", float(random.choice([1, 1, 1, 1, 2, 3]))) for i in range(500)]
    got = {r["package"]: (r["doc_id"], r["static_rank"]) for r in graph.ranked(spark.createDataFrame(rows, "package string, static_score double")).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    first: dict = {}
    for i, (p, s) in enumerate(order):
        first.setdefault(s, i)
        assert got[p] == (i, first[s])


def test_store_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    schema = "id string, schedule_time timestamp, version int, etag string"
    from pyspark.sql.types import StructType

    tables = store.CrawlTables(spark, f"{root}/db", StructType.fromDDL(schema))
    assert tables.sync() == []
    tables.put("package", spark.createDataFrame([("a.org/x", T0, 5, "e")], schema))
    assert tables.sync() == ["package"] and tables.sync() == []
    again = store.CrawlTables(spark, f"{root}/db", StructType.fromDDL(schema))
    assert again.tables["package"].count() == 1 and again.tables["person"].count() == 0
    store.snapshot(again.tables, f"{root}/snap")
    assert store.restore(spark, f"{root}/snap", {"package": StructType.fromDDL(schema)})["package"].first()["etag"] == "e"
    with pytest.raises(FileNotFoundError):
        store.restore(spark, f"{root}/none", {})


def test_submitted_packages_become_entries(spark, tmp_path):
    root = f"file://{tmp_path}/import"
    assert store.submit(spark, root, "no path\nfmt") == (0, "no path\nfmt")
    assert store.submit(spark, root, " a.org/new \nfmt\nb.org/old") == (2, "")
    entries = spark.createDataFrame([("b.org/old", T0 - DAY)], "id string, schedule_time timestamp")
    got: list = []
    n = store.drain(spark, root, entries, spark.createDataFrame([], "package string"), F.lit(T0), lambda df: got.extend(df.collect()))
    assert n == 1 and [(r["id"], r["found_way"]) for r in got] == [("a.org/new", "web")] and Segments(spark, root).all() == []


def test_outcomes_against_the_walk(spark):
    random.seed(4)
    rows = [(random.randint(0, 2), i, T0 + i * dt.timedelta(seconds=1), f"p{i}", random.choice(["failed"] * 8 + ["ok", "same", "invalid"]), random.random() < 0.03) for i in range(400)]
    stop = T0 + dt.timedelta(seconds=350)
    got = {r["seq"]: r["pauses"] for r in schedule.outcomes(spark.createDataFrame(rows, "part int, seq int, at timestamp, package string, outcome string, forbidden boolean"), F.lit(stop)).collect()}
    want, fails = {}, {}
    for part, seq, at, _, outcome, forbidden in rows:
        if at > stop:
            continue
        n = fails.get(part, 0) + (outcome == "failed")
        want[seq] = outcome == "failed" and (forbidden or n >= 10)
        fails[part] = 0 if outcome in ("ok", "same") or want[seq] else n
    assert got == want and sum(want.values()) > 3


def test_shared_folder_is_not_local_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="checkpoint"):
        snapshots.shared_dir(Session)


def test_streams(spark, tmp_path):
    path = f"{tmp_path}/events"
    spark.createDataFrame([(1, T0, "Success"), (1, T0 + DAY, "Failed"), (2, T0, "None")], jobs.EVENTS).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(jobs.EVENTS).parquet(path)
    q = jobs.history(stream).writeStream.outputMode("update").format("memory").queryName("hist").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {r["key"]: (r["events"], r["last_action"]) for r in spark.table("hist").collect()}
    assert rows == {1: (2, "Failed"), 2: (0, None)}
    schema = "package string, last_updated timestamp, stars int"
    acts = f"{tmp_path}/acts"
    spark.createDataFrame([("a", T0, 1, "update"), ("b", T0, 1, "update")], schema + ", action string").coalesce(1).write.parquet(acts)
    from pyspark.sql.types import StructType

    own = StructType.fromDDL(schema)
    stored = Table(spark, f"file://{tmp_path}/docs", own, "package", 4)
    jobs.merge_actions(spark.readStream.schema(schema + ", action string").parquet(acts), stored, f"{tmp_path}/cp2").start().awaitTermination(120)
    assert stored.read().count() == 2


def test_history_stream_ends_with_its_input(spark, tmp_path):
    # no timers, no batches without data; the second file finds the state of the first; of equal times the event that came last counts
    path = f"{tmp_path}/events"
    first = [(1, T0 + DAY * 20, "Failed"), (1, T0 - DAY, "Invalid")]
    spark.createDataFrame(first, jobs.EVENTS).coalesce(1).write.parquet(path)
    rows = [(1, T0 + DAY * i, "Success") for i in range(12)] + [(1, T0 + DAY * 11, "Failed"), (1, None, "Success"), (2, T0, None)]
    spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    q = jobs.history(stream).writeStream.outputMode("update").format("memory").queryName("ended").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert jobs.until(q, 120)
    found = [tuple(r) for r in spark.table("ended").collect()]
    assert (1, T0 - DAY, T0 + DAY * 11, T0 + DAY * 20, 10, "Failed") in found and (2, T0, None, None, 0, None) in found
    assert len(found) == 3


def test_metrics_are_flushed_until_the_deadline(spark, tmp_path):
    spark.createDataFrame([("a", "sum", 1.0), ("a", "sum", 2.0), ("b", "max", 5.0), ("b", "max", 4.0)], "name string, method string, value double").write.json(str(tmp_path / "in"))
    metrics = spark.readStream.schema("name string, method string, value double").json(str(tmp_path / "in"))
    running = jobs.flush_metrics(metrics, str(tmp_path / "out"), str(tmp_path / "c"), 1).start()
    try:
        running.processAllAvailable()
        assert not jobs.until(running, 0.1) and not running.isActive
    finally:
        running.stop()
    assert {(r["name"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 3.0), ("b", 5.0)}


def test_rounds_of_stages():
    log, left = [], iter([True, True, False])
    assert jobs.rounds([lambda: log.append("crawl"), lambda: log.append("index")], lambda: next(left)) == 2
    assert log == ["crawl", "index"] * 2


def test_scores_that_differ_by_summation_are_ranked_alike(spark, monkeypatch):
    from lodestone.operators import index

    plain = graph.static_scores
    noisy = lambda *a: plain(*a).withColumn("static_score", F.col("static_score") + F.when(F.col("package") == "x.org/b", 1e-9).otherwise(0.0))
    monkeypatch.setattr(graph, "static_scores", noisy)
    docs = spark.createDataFrame([("n", p, None, T0, 0, "", "", "", "", "", [], [], []) for p in ("x.org/b", "x.org/a")], index.DOC)
    hits = {r["package"]: (r["doc_id"], r["static_rank"]) for r in index.build(docs, F.lit(T0))["hits"].collect()}
    assert hits == {"x.org/a": (0, 0), "x.org/b": (1, 0)}


def test_scores_by_project_are_those_of_the_edges(spark):
    random.seed(11)
    hosts = ["github.com/{a}/{p}", "github.com/{a}/{p}/x", "gopkg.in/{p}.v1", "{a}.org", "/{p}"]
    name = lambda: random.choice(hosts).format(a=random.choice("abc"), p=random.choice("pqr"))
    edges = spark.createDataFrame(sorted({(name(), name(), random.random() < 0.5) for _ in range(400)}), "importer string, imported string, test boolean")
    kinds = graph.edge_kinds(edges)
    own = graph.as_importers(kinds.select(F.col("importer").alias("package")).distinct()).withColumnRenamed("package", "importer")
    folded = graph.by_project(kinds.join(own, "importer")).cache()
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert rows(graph.counts_of(folded)) == rows(graph.import_counts(kinds))
    assert rows(graph.effective_of(folded)) == rows(graph.effective_imported(kinds.filter("NOT test")))
    assert rows(graph.effective_of(folded.filter("used = 0"), "first_test")) == rows(graph.effective_imported(graph.real_tests(kinds)))


def test_parts_grow_with_the_rows(spark):
    assert graph.parts(spark, 10) == 4 and graph.parts(spark, 3_000_001) == 11
