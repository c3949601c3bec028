import datetime as dt

from pyspark.sql import functions as F

from lodestone.functions import tokens
from lodestone.functions.register import register
from lodestone.operators import history, packages, repos, schedule

T0 = dt.datetime(2024, 1, 10)


def test_projection(spark):
    rows = [("n", "github.com/u/r", 3, "", "", None, "README.md", "First. Second", [" a.org/b ", "fmt"], ["c.org/d"], ["F"], ["e.org/f"])]
    df = spark.createDataFrame(rows, "name string, package string, star_count int, synopsis string, doc string, project_url string, readme_fn string, readme_data string, imports array<string>, test_imports array<string>, exported array<string>, references array<string>")
    r = packages.to_doc(df, F.lit(T0)).first()
    assert (r["author"], r["imports"], r["synopsis"], r["last_updated"]) == ("u", ["a.org/b"], "First.", T0)
    assert packages.to_record(df, F.lit(T0)).first()["site"] == "github.com"
    t = packages.tidy_imports(spark.createDataFrame([("p", ["p", "q"], ["q", "r", "p"], ["s"])], "package string, imports array<string>, test_imports array<string>, x_test_imports array<string>")).first()
    assert (t["imports"], t["test_imports"]) == (["q"], ["r", "s"])


def test_bytes_and_targets(spark):
    r = spark.createDataFrame([("éé", "a/vendor/b")], "t string, p string").select(packages.cut_bytes(F.col("t"), 3), packages.bad_target(F.col("p"))).first()
    assert tuple(r) == ("é", True)


def test_touch_and_persons(spark):
    feed = spark.createDataFrame([("a.org/x", T0), ("b.org/y", T0), ("bad", T0)], "package string, updated_at timestamp")
    docs = spark.createDataFrame([("a.org/x", T0 + dt.timedelta(days=1))], "package string, last_updated timestamp")
    assert [r["package"] for r in packages.touch(feed, docs).collect()] == ["b.org/y"]
    persons = spark.createDataFrame([("s:a", T0)], "id string, schedule_time timestamp")
    assert packages.append_persons(persons, spark.createDataFrame([("s", "a"), ("s", "b")], "site string, name string"), F.lit(T0)).count() == 2
    feed = spark.createDataFrame([("", "l", "p", T0), (None, None, "p", T0), ("n", "l", "", T0)], "owner_name string, owner_login string, path string, updated_at timestamp")
    assert [r["user"] for r in repos.touched(feed).collect()] == ["l"]


def test_actions_and_folders(spark):
    rows = spark.createDataFrame([("a.org/x", "ok"), ("a.org/vendor/x", "ok"), ("b.org", "invalid"), ("c.org", "failed")], "package string, outcome string")
    dead = spark.createDataFrame([("thezombie.net/x", "ok"), ("launchpad.net/x", "ok")], "package string, outcome string")
    assert {r["package"]: r["action"] for r in packages.actions(dead, F.lit(T0)).collect()} == {"thezombie.net/x": "delete", "launchpad.net/x": "update"}
    assert {r["package"]: r["action"] for r in packages.actions(rows, F.lit(T0)).collect()} == {"a.org/x": "update", "a.org/vendor/x": "delete", "b.org": "delete"}
    subs = spark.createDataFrame([("a.org/x", ["go", "js", "net"])], "package string, folders array<string>")
    got = history.from_folders(subs, spark.createDataFrame([("a.org/x/net",)], "key string"), repos.like_source_folder).collect()
    assert [(r["package"], r["found_way"]) for r in got] == [("a.org/x/go", "parent:a.org/x")]


def test_schedule_times(spark):
    r = spark.range(500).select(schedule.next_crawl(F.lit(T0), 60, F.col("id")).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert T0 + dt.timedelta(days=54) <= r[0] < r[1] <= T0 + dt.timedelta(days=66)
    entries = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("e").alias("etag"))
    assert 120 < schedule.forget_etags(entries).filter("etag = ''").count() < 280


def test_token_index_and_sql(spark):
    by_id, by_token = packages.token_index(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, "a")], "id int, t string"), "id", "t")
    assert {r["id"]: r["tokens"] for r in by_id.collect()} == {1: ["a", "b"], 2: ["a"]} and sorted(r["id"] for r in packages.ids_of(by_token, "a").collect()) == [1, 2]
    # a UDF that has run holds handles of the session; registering must not carry them along
    assert spark.createDataFrame([("ponies",)], "w string").select(tokens.stem("w")).first()[0] == "poni"
    register(spark)
    assert spark.sql("SELECT stem('ponies') AS s").first()["s"] == "poni"
    assert {r["token"] for r in spark.sql("SELECT * FROM tokenize('Hello world')").collect()} == {"hello", "world"}


def test_related_only_of_hosts_with_persons(spark):
    rows = [("github.com/mo/x", "mo", ["a.org/b"], [], ["r.org/r"]), ("example.org/y", "e", ["c.org/d"], [], [])]
    df = spark.createDataFrame(rows, "package string, author string, imports array<string>, test_imports array<string>, references array<string>")
    assert {(r["package"], r["found_way"]) for r in history.related(df).collect()} == {("a.org/b", "impoted:github.com/mo/x"), ("r.org/r", "reference:github.com/mo/x")}
    assert [r["id"] for r in history.related_persons(df).collect()] == ["github.com:mo"]
