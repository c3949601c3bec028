"""Further registered queries: crawled records, feeds, times, pages, and tables written and read back.

As in ``catalog``: both sides of a query compute the same from the raw tables.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scores, tokens, zeros
from ..operators import graph, history, index, packages, repos, schedule, search, store
from ..sources import snapshots
from ..sources import views as v
from ..sources.views import CRAWL_SQL, PACKAGES_SQL, table
from .catalog import NOW, NOW_SQL, QUEUE_SQL, REPO_SQL, SCORE_SQL, STORE_SQL, queued, query, repo_rows, static, stored



def joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def written(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{snapshots.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def day(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


DAY_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S')"

# --- crawled packages -----------------------------------------------------------------------------------------------


def crawled(spark, sf_dir) -> DataFrame:
    """A crawled package for each entry: some without stars, a synopsis or a documentation text; imports of which some can't be remote."""
    e = v.crawl_entries(spark, sf_dir)
    return e.select(
        joined("n", F.col("k")).alias("name"), F.col("id").alias("package"), F.when(F.col("k") % 5 != 0, F.col("k").cast("int")).alias("star_count"), F.when(F.col("k") % 3 == 0, joined("syn ", F.col("k"))).alias("synopsis"),
        F.when(F.col("k") % 2 == 0, joined("doc ", F.col("k"))).alias("doc"), joined("http://", F.col("id")).alias("project_url"), F.lit("README.md").alias("readme_fn"), joined("About ", F.col("k"), ". More of it.").alias("readme_data"),
        F.array(joined(" imp.org/", F.col("k"), " "), F.lit("fmt"), joined("x.org/", F.col("k") % 10)).alias("imports"), F.when(F.col("k") % 7 != 0, F.array(joined("t.org//", F.col("k")), joined("t.org/", F.col("k")))).alias("test_imports"),
        F.array(joined("F", F.col("k") % 3)).alias("exported"), F.array(joined("r.org/", F.col("k") % 4)).alias("references"),
    )


CRAWLED_SQL = f"""crawled AS (SELECT 'n' || k AS name, id AS package, CASE WHEN host = 'example.org' THEN host ELSE split_part(id, '/', 2) END AS author, CASE WHEN k % 5 = 0 THEN 0 ELSE k END AS star_count,
  CASE WHEN k % 3 = 0 THEN 'syn ' || k WHEN k % 2 = 0 THEN '' ELSE 'About ' || k || '.' END AS synopsis, CASE WHEN k % 2 = 0 THEN 'doc ' || k ELSE '' END AS description,
  'imp.org/' || k || ',x.org/' || k % 10 AS imports, CASE WHEN k % 7 = 0 THEN '' ELSE 't.org/' || k END AS test_imports, host AS site, substr(id, length(host) + 2) AS path, 'r.org/' || k % 4 AS refs FROM crawl)"""


@query(f"WITH {CRAWL_SQL}, {CRAWLED_SQL} SELECT package, author, star_count, synopsis, description, imports, test_imports FROM crawled")
def crawled_docs(spark, sf_dir):
    out = packages.to_doc(crawled(spark, sf_dir), F.lit(NOW))
    return out.select("package", "author", F.col("star_count").cast("long").alias("star_count"), "synopsis", "description", *[F.array_join(c, ",").alias(c) for c in ("imports", "test_imports")])


@query(f"WITH {CRAWL_SQL}, {CRAWLED_SQL} SELECT site, path, name, author, refs FROM crawled")
def crawled_records(spark, sf_dir):
    return packages.to_record(crawled(spark, sf_dir), F.lit(NOW)).select("site", "path", "name", "author", F.array_join("references", ",").alias("refs"))


@query(f"WITH {CRAWL_SQL} SELECT k, contains(id, '/vendor/') OR k % 13 = 0 AS bad FROM crawl")
def bad_target(spark, sf_dir):
    """Every thirteenth package is put on the dead host."""
    entries = v.crawl_entries(spark, sf_dir)
    dead = F.concat(F.lit(packages.DEAD_HOSTS[0]), F.lit("/"), F.col("k"))
    return entries.select("k", packages.bad_target(F.when(F.col("k") % 13 == 0, dead).otherwise(F.col("id"))).alias("bad"))


@query(f"WITH {CRAWL_SQL} SELECT id AS package, CASE WHEN contains(id, '/vendor/') OR k % 4 = 1 THEN 'delete' ELSE 'update' END AS action FROM crawl WHERE contains(id, '/vendor/') OR k % 4 IN (0, 1)")
def crawl_actions(spark, sf_dir):
    rows = v.crawl_entries(spark, sf_dir).select(F.col("id").alias("package"), F.when(F.col("k") % 4 == 0, "ok").when(F.col("k") % 4 == 1, "invalid").when(F.col("k") % 4 == 2, "failed").otherwise("same").alias("outcome"))
    return packages.actions(rows, F.lit(NOW)).select("package", "action")


@query("SELECT p_partkey, list_sort(list_distinct(['F' || p_partkey % 3, 'G' || p_partkey % 5, 'F' || p_partkey % 5, 'T' || p_size]))::VARCHAR AS names FROM part")
def exported_symbols(spark, sf_dir):
    p = F.col("p_partkey")
    names = packages.exported(F.array(joined("F", p % 3), joined("G", p % 5)), F.array(joined("F", p % 5), joined("T", F.col("p_size"))))
    return table(spark, sf_dir, "part").select("p_partkey", joined("[", F.array_join(F.array_sort(names), ", "), "]").alias("names"))


CUT = 300


@query(f"""SELECT doc_id, octet_length(encode(c)) AS bytes, md5(c) AS digest FROM (SELECT doc_id, CASE WHEN octet_length(encode(text)) <= {CUT} THEN text
  ELSE left(text, list_max(list_filter(range({CUT // 4}, {CUT + 1}), lambda n: octet_length(encode(left(text, n))) <= {CUT}))) END AS c FROM documents WHERE text IS NOT NULL)""")
def readme_cut(spark, sf_dir):
    """The first 300 bytes of each text, without a torn character; the engine cuts at 100 and 20 KiB."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", packages.cut_bytes(F.col("text"), CUT).alias("c")).select("doc_id", F.octet_length("c").cast("long").alias("bytes"), F.md5("c").alias("digest"))


# --- feeds, parents, persons ----------------------------------------------------------------------------------------

FEED_SQL = """feed AS (SELECT k, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'n' || cust END AS owner_name, CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'u' || cust END AS owner_login,
  CASE WHEN k % 11 = 0 THEN '' ELSE 'r' || k END AS path, CASE WHEN k % 17 = 0 THEN NULL ELSE made END AS updated_at FROM (SELECT o_orderkey AS k, o_custkey AS cust, o_orderdate AS made FROM orders)),
users AS (SELECT *, coalesce(nullif(owner_name, ''), owner_login, '') AS usr, (owner_name IS NULL AND owner_login IS NULL) OR updated_at IS NULL AS none FROM feed)"""


def feed(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("at"))
    name = F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 4 != 1, joined("n", F.col("cust")))
    login = F.when(F.col("k") % 8 == 0, "").when(F.col("k") % 8 != 1, joined("u", F.col("cust")))
    return rows.select("k", name.alias("owner_name"), login.alias("owner_login"), F.when(F.col("k") % 11 == 0, "").otherwise(joined("r", F.col("k"))).alias("path"), F.when(F.col("k") % 17 != 0, F.col("at")).alias("updated_at"))


@query(f"WITH {FEED_SQL} SELECT count(*) AS total, count(*) FILTER (none) AS no_owner_or_time, count(*) FILTER (NOT none AND (usr = '' OR path = '')) AS no_user_or_path FROM users")
def feed_skips(spark, sf_dir):
    return repos.feed_skips(feed(spark, sf_dir))


@query(f"WITH {FEED_SQL} SELECT 'github.com/' || usr || '/' || path AS package FROM users WHERE NOT none AND usr <> '' AND path <> '' AND NOT (k % 3 = 0 AND k % 2 = 0)")
def feed_touch(spark, sf_dir):
    """Packages of a search feed to crawl now; every third has a document, every second of these a newer one."""
    rows = feed(spark, sf_dir)
    found = repos.touched(rows).select(F.concat_ws("/", F.lit("github.com"), "user", "path").alias("package"), "updated_at")
    user = F.coalesce(F.nullif("owner_name", F.lit("")), "owner_login")
    known = rows.filter("k % 3 = 0 AND updated_at IS NOT NULL").select(F.concat_ws("/", F.lit("github.com"), user, "path").alias("package"), (F.col("updated_at") + F.when(F.col("k") % 2 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))).alias("last_updated"))
    return packages.touch(found, known).select("package")


@query(f"WITH {CRAWL_SQL} SELECT id || '/' || f AS package, 'parent:' || id AS found_way FROM (SELECT id, k, unnest(['core', 'images', 'v' || k % 3]) AS f FROM crawl) WHERE f <> 'images' AND NOT (k % 4 = 0 AND f = 'core')")
def parent_packages(spark, sf_dir):
    entries = v.crawl_entries(spark, sf_dir)
    rows = entries.select(F.col("id").alias("package"), F.array(F.lit("core"), F.lit("images"), joined("v", F.col("k") % 3)).alias("folders"))
    return history.from_folders(rows, entries.filter("k % 4 = 0").select(joined(F.col("id"), "/core").alias("key")), repos.like_source_folder)


@query(f"WITH {CRAWL_SQL} SELECT DISTINCT host || ':u' || k % 50 AS id, CASE WHEN k % 50 < 25 THEN 'old' ELSE 'new' END AS state FROM crawl")
def append_persons(spark, sf_dir):
    found = v.crawl_entries(spark, sf_dir).select(F.col("host").alias("site"), joined("u", F.col("k") % 50).alias("name"), (F.col("k") % 50 < 25).alias("old"))
    before = found.filter("old").select(paths.person_id(F.col("site"), F.col("name")).alias("id"), F.lit(dt.datetime(1990, 1, 1)).alias("schedule_time")).distinct()
    out = packages.append_persons(before, found, F.lit(NOW))
    return out.select("id", F.when(F.col("schedule_time") == F.lit(NOW), "new").otherwise("old").alias("state"))


@query(f"WITH {CRAWL_SQL} SELECT id, coalesce(stars, 0) AS stars, coalesce(name, '') AS name FROM crawl LEFT JOIN (SELECT o_orderkey AS j, o_custkey AS stars, 'r' || o_orderkey AS name FROM orders WHERE o_orderkey % 3 = 0) ON j = k")
def record_lookup(spark, sf_dir):
    """Records by key; missing ones read as empty ones."""
    there = stored(spark, sf_dir).filter("k % 3 = 0").select("k", F.struct("stars", "name").alias("record"))
    empty = F.struct(F.lit(0).cast("long").alias("stars"), F.lit("").alias("name"))
    out = v.crawl_entries(spark, sf_dir).join(there, "k", "left").select("id", history.or_empty(F.col("record"), empty).alias("r"))
    return out.select("id", "r.stars", "r.name")


# --- times ----------------------------------------------------------------------------------------------------------

DEALT_SQL = "CAST('0x' || substr(md5({} || ':0'), 1, 8) AS BIGINT)"


@query(f"WITH {CRAWL_SQL} SELECT id, " + ", ".join(
    DAY_SQL.format(f"{NOW_SQL} + to_seconds(CAST(floor({days * 86400} * (9e-1 + 2e-1 * ({DEALT_SQL.format('id')} % 1000001 / 1e6))) AS BIGINT))") + f" AS {name}" for days, name in ((60, "package"), (100, "person"))) + " FROM crawl")
def next_crawls(spark, sf_dir):
    """When a package and a person are read again: 60 and 100 days from now, a tenth more or less."""
    at = lambda days: day(schedule.next_crawl(F.lit(NOW), days, F.col("id")))
    return v.crawl_entries(spark, sf_dir).select("id", at(60).alias("package"), at(100).alias("person"))


@query(f"WITH {CRAWL_SQL} SELECT id, {DAY_SQL.format('schedule_time + INTERVAL 10 DAY')} AS package, {DAY_SQL.format('schedule_time + INTERVAL 12 HOUR')} AS person FROM crawl")
def failure_backoff(spark, sf_dir):
    at = F.col("schedule_time").cast("timestamp")
    return v.crawl_entries(spark, sf_dir).select("id", day(schedule.after_failure(at, False)).alias("package"), day(schedule.after_failure(at, True)).alias("person"))


@query(f"WITH {CRAWL_SQL} SELECT id, CASE WHEN version < 5 OR {DEALT_SQL.format('id')} % 10 = 0 THEN '' ELSE 'e' || k END AS etag FROM crawl")
def etag_reset(spark, sf_dir):
    """Etags of older entries don't count, and every tenth one is forgotten."""
    entries = v.crawl_entries(spark, sf_dir).withColumn("etag", joined("e", F.col("k")))
    return schedule.forget_etags(schedule.current_etags(entries)).select("id", "etag")


AGE_NOW = dt.datetime(1997, 3, 1)


@query(f"SELECT k, date_diff('second', crawl_time, TIMESTAMP '1997-03-01') AS age, coalesce(date_diff('second', crawl_time, TIMESTAMP '1997-03-01') < 172800, false) AS holds FROM {REPO_SQL}")
def repo_age(spark, sf_dir):
    """Age of repository records, and whether they may be used again."""
    return repo_rows(spark, sf_dir).select("k", *[f(F.col("crawl_time"), F.lit(AGE_NOW)).alias(n) for f, n in ((repos.info_age, "age"), (repos.info_holds, "holds"))])


@query("SELECT o_orderkey AS k, CASE WHEN t > TIMESTAMP '2016-01-25' THEN 0.01 WHEN t > TIMESTAMP '2015-08-24' THEN 0.1 ELSE 0.25 END::DOUBLE AS factor FROM (SELECT o_orderkey, o_orderdate + INTERVAL 18 YEAR AS t FROM orders)")
def legacy_factor(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), scores.legacy_factor((F.col("o_orderdate") + F.expr("INTERVAL 18 YEARS")).cast("timestamp")).alias("factor"))


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN 1e-1 ELSE 1e0 END / sqrt(p_size), 9) AS by_project, round(CASE WHEN p_partkey % 3 = 0 THEN 5e-1 ELSE 1e0 END / sqrt(p_size), 9) AS by_author FROM part")
def shared_weights(spark, sf_dir):
    n, p = F.col("p_size"), F.col("p_partkey")
    weight = lambda same, factor, name: F.round(scores.shared_weight(n, same, factor), 9).alias(name)
    return table(spark, sf_dir, "part").select("p_partkey", weight(p % 2 == 0, scores.OWN_PROJECT, "by_project"), weight(p % 3 == 0, scores.OWN_AUTHOR, "by_author"))


# --- values and maps ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS number, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS strings FROM orders")
def null_zeros(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), zeros.text(F.when(k % 2 != 0, F.col("o_orderpriority"))).alias("text"), zeros.number(F.when(k % 3 != 0, F.col("o_custkey"))).alias("number"),
        F.size(zeros.strings(F.when(k % 5 != 0, F.array("o_orderpriority")))).alias("strings"),
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a=9,b=' || p_size ELSE 'a=' || p_partkey || ',b=' || p_size || ',c=9' END AS entries FROM part")
def put_package(spark, sf_dir):
    """A package put into a map of two, under a key of its own or in place of the first."""
    p = F.col("p_partkey")
    given = F.create_map(F.lit("a"), p.cast("string"), F.lit("b"), F.col("p_size").cast("string"))
    out = repos.put(given, F.when(p % 3 == 0, "a").otherwise("c"), F.lit("9"))
    entries = F.array_sort(F.transform(F.map_entries(out), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(entries, ",").alias("entries"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'nat' || s_nationkey || ' language:go' WHEN 1 THEN 'language:go' ELSE 'nat' || s_nationkey || ' language:go' END AS q FROM supplier")
def search_query(spark, sf_dir):
    s = F.col("s_suppkey") % 3
    q = F.when(s == 0, joined("nat", F.col("s_nationkey"), " language:go")).when(s == 1, "").otherwise(joined("nat", F.col("s_nationkey")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", repos.search_query(q).alias("q"))


@query("""SELECT unnest(json_extract_string(js, '$.results[*].path')) AS package FROM (SELECT '{"results":[{"path":"a.org/' || s_suppkey || '"},{"path":"b.org/' || s_nationkey || '","x":1}]}' AS js FROM supplier)""")
def listed_packages(spark, sf_dir):
    js = joined('{"results":[{"path":"a.org/', F.col("s_suppkey"), '"},{"path":"b.org/', F.col("s_nationkey"), '","x":1}]}')
    return snapshots.listed(table(spark, sf_dir, "supplier").select(js.alias("js")), "js")


@query("SELECT o_orderkey AS k, '/c/' || o_custkey AS uri, CASE WHEN o_custkey % 4 = 0 THEN 'body ' || o_custkey END AS body, CASE WHEN o_custkey % 4 = 0 THEN 200 ELSE 404 END AS status FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def canned_responses(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey")
    asked = table(spark, sf_dir, "orders").join(own, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("k"), joined("/c/", F.col("o_custkey")).alias("uri"))
    kept = own.filter("c_custkey % 4 = 0").select(joined("/c/", F.col("c_custkey")).alias("uri"), joined("body ", F.col("c_custkey")).alias("body"))
    return snapshots.canned(asked, kept).select("k", "uri", "body", "status")


NAMES_SQL = "names AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'x' || p_partkey ELSE CAST(p_partkey - 1 AS VARCHAR) END AS name FROM part WHERE p_partkey % 100 <> 50)"


@query(f"WITH {NAMES_SQL}, n AS (SELECT try_cast(name AS INTEGER) AS n FROM names) SELECT CAST(min(c) AS BIGINT) AS free, CAST((SELECT max(n) + 1 FROM n) AS BIGINT) AS next FROM (SELECT 0 AS c UNION ALL SELECT n + 1 FROM n) WHERE c NOT IN (SELECT n FROM n WHERE n IS NOT NULL)")
def segment_names(spark, sf_dir):
    """Names of new segments: the smallest free number, and one more than the greatest."""
    p = F.col("p_partkey")
    names = table(spark, sf_dir, "part").filter(p % 100 != 50).select(F.when(p % 9 == 0, joined("x", p)).otherwise((p - 1).cast("string")).alias("name"))
    one = lambda df, c: df.select(F.lit(0).alias("i"), F.col("name").cast("long").alias(c))  # noqa: E731  one row each
    return one(snapshots.next_free(names), "free").join(one(snapshots.next_max(names), "next"), "i").drop("i")


# --- tokens ---------------------------------------------------------------------------------------------------------

WORDS_SQL = PACKAGES_SQL + ", pairs AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name || ' ' || package || ' ' || description), '[a-z]+|[0-9]+')) AS token FROM packages)"


def pairs(spark, sf_dir) -> DataFrame:
    rows = v.packages(spark, sf_dir).select("id", F.lower(index.searched("name", "package", "description")).alias("t"))
    return rows.select("id", F.explode(F.array_distinct(F.flatten(F.transform(tokens.blocks(F.col("t")), tokens.raw_tokens)))).alias("token"))


@query(f"WITH {WORDS_SQL} SELECT id, string_agg(token, ' ' ORDER BY token) AS tokens FROM pairs WHERE regexp_full_match(token, '[a-z0-9]+') GROUP BY id")
def token_sets(spark, sf_dir):
    """The union of the tokens of a package's fields."""
    ascii_ = pairs(spark, sf_dir).filter(F.col("token").rlike("^[a-z0-9]+$"))
    by_id, _ = packages.token_index(ascii_, "id", "token")
    return by_id.select("id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {WORDS_SQL} SELECT id FROM pairs WHERE token = 'package'")
def token_lookup(spark, sf_dir):
    """The packages of one token, from a token index that was written and read back."""
    _, by_token = packages.token_index(pairs(spark, sf_dir), "id", "token")
    path = written(spark, "token-index")
    packages.save_token_index(by_token, path)
    return packages.ids_of(snapshots.load(spark, path, by_token.schema), "package")


# --- pages ----------------------------------------------------------------------------------------------------------


@query("""SELECT k, array_to_string(list_filter(range(1, total + 1), lambda i: i < p AND p - i < 10), ',') AS before, array_to_string(list_filter(range(1, total + 1), lambda i: i > p AND i - p < 10), ',') AS after,
  CASE WHEN p - 1 BETWEEN 1 AND total THEN p - 1 ELSE 0 END AS prev, CASE WHEN p + 1 <= total THEN p + 1 ELSE 0 END AS next FROM (SELECT p_partkey AS k, CAST(p_partkey % 40 + 1 AS INTEGER) AS p, CAST(p_size - 1 AS INTEGER) AS total FROM part)""")
def page_links(spark, sf_dir):
    number, total = (F.col("p_partkey") % 40 + 1).cast("int"), (F.col("p_size") - 1).cast("int")
    cols = search.page_link_columns(number, total)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *[F.array_join(cols[c].cast("array<string>"), ",").alias(c) for c in ("before", "after")], cols["prev"].alias("prev"), cols["next"].alias("next"))


AUTHOR_SQL = "CASE WHEN starts_with(package, 'code') THEN 'code.google.com' ELSE split_part(package, '/', 2) END"


@query(f"WITH {SCORE_SQL} SELECT row_number() OVER (ORDER BY static_score DESC, star_count DESC, octet_length(encode(package)), package) AS place, to_json({{name: s.name, package: package, author: {AUTHOR_SQL}, synopsis: trim(d.description), description: d.description, projecturl: 'http://' || package}})::VARCHAR AS hit FROM scored s JOIN (SELECT package, description FROM docs) d USING (package) ORDER BY place LIMIT 100")
def api_hits(spark, sf_dir):
    """The hundred best packages as the interface returns hits: the limit is its rule."""
    docs = v.packages(spark, sf_dir).select("package", "description")
    top = static(spark, sf_dir).withColumnRenamed("static_score", "score").select("package", "name", "score", "star_count").orderBy(*search.hit_order()).limit(100)
    rows = graph.placed(snapshots.keep(top, "api-hits"), search.hit_order()).join(docs, "package").withColumns({"author": paths.author(F.col("package")), "synopsis": F.trim("description"), "project_url": joined("http://", F.col("package"))})
    return rows.select((F.col("place") + 1).cast("long").alias("place"), search.as_json(search.API_KEYS).alias("hit"))


@query(f"WITH {PACKAGES_SQL} SELECT package, greatest(star_count - 10, 0) AS stars, octet_length(encode(description)) < 10 AND id % 3 <> 0 AS show_readme FROM packages")
def view_page(spark, sf_dir):
    readme = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("name"))
    return v.packages(spark, sf_dir).select("package", F.greatest(F.col("star_count") - 10, F.lit(0)).alias("stars"), search.shows_readme(F.col("description"), readme).alias("show_readme"))


URL_SQL = "replace(url_encode(package), '%20', '+')"


@query(f"""WITH {PACKAGES_SQL} SELECT package, '<svg xmlns="http://www.w3.org/2000/svg" width="100" height="20"><text x="4" y="14">rank ' || id || '</text></svg>' AS svg,
  '<a href="http://s.org/view?id=' || {URL_SQL} || '"><img src="http://s.org/badge?id=' || {URL_SQL} || '" alt="rank"></a>' AS html, '[![rank](http://s.org/badge?id=' || {URL_SQL} || ')](http://s.org/view?id=' || {URL_SQL} || ')' AS markdown FROM packages""")
def badges(spark, sf_dir):
    says = search.badge_snippets("http://s.org", F.col("package"))
    return v.packages(spark, sf_dir).select("package", search.badge(F.col("id")).alias("svg"), *[c.alias(n) for n, c in says.items()])


# --- tables written and read back ------------------------------------------------------------------------------------


@query(f"WITH {QUEUE_SQL} SELECT id, host, in_docs FROM q WHERE host = 'bitbucket.org'")
def queue_of_host(spark, sf_dir):
    """The crawl queue, written by host; one host is read back."""
    path = written(spark, "queue")
    schedule.write_queue(queued(spark, sf_dir), path)
    return spark.read.parquet(path).filter("host = 'bitbucket.org'").select("id", F.col("host").cast("string").alias("host"), "in_docs")


@query(f"WITH {CRAWL_SQL} SELECT id, version + 1 AS version FROM crawl WHERE k % 2 = 0")
def table_swap(spark, sf_dir):
    """A table that is replaced by what is computed from it, exported, and loaded."""
    path = written(spark, "swap")
    rows = v.crawl_entries(spark, sf_dir).select("id", "version", "k")
    snapshots.save(rows, path)
    snapshots.save(snapshots.load(spark, path, rows.schema).filter("k % 2 = 0").withColumn("version", F.col("version") + 1), path)
    snapshots.export(snapshots.load(spark, path, rows.schema), path + "-copy")
    return spark.read.schema(rows.schema).parquet(path + "-copy").select("id", "version")


@query(f"WITH {CRAWL_SQL} SELECT id, k FROM crawl WHERE k % 2 = 1")
def json_segment(spark, sf_dir):
    """Rows in a segment as JSON; of three segments the greatest finished one is read, and outdated ones go."""
    root = written(spark, "segments")
    segments = snapshots.Segments(spark, root)
    rows = v.crawl_entries(spark, sf_dir).select("id", "k")
    for part, done in ((0, True), (1, True), (0, False)):
        name = segments.new_max()
        snapshots.write_json(rows.filter(F.col("k") % 2 == part), f"{root}/{name}/rows")
        if done:
            segments.finish(name)
    segments.clear_outdated()
    return spark.read.schema("id string, k long").json([f"{root}/{n}/rows" for n in segments.all()])


@query(f"WITH {STORE_SQL} SELECT 'packages' AS kind, usr || '/' || name AS path, k FROM store WHERE k % 2 = 0 UNION ALL SELECT 'repositories', name, k FROM store WHERE k % 2 = 1")
def store_snapshot(spark, sf_dir):
    """Two tables of a store through a snapshot."""
    rows, path = stored(spark, sf_dir), written(spark, "snapshot")
    tables = {"packages": rows.filter("k % 2 = 0").select("path", "k"), "repositories": rows.filter("k % 2 = 1").select(F.col("name").alias("path"), "k")}
    store.snapshot(tables, path)
    back = store.restore(spark, path, {n: df.schema for n, df in tables.items()})
    one = lambda n: back[n].select(F.lit(n).alias("kind"), "path", "k")
    return one("packages").unionByName(one("repositories"))


@query(f"WITH {CRAWL_SQL} SELECT 'package' AS kind, id FROM crawl WHERE k % 11 <> 0 UNION ALL SELECT DISTINCT 'person', host || ':u' || k % 50 FROM crawl")
def crawler_tables(spark, sf_dir):
    """The crawler's two tables: put, deleted from, written and loaded anew."""
    root = written(spark, "crawler")
    entries = v.crawl_entries(spark, sf_dir).select("id", "host", "version", "k")
    schema = entries.select("id", "version").schema
    own = store.CrawlTables(spark, root, schema)
    own.put("package", entries.select("id", "version"))
    own.delete("package", entries.filter("k % 11 = 0"))
    own.put("person", entries.select(joined(F.col("host"), ":u", F.col("k") % 50).alias("id"), F.lit(0).alias("version")).distinct())
    own.sync()
    again = store.CrawlTables(spark, root, schema)
    one = lambda n: again.tables[n].select(F.lit(n).alias("kind"), "id")
    return one("package").unionByName(one("person"))
