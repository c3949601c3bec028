"""The registered queries of the package engine with their oracle SQL.

Both sides of a query compute the same from the raw tables; columns have the
same names. Doubles are rounded to six places where the order of summation may
differ.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import describing, paths, scores, sentences, source, stemming, tokens
from ..operators import graph, history, merge, repos, schedule, search, store, tops
from ..sources import snapshots
from ..sources import views as v
from ..sources.views import ACTIONS_SQL, CRAWL_SQL, DOCS_SQL, EDGES_SQL, HISTORY_SQL, PACKAGES_SQL, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW = dt.datetime(1999, 6, 17)
NOW_SQL = "TIMESTAMP '1999-06-17 00:00:00'"


class Given:
    """Columns made of a test table by expressions that read alike in Spark and in DuckDB."""

    def __init__(self, of: str, **columns: str):
        self.of, self.columns = of, columns
        self.sql = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {of})"

    def rows(self, spark, sf_dir) -> DataFrame:
        return table(spark, sf_dir, self.of).select(*[F.expr(e).alias(c) for c, e in self.columns.items()])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    def one(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


# --- paths ---------------------------------------------------------------------------------------------------------

PATHS = [
    (p,)
    for p in (
        "github.com/mo/ship", "github.com/mo/ship/deck", "gopkg.in/kite.v3", "gopkg.in/lee/tide.v15", "gopkg.in/lee/v0/set", "code.google.com/p/ship.deck/low", "llamaslayers.net/x/y", "bazil.org/fuse/fs",
        "launchpad.net/~mo/ship/deck", "launchpad.net/ship/a/b", "labix.org/v2/ship/deck", "golanger.com/x", "cgl.tideland.biz/a/b", "bitbucket.org/a/b/c/d", "example.org:8080/a/b/c/d",
        "github.com", "gopkg.in/v1", "gopkg.in", "bad host/x", "a.b", "",
    )
]
WEB_SQL = "(SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS pkg FROM pages)"
P = f"(SELECT pkg FROM {sql_values(PATHS, 'pkg')} UNION ALL SELECT pkg FROM {WEB_SQL})"
PARTS = "(SELECT pkg, string_split(pkg, '/') AS s FROM " + P + ")"


def web(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "").alias("pkg"))


def all_paths(spark, sf_dir):
    """The cases above and the paths of the pages."""
    return values(spark, PATHS, "pkg string").unionByName(web(spark, sf_dir).select("pkg"))


@query(rf"""SELECT pkg, CASE
  WHEN s[1] IN ('github.com', 'bitbucket.org') AND len(s) > 1 THEN s[2] WHEN s[1] = 'llamaslayers.net' THEN 'Nightgunner5'
  WHEN s[1] = 'launchpad.net' AND len(s) > 1 AND s[2][1] = '~' THEN s[2][2:]
  WHEN s[1] = 'gopkg.in' AND len(s) = 2 THEN CASE WHEN regexp_matches(s[2], '^.+\.v') THEN 'go-' || regexp_extract(s[2], '^(.+)\.v', 1) ELSE 'gopkg.in' END
  WHEN s[1] = 'gopkg.in' AND len(s) > 2 THEN s[2] ELSE s[1] END AS author FROM {PARTS}""")
def path_author(spark, sf_dir):
    return all_paths(spark, sf_dir).select("pkg", paths.author(F.col("pkg")).alias("author"))


@query(rf"""SELECT pkg, CASE
  WHEN s[1] IN ('llamaslayers.net', 'bazil.org') AND len(s) > 1 THEN s[2] WHEN s[1] IN ('github.com', 'code.google.com', 'bitbucket.org', 'labix.org') AND len(s) > 2 THEN s[3]
  WHEN s[1] = 'golanger.com' THEN 'golangers' WHEN s[1] = 'cgl.tideland.biz' THEN 'tcgl'
  WHEN s[1] = 'launchpad.net' AND len(s) > 2 AND s[2][1] = '~' THEN s[3] WHEN s[1] = 'launchpad.net' AND len(s) > 1 THEN s[2]
  WHEN s[1] = 'gopkg.in' AND len(s) > 1 THEN CASE WHEN regexp_matches(coalesce(s[3], s[2]), '^.+\.v') THEN regexp_extract(coalesce(s[3], s[2]), '^(.+)\.v', 1) ELSE s[1] END
  ELSE pkg END AS project FROM {PARTS}""")
def path_project(spark, sf_dir):
    return all_paths(spark, sf_dir).select("pkg", paths.project(F.col("pkg")).alias("project"))


FULL_SQL = """CASE WHEN s[1] IN ('llamaslayers.net', 'bazil.org', 'launchpad.net') THEN array_to_string(s[1:2], '/') WHEN s[1] = 'golanger.com' THEN 'golanger.com/golangers'
  WHEN s[1] = 'cgl.tideland.biz' THEN 'cgl.tideland.biz/tcgl' ELSE array_to_string(s[1:3], '/') END"""


@query(f"SELECT pkg, {FULL_SQL} AS project FROM {PARTS}")
def path_full_project(spark, sf_dir):
    return all_paths(spark, sf_dir).select("pkg", paths.full_project(F.col("pkg")).alias("project"))


@query(f"SELECT pkg, CASE WHEN contains(h, ' ') THEN '' ELSE h END AS host FROM (SELECT pkg, regexp_extract(pkg, '^[^/?#]*', 0) AS h FROM {P})")
def path_host(spark, sf_dir):
    return all_paths(spark, sf_dir).select("pkg", paths.host(F.col("pkg")).alias("host"))


@query(f"SELECT page_id, split_part(pkg, '/', 1) AS site, CASE WHEN contains(pkg, '/') THEN substr(pkg, strpos(pkg, '/') + 1) ELSE '' END AS path FROM {WEB_SQL}")
def site_path_split(spark, sf_dir):
    return web(spark, sf_dir).select("page_id", paths.site(F.col("pkg")).alias("site"), paths.rest(F.col("pkg")).alias("path"))


@query(f"SELECT page_id, regexp_replace(pkg, '^[^/]+/(.)', '\\1') AS path FROM {WEB_SQL}")
def remove_host(spark, sf_dir):
    return web(spark, sf_dir).select("page_id", paths.remove_host(F.col("pkg")).alias("path"))


NAMES = Given(
    "part", k="p_partkey", name="CASE p_partkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN '' ELSE p_brand END",
    pkg="CASE p_partkey % 3 WHEN 0 THEN concat('a', p_partkey) WHEN 1 THEN concat('github.com/', p_brand, '/r', p_partkey) ELSE concat('github.com/', p_brand, '/r/', p_type) END",
)


@query(f"SELECT k, CASE WHEN name = '' THEN '(' || p || ')' WHEN name = 'main' THEN 'main - ' || p ELSE name END AS shown FROM (SELECT *, coalesce(nullif(split_part(pkg, '/', 3), ''), pkg) AS p FROM {NAMES.sql})")
def display_name(spark, sf_dir):
    return NAMES.rows(spark, sf_dir).select("k", paths.display_name(F.col("name"), F.col("pkg")).alias("shown"))


@query("SELECT c_custkey, 'site' || CAST(c_nationkey AS VARCHAR) || ':' || c_name AS id, 'site' || CAST(c_nationkey AS VARCHAR) AS site, split_part(c_name, ':', 1) AS person FROM customer")
def person_id(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", paths.person_id(F.concat(F.lit("site"), F.col("c_nationkey")), F.col("c_name")).alias("id"))
    site, person = paths.person_parts(F.col("id"))
    return rows.select("c_custkey", "id", site.alias("site"), person.alias("person"))


@query(f"""WITH RECURSIVE b AS (SELECT pkg, 0 AS i, CAST(0 AS BIGINT) AS h FROM (SELECT DISTINCT pkg FROM {P})
  UNION ALL SELECT pkg, i + 1, CASE WHEN h * 33 + ascii(substr(pkg, i + 1, 1)) > 128 THEN (h * 33 + ascii(substr(pkg, i + 1, 1))) % 128 ELSE h * 33 + ascii(substr(pkg, i + 1, 1)) END FROM b WHERE i < length(pkg))
  SELECT pkg, h AS part FROM b WHERE i = length(pkg)""")
def partition_hash(spark, sf_dir):
    return all_paths(spark, sf_dir).distinct().select("pkg", paths.partition_hash(F.col("pkg")).alias("part"))


@query(f"""WITH {PACKAGES_SQL} SELECT package, array_to_string(s[1:i], '/') AS up FROM (SELECT package, s, unnest(range(2, len(s))) AS i FROM (SELECT package, string_split(package, '/') AS s FROM packages))""")
def path_ancestors(spark, sf_dir):
    return v.packages(spark, sf_dir).select("package", F.explode(paths.ancestors(F.col("package"))).alias("up"))


# powers of 1024 themselves, values beside them and between them
SIZES = Given("events", k="event_id", n="CAST(CASE event_id % 4 WHEN 0 THEN 1 ELSE event_id % 1100 END AS BIGINT) * CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 WHEN 4 THEN 1099511627776 ELSE 1125899906842624 END - event_id % 2")


@query(f"""SELECT k, CASE WHEN floor(x) < 10 THEN format('{{:.2f}}', x) WHEN floor(x) < 100 THEN format('{{:.1f}}', x) ELSE CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) END || ['', 'K', 'M', 'G', 'T', 'P'][i + 1] AS size
  FROM (SELECT k, i, n / (1024.0 ** i) AS x FROM (SELECT k, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 WHEN n < 1125899906842624 THEN 4 ELSE 5 END AS i FROM {SIZES.sql} WHERE n >= 0))""")
def readable_size(spark, sf_dir):
    return SIZES.rows(spark, sf_dir).filter("n >= 0").select("k", paths.readable_size(F.col("n")).alias("size"))


@query("""SELECT event_id, CASE WHEN x > 86400 THEN CAST(CAST(round(x / 86400) AS BIGINT) AS VARCHAR) || ' days' WHEN x >= 3600 THEN CAST(CAST(round(x / 3600) AS BIGINT) AS VARCHAR) || ' hours'
  WHEN x >= 60 THEN CAST(CAST(round(x / 60) AS BIGINT) AS VARCHAR) || ' mins' WHEN x >= 1 THEN CAST(CAST(round(x) AS BIGINT) AS VARCHAR) || ' sec' WHEN n >= 1000000 THEN CAST(n // 1000000 AS VARCHAR) || ' ms'
  WHEN n >= 1000 THEN CAST(n // 1000 AS VARCHAR) || ' us' ELSE CAST(n AS VARCHAR) || ' ns' END AS shown
  FROM (SELECT event_id, x, CAST(round(x * 1000000000) AS BIGINT) AS n FROM (SELECT event_id, abs(value) * CASE event_id % 6 WHEN 0 THEN 10000.0 WHEN 1 THEN 100.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.001 WHEN 4 THEN 0.000001 ELSE 0.0 END AS x FROM events))""")
def readable_duration(spark, sf_dir):
    k = F.col("event_id") % 6
    times = F.when(k == 0, 10000.0).when(k == 1, 100.0).when(k == 2, 1.0).when(k == 3, 0.001).when(k == 4, 0.000001).otherwise(0.0)
    return table(spark, sf_dir, "events").select("event_id", paths.readable_duration(F.abs("value") * times).alias("shown"))


CALLS = Given(
    "pages", k="page_id", cb="CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('cb', page_id) WHEN 2 THEN concat('a-', page_id, '.b(1)') WHEN 3 THEN concat('jQ_$', page_id) ELSE substr(url, 1, 12) END",
    code="CAST(CASE page_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 400 END AS INTEGER)",
)


@query(f"""SELECT k, CASE WHEN f = '' THEN '{{"k":' || k || '}}' ELSE f || '(' || CAST(code AS VARCHAR) || ', ' || '{{"k":' || k || '}}' || ');' END AS body FROM (SELECT *, regexp_replace(cb, '[^A-Za-z0-9_$]', '', 'g') AS f FROM {CALLS.sql})""")
def jsonp(spark, sf_dir):
    return CALLS.rows(spark, sf_dir).select("k", paths.jsonp(F.col("cb"), F.col("code"), F.to_json(F.struct("k"))).alias("body"))


REMOTE = Given(
    "pages", k="page_id",
    pkg="CASE page_id % 8 WHEN 0 THEN concat(' ', replace(url, 'https://', ''), ' ') WHEN 1 THEN concat('中host.org/a', page_id, '文') WHEN 2 THEN concat('net', page_id) WHEN 3 THEN concat('a.b//c', page_id) WHEN 4 THEN concat('net/http', page_id) "
    "WHEN 5 THEN concat('host.org/x y', page_id) WHEN 6 THEN concat('.host/', page_id) ELSE concat('host', page_id, '.org') END",
)


@query(rf"""SELECT k, name, regexp_full_match(name, '[^/\s]*[^/\s.]\.[^/\s.][^/\s]*(/[^/\s]+)*') AS valid FROM (SELECT k, regexp_replace(trim(pkg), '^[^\x00-\x{{80}}]+|[^\x00-\x{{80}}]+$', '', 'g') AS name FROM {REMOTE.sql})""")
def valid_remote_path(spark, sf_dir):
    rows = REMOTE.rows(spark, sf_dir).select("k", paths.trim_name(F.col("pkg")).alias("name"))
    return rows.withColumn("valid", paths.valid_remote(F.col("name")))


FILES = Given("part", k="p_partkey", u="p_brand", r="concat('r', p_partkey % 9)", p="CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN lower(p_type) WHEN 2 THEN concat('/', lower(p_type), '/') ELSE concat(lower(p_type), '//in') END", f="concat('f', p_partkey, '.x')")


@query(f"SELECT k, regexp_replace(u || '/' || r || '/' || p || '/' || f, '/+', '/', 'g') AS path FROM {FILES.sql}")
def full_file_path(spark, sf_dir):
    return FILES.rows(spark, sf_dir).select("k", paths.full_path(F.col("u"), F.col("r"), F.col("p"), F.col("f")).alias("path"))


# --- text ----------------------------------------------------------------------------------------------------------

STRIP_SQL = rf"regexp_replace(regexp_replace(text, '{tokens.URL}', ' ', 'g'), '{tokens.EMAIL}', '', 'g')"
BLOCK_SQL = rf"(SELECT doc_id, b, list_filter(regexp_split_to_array({STRIP_SQL}, '[\s\x{{85}}\p{{Z}}]+'), lambda x: x <> '') AS bs FROM documents, (SELECT 1 AS b))"
RAW_SQL = f"(SELECT doc_id, bi, regexp_extract_all(bs[bi], '{tokens.RAW}', 0) AS ts FROM (SELECT doc_id, bs, unnest(range(1, len(bs) + 1)) AS bi FROM {BLOCK_SQL}))"


@query(f"SELECT doc_id, length({STRIP_SQL}) AS n, md5({STRIP_SQL}) AS digest FROM documents")
def url_email_strip(spark, sf_dir):
    text = tokens.strip_links(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("n"), F.md5(text).alias("digest"))


def raw(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(tokens.blocks(F.col("text"))).alias("bi", "block")).select("doc_id", "bi", tokens.raw_tokens(F.col("block")).alias("ts"))


@query(f"SELECT DISTINCT doc_id, unnest(ts) AS token FROM {RAW_SQL}")
def raw_tokens(spark, sf_dir):
    """Repeats go within each document, so that nothing is shuffled (ids are unique)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tokens.words(F.col("text")))).alias("token"))


@query(f"SELECT count(*) AS blocks, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT len(ts) AS n FROM {RAW_SQL})")
def token_counts(spark, sf_dir):
    return raw(spark, sf_dir).agg(F.count("*").alias("blocks"), F.sum(F.size("ts")).alias("tokens"))


@query(f"""SELECT DISTINCT doc_id, CASE WHEN octet_length(encode(a)) = length(a) AND octet_length(encode(b)) = length(b) THEN a || '-' || b ELSE a || b END AS pair
  FROM (SELECT doc_id, ts[i] AS a, ts[i + 1] AS b FROM (SELECT doc_id, ts, unnest(range(1, len(ts))) AS i FROM {RAW_SQL})) WHERE (octet_length(encode(a)) = length(a)) = (octet_length(encode(b)) = length(b))""")
def token_pairs(spark, sf_dir):
    own = F.transform(tokens.blocks(F.col("text")), lambda b: tokens.pairs(tokens.raw_tokens(b)))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.flatten(own))).alias("pair"))


@query(f"SELECT DISTINCT doc_id, lower(t) AS token FROM (SELECT doc_id, unnest(ts) AS t FROM {RAW_SQL}) WHERE lower(t) NOT IN ('the', 'on', 'in', 'as')")
def stopword_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(distinct_words(F.col("text"))).alias("token"))


def distinct_words(text: Column) -> Column:
    """The distinct words of a text in small letters, without stop words."""
    return F.array_except(F.transform(tokens.words(text), F.lower), F.array(*[F.lit(t) for t in tokens.STOP]))


@query(f"""WITH given AS (SELECT DISTINCT unnest(ts) AS word FROM {RAW_SQL}), {stemming.stem_sql("SELECT word FROM given")} SELECT word, stem FROM stems""")
def stem_tokens(spark, sf_dir):
    """Distinct tokens of the documents with their stems; each word is stemmed once, by column expressions."""
    return raw_tokens(spark, sf_dir).select(F.col("token").alias("word")).distinct().select("word", stemming.stem(F.col("word")).alias("stem"))


def tokens_ctes(raw_sql: str) -> str:
    """CTEs of the tokens of the blocks (doc_id, bi, ts) of ``raw_sql``."""
    return rf"""tok AS (SELECT doc_id, bi, i, ts[i] AS word FROM (SELECT doc_id, bi, ts, unnest(range(1, len(ts) + 1)) AS i FROM {raw_sql})),
camel AS (SELECT doc_id, bi, i, regexp_extract_all(word, '\p{{Lu}}[^\p{{Lu}}]*|^[^\p{{Lu}}]+') AS ps FROM tok WHERE regexp_full_match(word, '\p{{L}}+') AND regexp_matches(word, '\p{{Lu}}') AND regexp_matches(word, '\p{{Ll}}')),
part AS (SELECT doc_id, bi, i, j, ps[j] AS word FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM camel)),
{stemming.stem_sql("SELECT word FROM tok UNION SELECT word FROM part")},
norm AS (SELECT doc_id, stem AS a, lead(stem) OVER (PARTITION BY doc_id, bi ORDER BY i) AS b FROM tok JOIN stems USING (word)),
inner_ AS (SELECT doc_id, stem AS a, lead(stem) OVER (PARTITION BY doc_id, bi, i ORDER BY j) AS b FROM part JOIN stems USING (word)),
wide AS (SELECT doc_id, a, b, octet_length(encode(a)) = length(a) AS p, octet_length(encode(b)) = length(b) AS q FROM norm WHERE b IS NOT NULL)"""


TOKENS_OF = """SELECT doc_id, a AS token FROM norm WHERE a NOT IN ('the', 'on', 'in', 'as') UNION SELECT doc_id, CASE WHEN p THEN a || '-' || b ELSE a || b END FROM wide WHERE p = q
UNION SELECT doc_id, a FROM inner_ WHERE a NOT IN ('the', 'on', 'in', 'as') UNION SELECT doc_id, a || b FROM inner_ WHERE b IS NOT NULL"""
SEARCH_TOKENS_SQL = f"WITH {tokens_ctes(RAW_SQL)} {TOKENS_OF}"


@query(SEARCH_TOKENS_SQL)
def search_tokens(spark, sf_dir):
    return tokens.tokenize(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(SEARCH_TOKENS_SQL)
def search_token_columns(spark, sf_dir):
    """The same tokens by column expressions alone."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens.token_set(F.coalesce("text", F.lit("")))).alias("token"))


SENTENCE_SQL = r"""(SELECT doc_id, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '(-{4,}|={4,})\n', chr(10), 'g'), '-{2,}={2,}|={2,}-{2,}', '', 'g'), '\n\n+'),
  lambda p: string_split(replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), chr(10), ' '), '. ')) AS ps FROM documents)"""


SPLIT_SQL = rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) - 1 AS i, regexp_replace(CASE WHEN si < len(ss) THEN ss[si] || '.' ELSE ss[si] END, '\s+', ' ', 'g') AS sentence
  FROM (SELECT doc_id, pi, ss, unnest(range(1, len(ss) + 1)) AS si FROM (SELECT doc_id, pi, ps[pi] AS ss FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS pi FROM {SENTENCE_SQL})))"""


@query(SPLIT_SQL)
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences.split_sentences(F.coalesce("text", F.lit("")))).alias("i", "sentence")).withColumn("i", F.col("i").cast("long"))


NAMED_SQL = f"""WITH {describing.chosen_sql(f"SELECT s.doc_id AS k, i, sentence, 'pkg' || s.doc_id AS name, 'github.com/u/' || lower(regexp_extract(coalesce(text, ''), '[A-Za-z]+')) AS pkg FROM ({SPLIT_SQL}) s JOIN documents d ON d.doc_id = s.doc_id")}"""


def described(spark, sf_dir):
    """The important sentences of each document, as of a package called after its first word."""
    docs = table(spark, sf_dir, "documents")
    pkg = F.concat(F.lit("github.com/u/"), F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0)))
    return docs.select("doc_id", "text", describing.chosen(F.col("text"), F.concat(F.lit("pkg"), F.col("doc_id")), pkg).alias("sentences"))


@query(f"{NAMED_SQL} SELECT k AS doc_id, string_agg(sentence, chr(10) ORDER BY i) AS sentences FROM chosen GROUP BY k")
def important_sentences(spark, sf_dir):
    """Chosen by wording and by a pattern of each document's own, without Python workers."""
    return described(spark, sf_dir).filter(F.size("sentences") > 0).select("doc_id", F.array_join("sentences", "\n").alias("sentences"))


@query(f"{NAMED_SQL} SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM documents WHERE text <> '') AS with_text, count(DISTINCT k) AS with_important, count(*) AS sentences FROM chosen")
def corpus_sentence_stats(spark, sf_dir):
    rows = described(spark, sf_dir)
    return rows.agg(F.count("*").alias("docs"), F.count_if(F.length("text") > 0).alias("with_text"), F.count_if(F.size("sentences") > 0).alias("with_important"), F.sum(F.size("sentences")).alias("sentences"))


MARKED = ["and", "of", "to"]
# lines as documents of their own, numbered below 1,000,000
LINE_RAW_SQL = RAW_SQL.replace("FROM documents", "FROM (SELECT k * 1000000 + i AS doc_id, line AS text FROM line)")
LINE_HITS_SQL = f"SELECT doc_id // 1000000 AS k, doc_id % 1000000 AS i, token FROM (WITH {tokens_ctes(LINE_RAW_SQL)} {TOKENS_OF})"
SNIPPET_SQL = f"WITH RECURSIVE {describing.snippet_sql('SELECT doc_id AS k, text FROM documents', LINE_HITS_SQL, MARKED)} SELECT k AS doc_id, snippet FROM snippets"


@query(SNIPPET_SQL)
def snippet(spark, sf_dir):
    """Chosen by folds over the lines; the oracle steps through them."""
    return table(spark, sf_dir, "documents").select("doc_id", describing.snippet(F.col("text"), MARKED).alias("snippet"))


@query(f"WITH {describing.marked_sql("SELECT doc_id AS k, text FROM documents WHERE text IS NOT NULL AND text <> ''", MARKED)} SELECT d.doc_id, CASE WHEN d.text = '' THEN '' ELSE marked END AS marked FROM documents d LEFT JOIN marked ON k = d.doc_id")
def mark_text(spark, sf_dir):
    """Marked by column expressions."""
    return table(spark, sf_dir, "documents").select("doc_id", describing.marked(F.col("text"), MARKED).alias("marked"))


@query()
def markdown_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sentences.readme_text(F.when(F.col("doc_id") % 2 == 0, "README.md").otherwise("README"), F.concat(F.lit("# Title\n\n"), F.col("text"))).alias("text"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'ShouldIgnore' WHEN doc_id % 11 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'ShouldIgnore' ELSE 'ParseFailed' END ELSE 'ParseSuccess' END AS status,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN '' ELSE 'p' || CAST(doc_id AS VARCHAR) END AS name, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN '' ELSE regexp_extract(text, '[A-Za-z]+') END AS description,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN '' ELSE 'x.org/' || lang || ',a.org/b,c.org/' || source END AS imports, doc_id % 5 = 0 AS is_test FROM (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents)""")
def parse_header(spark, sf_dir):
    """Source files about the first word of each document: every seventh has an unknown build tag, every eleventh no package clause."""
    k, text = F.col("doc_id"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    tag = F.when(k % 7 == 0, "// +build ignore\n\n").otherwise("")
    clause = F.when(k % 11 == 0, "pack").otherwise(text("package p", k))
    # one line with two imports, a group, an import in a comment, and one in a string behind the first declaration
    start = text(tag, "/* import \"none.org/x\" */\n\n// ", F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0), "\n", clause, "\n\n")
    body = text(start, "import (\"x.org/", F.col("lang"), "\"; `a.org/b`)\nimport (\n\t// \"c.org/no\"\n\tz \"c.org/", F.col("source"), "\"\n)\nvar s = `\nimport \"d.org/no\"`\n")
    parsed = table(spark, sf_dir, "documents").select("doc_id", source.parse_header(text("f", k, F.when(k % 5 == 0, "_test.go").otherwise(".go")), body).alias("h"))
    return parsed.select("doc_id", "h.status", "h.name", "h.description", F.array_join("h.imports", ",").alias("imports"), "h.is_test")


# --- search --------------------------------------------------------------------------------------------------------

QUERY = ("and", "of", "to")
POST_SQL = f"postings AS (SELECT DISTINCT doc_id, lower(t) AS token FROM (SELECT doc_id, unnest(ts) AS t FROM {RAW_SQL}) WHERE lower(t) NOT IN ('the', 'on', 'in', 'as'))"
IDF_SQL = "CASE WHEN ln(n / df) > 1 THEN sqrt(ln(n / df)) ELSE ln(n / df) END"


def postings(spark, sf_dir):
    return stopword_filter(spark, sf_dir)


@query(f"WITH {POST_SQL} SELECT token, count(*) AS df FROM postings GROUP BY token")
def doc_frequency(spark, sf_dir):
    return search.frequencies(postings(spark, sf_dir))


@query(f"WITH {POST_SQL}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents) SELECT token, round({IDF_SQL}, 6) AS idf FROM (SELECT token, count(*) AS df FROM postings GROUP BY token), n")
def idf(spark, sf_dir):
    total = table(spark, sf_dir, "documents").count()
    return doc_frequency(spark, sf_dir).select("token", F.round(scores.idf(F.col("df"), F.lit(float(total))), 6).alias("idf"))


@query("SELECT count(*) AS n FROM documents")
def total_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))


@query(f"SELECT count(DISTINCT {FULL_SQL}) AS n FROM (SELECT string_split(pkg, '/') AS s FROM {WEB_SQL})")
def project_count(spark, sf_dir):
    return web(spark, sf_dir).agg(F.countDistinct(paths.full_project(F.col("pkg"))).alias("n"))


@query(f"WITH {POST_SQL} SELECT doc_id FROM postings WHERE token IN ('and', 'of', 'to') GROUP BY doc_id HAVING count(*) = 3")
def search_and(spark, sf_dir):
    return search.matching(postings(spark, sf_dir), list(QUERY)).select("doc_id")


@query(f"WITH {POST_SQL} SELECT doc_id, count(*) AS n FROM postings WHERE token IN ('and', 'of', 'to') GROUP BY doc_id")
def search_or(spark, sf_dir):
    return search.matching(postings(spark, sf_dir), list(QUERY), "or")


def scored(spark, sf_dir):
    """Documents that match the query; the first line is the synopsis, the source the name, language and source the path."""
    docs = table(spark, sf_dir, "documents")
    # one pass over the texts: the postings of the query's tokens serve frequencies and retrieval
    own = snapshots.keep(postings(spark, sf_dir).filter(F.col("token").isin(*QUERY)), "query-postings")
    query_idf = search.idfs(own, list(QUERY), docs.count())
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    first = F.lower(F.get(F.split("text", "\n"), F.lit(0)))
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"))
    fields = {"synopsis": (first, words(first)), "sentences": (F.lit(""), F.array().cast("array<string>")), "name": (F.col("source"), words(F.col("source"))), "path": (path, words(path))}
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    hits = docs.join(search.matching(own, list(QUERY)).select("doc_id"), "doc_id").join(labels, "doc_id", "left")
    prior = F.lit(1.0) + F.coalesce("quality", F.lit(0))
    match = scores.match_score(query_idf, fields)
    return hits.select("doc_id", F.col("source").alias("name"), F.concat(F.lit("d/"), F.col("doc_id")).alias("package"), F.coalesce("quality", F.lit(0)).alias("star_count"), match.alias("match"), (prior * match).alias("score"))


MATCH_SQL = f"""{POST_SQL}, q AS (SELECT token, {IDF_SQL} AS i FROM (SELECT token, count(*) AS df FROM postings WHERE token IN ('and', 'of', 'to') GROUP BY token), (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)),
f AS (SELECT doc_id, source AS name, lower(string_split(text, chr(10))[1]) AS syn, lang || '/' || source AS path, coalesce(quality, 0) AS quality FROM documents JOIN (SELECT doc_id FROM postings WHERE token IN ('and', 'of', 'to') GROUP BY doc_id HAVING count(*) = 3) USING (doc_id)
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
m AS (SELECT doc_id, name, quality, 0.06 + sum(CASE WHEN contains(syn, token) THEN 0.25 * i ELSE 0 END + CASE WHEN contains(name, token) THEN 0.25 * i ELSE 0 END + CASE WHEN contains(path, token) THEN 0.1 * i ELSE 0 END) AS match FROM f, q GROUP BY doc_id, name, quality)"""


@query(f"WITH {MATCH_SQL} SELECT doc_id, round(match, 6) AS match FROM m")
def match_score(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.round("match", 6).alias("match"))


@query(f"WITH {MATCH_SQL} SELECT doc_id, round((1 + quality) * match, 6) AS score FROM m")
def search_scored(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {MATCH_SQL} SELECT doc_id, round((1 + quality) * match, 6) AS score FROM m ORDER BY round((1 + quality) * match, 6) DESC, quality DESC, length('d/' || CAST(doc_id AS VARCHAR)), 'd/' || CAST(doc_id AS VARCHAR) LIMIT 100")
def search_sorted(spark, sf_dir):
    """The first hundred hits, as the interface returns them."""
    return search.sorted_hits(scored(spark, sf_dir).withColumn("score", F.round("score", 6))).limit(100).select("doc_id", "score")


HITS_SQL = f"WITH {PACKAGES_SQL}, hits AS (SELECT package, name, star_count, CAST(star_count % 7 AS DOUBLE) AS score FROM packages)"
ORDER_SQL = "score DESC, star_count DESC, octet_length(encode(package)), package"


def hits(spark, sf_dir):
    return v.packages(spark, sf_dir).select("package", "name", "star_count", (F.col("star_count") % 7).cast("double").alias("score"), F.lit(0).alias("imported_len"), F.lit(0).alias("test_imported_len"))


@query(HITS_SQL + f", o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {ORDER_SQL}) AS k, count(*) OVER () AS n FROM hits) SELECT package, CASE WHEN n < 5000 THEN k ELSE 1 END AS occurrence, round(CASE WHEN n < 5000 AND k > 1 THEN score / k ELSE score END, 6) AS final_score FROM o")
def demote_duplicates(spark, sf_dir):
    return search.demoted(hits(spark, sf_dir)).select("package", F.col("occurrence").cast("long").alias("occurrence"), F.round("final_score", 6).alias("final_score"))


FOLD_SQL = HITS_SQL + f""", r AS (SELECT package, row_number() OVER (ORDER BY {ORDER_SQL}) AS rank, string_split(package, '/') AS s FROM hits),
up AS (SELECT package, rank, array_to_string(s[1:i], '/') AS up FROM (SELECT *, unnest(range(2, len(s))) AS i FROM r)),
above AS (SELECT up.package, up.up FROM up JOIN r ON r.package = up.up AND r.rank < up.rank)"""


def ranked_hits(spark, sf_dir):
    return graph.placed(hits(spark, sf_dir), search.hit_order()).withColumn("rank", F.col("place") + 1)


@query(FOLD_SQL + " SELECT r.package, r.rank, max_by(a.up, length(a.up)) AS parent FROM r LEFT JOIN (SELECT * FROM above WHERE up NOT IN (SELECT package FROM above)) a USING (package) GROUP BY r.package, r.rank")
def fold_results(spark, sf_dir):
    return search.folded(ranked_hits(spark, sf_dir)).select("package", F.col("rank").cast("long").alias("rank"), "parent")


@query(HITS_SQL + f" SELECT package, score FROM hits ORDER BY {ORDER_SQL} LIMIT 10 OFFSET 20")
def page_window(spark, sf_dir):
    """The third page of ten."""
    return search.page(hits(spark, sf_dir), search.hit_order(), 3).select("package", "score")


# --- import graph --------------------------------------------------------------------------------------------------

KINDS_SQL = EDGES_SQL + ", kinds AS (SELECT importer, imported, bool_and(test) AS test FROM edges WHERE importer <> imported GROUP BY ALL)"
BY_SQL = "array_to_string(string_split({}, '/')[1:3], '/')"


@query(f"WITH {EDGES_SQL} SELECT importer, imported, test FROM edges WHERE importer <> imported")
def import_edges(spark, sf_dir):
    return graph.without_self(v.edges(spark, sf_dir))


@query(f"WITH {KINDS_SQL} SELECT importer, imported FROM kinds WHERE test")
def test_imports_except(spark, sf_dir):
    return graph.test_only(v.edges(spark, sf_dir))


@query(f"WITH {KINDS_SQL} SELECT imported AS package, count(*) FILTER (NOT test) AS imported_len, count(*) FILTER (test) AS test_imported_len FROM kinds GROUP BY imported")
def reverse_imports(spark, sf_dir):
    return graph.reverse(v.edges(spark, sf_dir))


@query(f"WITH {KINDS_SQL} SELECT importer, imported FROM edges WHERE importer <> imported AND {BY_SQL.format('importer')} <> {BY_SQL.format('imported')} GROUP BY ALL")
def exclude_imports(spark, sf_dir):
    return graph.other_projects(v.edges(spark, sf_dir)).select("importer", "imported").distinct()


@query(f"WITH {KINDS_SQL}, k AS (SELECT *, {BY_SQL.format('importer')} AS by FROM kinds) SELECT importer, imported FROM k WHERE test AND NOT EXISTS (SELECT 1 FROM k n WHERE NOT n.test AND n.imported = k.imported AND n.by = k.by)")
def real_test_imports(spark, sf_dir):
    return graph.real_tests(graph.edge_kinds(v.edges(spark, sf_dir)))


PROJECT_SQL = KINDS_SQL + f""", importers AS (SELECT {BY_SQL.format('imported')} AS project, count(DISTINCT {BY_SQL.format('importer')}) AS importers FROM kinds GROUP BY 1),
stars AS (SELECT {BY_SQL.format('package')} AS project, max_by(star_count, (coalesce(last_updated, TIMESTAMP '1970-01-01'), package)) AS stars FROM docs GROUP BY 1),
assigned AS (SELECT d.package, CASE WHEN d.package = p.project THEN CAST(stars AS DOUBLE) WHEN importers IS NULL THEN 0 ELSE CAST(stars AS DOUBLE) / importers * coalesce(n, 0) END AS assigned_stars
  FROM (SELECT package, {BY_SQL.format('package')} AS project FROM docs) d JOIN stars p USING (project) LEFT JOIN importers USING (project)
  LEFT JOIN (SELECT imported AS package, count(DISTINCT {BY_SQL.format('importer')}) AS n FROM kinds GROUP BY 1) USING (package))"""


@query(f"WITH {PROJECT_SQL} SELECT project, importers FROM importers")
def project_importers(spark, sf_dir):
    return graph.project_importers(v.edges(spark, sf_dir))


@query(f"WITH {PROJECT_SQL} SELECT project, stars FROM stars")
def project_stars(spark, sf_dir):
    return graph.project_stars(v.docs(spark, sf_dir))


@query(f"WITH {PROJECT_SQL} SELECT package, round(assigned_stars, 6) AS assigned_stars FROM assigned")
def assigned_stars(spark, sf_dir):
    return graph.assigned_stars(v.docs(spark, sf_dir), v.edges(spark, sf_dir)).select("package", F.round("assigned_stars", 6).alias("assigned_stars"))


EFFECT_SQL = """(SELECT imported AS package, sum(CASE WHEN a = CASE WHEN starts_with(imported, 'code') THEN 'code.google.com' ELSE split_part(imported, '/', 2) END OR p = split_part(imported, '/', 3) THEN 0.5 ELSE 1.0 END) AS effective FROM (
  SELECT *, row_number() OVER (PARTITION BY imported, p ORDER BY importer) AS j FROM (SELECT *, row_number() OVER (PARTITION BY imported, a ORDER BY importer) AS i FROM (SELECT *, CASE WHEN starts_with(importer, 'code') THEN 'code.google.com' ELSE split_part(importer, '/', 2) END AS a, split_part(importer, '/', 3) AS p FROM {})) WHERE i = 1)
  WHERE j = 1 GROUP BY imported)"""


@query(f"WITH {KINDS_SQL} SELECT package, CAST(effective AS DOUBLE) AS effective FROM {EFFECT_SQL.format('(SELECT * FROM kinds WHERE NOT test)')}")
def effective_imported(spark, sf_dir):
    importers = snapshots.keep(graph.as_importers(v.packages(spark, sf_dir).select("id", "package")), "importers")
    return graph.effective_of(graph.by_project(v.kinds(spark, sf_dir, importers)))


BONUS_SQL = """CASE WHEN t = '' THEN 0 ELSE 1 + CASE WHEN octet_length(encode(t)) > 100 THEN 0.5 ELSE 0 END + CASE WHEN starts_with(t, 'Package ' || name) OR starts_with(t, name || ' package') THEN 0.5 WHEN starts_with(t, 'package ' || name) THEN 0.4 ELSE 0 END END + CASE WHEN name NOT IN ('', 'main') THEN 0.1 ELSE 0 END"""
SCORE_SQL = PROJECT_SQL + f""", k AS (SELECT *, {BY_SQL.format('importer')} AS by FROM kinds), real AS (SELECT importer, imported FROM k WHERE test AND NOT EXISTS (SELECT 1 FROM k n WHERE NOT n.test AND n.imported = k.imported AND n.by = k.by)),
counts AS (SELECT imported AS package, count(*) FILTER (NOT test) AS i, count(*) FILTER (test) AS tests FROM kinds GROUP BY 1), reals AS (SELECT imported AS package, count(*) AS r FROM real GROUP BY 1),
x AS (SELECT d.package, d.name, coalesce(e.effective, 0) AS e, coalesce(et.effective, 0) AS et, coalesce(i, 0) AS i, coalesce(tests, 0) AS t, coalesce(r, 0) AS r, 0.5 * sqrt(greatest(assigned_stars - 3, 0)) AS s, {BONUS_SQL} AS nb, d.star_count
  FROM (SELECT *, trim(description) AS t FROM docs) d JOIN assigned USING (package) LEFT JOIN counts USING (package) LEFT JOIN reals USING (package) LEFT JOIN {EFFECT_SQL.format('(SELECT * FROM kinds WHERE NOT test)')} e USING (package) LEFT JOIN {EFFECT_SQL.format('real')} et USING (package)),
scored AS (SELECT package, name, star_count, round((1 + e + nb + s * CASE WHEN i + t > 0 THEN CAST(i AS DOUBLE) / (i + t) ELSE 1 END) * CASE WHEN starts_with(package, 'code.google.com/') THEN 0.25 ELSE 1 END, 6) AS static_score, round(1 + et + nb + least(s * CASE WHEN i + r > 0 THEN CAST(r AS DOUBLE) / (i + r) ELSE 1 END, et), 6) AS test_static_score, i AS imported_len, t AS test_imported_len FROM x)"""


def static(spark, sf_dir):
    docs = snapshots.keep(v.docs(spark, sf_dir), "docs")
    importers = snapshots.keep(graph.as_importers(docs.select("id", "package")), "importers")
    out = graph.static_scores(docs, graph.by_project(v.kinds(spark, sf_dir, importers)), F.lit(NOW), F.col("description")).join(docs.select("package", "star_count"), "package")
    return out.withColumns({c: F.round(c, 6) for c in ("static_score", "test_static_score")})


@query(f"WITH {SCORE_SQL} SELECT package, static_score FROM scored")
def static_score(spark, sf_dir):
    return static(spark, sf_dir).select("package", "static_score")


@query(f"WITH {SCORE_SQL} SELECT package, test_static_score FROM scored")
def test_static_score(spark, sf_dir):
    return static(spark, sf_dir).select("package", "test_static_score")


@query(f"WITH {SCORE_SQL} SELECT package, rank() OVER (ORDER BY static_score DESC) - 1 AS static_rank, row_number() OVER (ORDER BY static_score DESC, package) - 1 AS doc_id FROM scored")
def static_rank(spark, sf_dir):
    return graph.ranked(static(spark, sf_dir)).select("package", F.col("static_rank").cast("long").alias("static_rank"), F.col("doc_id").cast("long").alias("doc_id"))


TOP_SQL = {
    "tops_hot": "SELECT package, static_score FROM (SELECT *, row_number() OVER (PARTITION BY {} ORDER BY static_score DESC, package) AS k FROM scored WHERE imported_len > 0 AND name NOT IN ('', 'main')) WHERE k = 1 ORDER BY static_score DESC, package LIMIT 20".format(BY_SQL.format("package")),
    "tops_test": "SELECT package, test_static_score FROM scored WHERE test_imported_len > 0 ORDER BY test_static_score DESC, package LIMIT 20",
    "tops_imported": "SELECT package, imported_len + test_imported_len AS n FROM scored ORDER BY n DESC, package LIMIT 20",
}


@query(f"WITH {SCORE_SQL} {TOP_SQL['tops_hot']}")
def tops_hot(spark, sf_dir):
    return tops.hot(static(spark, sf_dir), "static_score", 20, "imported_len").select("package", "static_score")


@query(f"WITH {SCORE_SQL} {TOP_SQL['tops_test']}")
def tops_test(spark, sf_dir):
    return tops.top(static(spark, sf_dir).filter("test_imported_len > 0"), "test_static_score", 20).select("package", "test_static_score")


@query(f"WITH {SCORE_SQL} {TOP_SQL['tops_imported']}")
def tops_imported(spark, sf_dir):
    return tops.top(static(spark, sf_dir).withColumn("n", F.col("imported_len") + F.col("test_imported_len")), "n", 20).select("package", "n")


@query(f"SELECT lower(split_part(pkg, '/', 1)) AS site, count(*) AS n FROM {WEB_SQL} GROUP BY 1 ORDER BY n DESC, site LIMIT 20")
def tops_sites(spark, sf_dir):
    return tops.sites(web(spark, sf_dir).withColumnRenamed("pkg", "package"), 20)


NESTED_SQL = """best AS (SELECT package, static_score, row_number() OVER (ORDER BY static_score DESC, package) AS place FROM scored WHERE imported_len > 0 AND name NOT IN ('', 'main')),
ups AS (SELECT package, place, array_to_string(s[1:i], '/') AS up FROM (SELECT *, unnest(range(1, len(s))) AS i FROM (SELECT *, string_split(package, '/') AS s FROM best)))"""


@query(f"WITH {SCORE_SQL}, {NESTED_SQL} SELECT package, static_score, row_number() OVER (ORDER BY place) AS place FROM best WHERE package NOT IN (SELECT ups.package FROM ups JOIN best b ON ups.up = b.package AND b.place < ups.place) ORDER BY place LIMIT 50")
def tops_hot_nested(spark, sf_dir):
    """The hot list where every package is a project, so that projects lie inside others."""
    rows = tops.hot(static(spark, sf_dir), "static_score", 50, "imported_len", F.col("package"))
    return rows.select("package", "static_score", F.row_number().over(Window.orderBy(F.desc("static_score"), "package")).cast("long").alias("place"))


SHOWN_SQL = "CASE WHEN name = '' THEN '(' || split_part(package, '/', 3) || ')' WHEN name = 'main' THEN 'main - ' || split_part(package, '/', 3) ELSE name END"


@query(f"""WITH {SCORE_SQL}, hot AS ({TOP_SQL['tops_hot']}), parts AS (
  SELECT 'Hot' AS list, 'refs stars' AS about, static_score AS x, package, name, imported_len || ' ' || star_count AS info FROM scored WHERE package IN (SELECT package FROM hot)
  UNION ALL (SELECT 'Hot Test', 'refs stars', test_static_score, package, name, test_imported_len || ' ' || star_count FROM scored WHERE test_imported_len > 0 ORDER BY test_static_score DESC, package LIMIT 20)
  UNION ALL (SELECT 'Most Imported', 'refs', imported_len + test_imported_len, package, name, CAST(imported_len + test_imported_len AS VARCHAR) FROM scored ORDER BY imported_len + test_imported_len DESC, package LIMIT 20))
SELECT list, about, row_number() OVER (PARTITION BY list ORDER BY x DESC, package) AS place, {SHOWN_SQL} AS name, package, '' AS link, info FROM parts
UNION ALL SELECT 'Sites', 'packages', row_number() OVER (ORDER BY n DESC, site), site, '', 'http://' || site, CAST(n AS VARCHAR) FROM (SELECT split_part(package, '/', 1) AS site, count(*) AS n FROM scored GROUP BY 1)""")
def tops_report(spark, sf_dir):
    return tops.report(static(spark, sf_dir), 20).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {SCORE_SQL} SELECT package, row_number() OVER (ORDER BY static_score DESC, package) - 1 AS doc_id FROM scored")
def packages_list(spark, sf_dir):
    """All packages in the order of their ids, which come with them."""
    return graph.ranked(static(spark, sf_dir)).select("package", F.col("doc_id").cast("long").alias("doc_id")).orderBy("doc_id")


FIND = ("economy", "small")
FIND_SQL = SCORE_SQL + """, words AS (SELECT package, regexp_extract_all(lower(name || ' ' || package), '[a-z]+|[0-9]+') AS w, regexp_extract_all(lower(name), '[a-z]+|[0-9]+') AS nw FROM docs),
q AS (SELECT token, CASE WHEN ln(n / greatest(df, 1)) > 1 THEN sqrt(ln(n / greatest(df, 1))) ELSE ln(n / greatest(df, 1)) END AS ti, CASE WHEN ln(n / greatest(nf, 1)) > 1 THEN sqrt(ln(n / greatest(nf, 1))) ELSE ln(n / greatest(nf, 1)) END AS ni
  FROM (SELECT token, count(*) FILTER (list_contains(w, token)) AS df, count(*) FILTER (list_contains(nw, token)) AS nf, CAST(count(*) AS DOUBLE) AS n FROM words, (SELECT unnest(['economy', 'small']) AS token) GROUP BY token)),
hit AS (SELECT d.package, lower(d.description) AS syn, lower(d.name) AS nm, lower(substr(d.package, strpos(d.package, '/') + 1)) AS path, s.static_score, s.test_static_score, d.star_count FROM docs d JOIN words USING (package) JOIN scored s USING (package) WHERE list_contains(w, 'economy') AND list_contains(w, 'small')),
found AS (SELECT package, star_count, greatest(static_score, test_static_score) * (0.04 + sum(CASE WHEN contains(syn, token) THEN 0.25 * ti ELSE 0 END + CASE WHEN contains('the ' || nm || ' thing', token) THEN 0.25 * ti ELSE 0 END + CASE WHEN contains(nm, token) THEN 0.25 * ni ELSE 0 END + CASE WHEN contains(path, token) THEN 0.1 * ti ELSE 0 END)) AS score
  FROM hit, q GROUP BY package, star_count, static_score, test_static_score)"""


@query(f"WITH {FIND_SQL} SELECT package, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, star_count DESC, octet_length(encode(package)), package) AS rank FROM found")
def search_ranked(spark, sf_dir):
    """Packages that hold both words, by the better of their static scores times their match, with their rank."""
    rows = static(spark, sf_dir).join(v.docs(spark, sf_dir).select("package", "description"), "package")
    cut = lambda c: tokens.raw_tokens(F.lower(c))
    path = scores.match_path(F.col("package"))
    rows = snapshots.keep(rows.withColumns({"__name": cut(F.col("name")), "__path": cut(path), "__text": cut(F.concat_ws(" ", "name", "package")), "__synopsis": cut(F.col("description"))}), "find")
    has = lambda c, t: F.count_if(F.array_contains(c, t))
    # one row of counts
    n = rows.agg(F.count("*").alias("n"), *[has("__text", t).alias(f"t_{t}") for t in FIND], *[has("__name", t).alias(f"n_{t}") for t in FIND])
    n = n.select(*[scores.idf(F.col(f"{k}_{t}"), F.col("n").cast("double")).alias(f"{k}_{t}") for t in FIND for k in "tn"]).first()
    said = F.concat(F.lit("the "), F.lower("name"), F.lit(" thing"))
    fields = {"synopsis": (F.lower("description"), F.col("__synopsis")), "sentences": (said, cut(said)), "name": (F.lower("name"), F.col("__name")), "path": (path, F.col("__path"))}
    match = scores.match_score([(t, n[f"t_{t}"], n[f"n_{t}"]) for t in FIND], fields)
    hit = rows.filter(F.forall(F.array(*[F.lit(t) for t in FIND]), lambda t: F.array_contains("__text", t)))
    hit = hit.withColumn("score", F.round(F.greatest("static_score", "test_static_score") * match, 6)).select("package", "score", "star_count")
    return graph.placed(hit, search.hit_order()).select("package", "score", (F.col("place") + 1).cast("long").alias("rank"))


@query(f"WITH {DOCS_SQL} SELECT package, name, star_count, last_updated FROM docs WHERE package = (SELECT min(package) FROM docs)")
def package_lookup(spark, sf_dir):
    docs = v.docs(spark, sf_dir)
    least = docs.agg(F.min("package").alias("package"))
    return docs.join(F.broadcast(least), "package").select("package", "name", "star_count", "last_updated")


@query(f"WITH {KINDS_SQL} SELECT importer AS package, count(*) FILTER (NOT test) AS imports, count(*) FILTER (test) AS test_imports, string_agg(imported, ',' ORDER BY imported) AS names FROM kinds GROUP BY importer")
def package_depends(spark, sf_dir):
    kinds = graph.edge_kinds(v.edges(spark, sf_dir))
    return kinds.groupBy(F.col("importer").alias("package")).agg(F.count_if(~F.col("test")).alias("imports"), F.count_if("test").alias("test_imports"), F.array_join(F.array_sort(F.collect_list("imported")), ",").alias("names"))


@query(f"WITH {SCORE_SQL} SELECT count(*) AS packages, count(DISTINCT {BY_SQL.format('package')}) AS projects, max(static_score) AS best FROM scored")
def root_totals(spark, sf_dir):
    return static(spark, sf_dir).agg(F.count("*").alias("packages"), F.countDistinct(paths.full_project(F.col("package"))).alias("projects"), F.max("static_score").alias("best"))


# --- merge, history, schedule ---------------------------------------------------------------------------------------

MERGE_SQL = ACTIONS_SQL + """, merged AS (SELECT package, max_by(last_updated, (last_updated, action = 'original')) FILTER (action <> 'delete') AS last_updated, max_by(stars, (last_updated, action = 'original')) FILTER (action <> 'delete') AS stars,
  CASE WHEN bool_or(action = 'delete') THEN 'deleted' WHEN NOT bool_or(action = 'original') THEN 'new' WHEN max_by(action, (last_updated, action = 'original')) FILTER (action <> 'delete') = 'original' THEN 'unchanged' ELSE 'updated' END AS status FROM actions GROUP BY package)"""


@query(f"WITH {MERGE_SQL} SELECT * FROM merged WHERE status <> 'deleted'")
def merge_docs(spark, sf_dir):
    return merge.live(merge.merge(v.actions(spark, sf_dir), "stars"))


@query(f"WITH {MERGE_SQL} SELECT status, count(*) AS n FROM merged GROUP BY status")
def merge_counts(spark, sf_dir):
    return merge.counters(merge.merge(v.actions(spark, sf_dir), "stars"))


@query(f"WITH {MERGE_SQL} SELECT package FROM merged WHERE NOT regexp_matches(package, '(7$)|(/n1)')")
def non_store_filter(spark, sf_dir):
    return merge.drop_matching(merge.merge(v.actions(spark, sf_dir), "stars"), ["7$", "/n1"]).select("package")


@query(f"WITH {HISTORY_SQL} SELECT key, ts, action, rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn FROM history WHERE action <> 'None') WHERE rn <= 10")
def history_latest10(spark, sf_dir):
    return history.latest(v.history(spark, sf_dir)).select("key", "ts", "action", F.col("rn").cast("long").alias("rn"))


@query(f"WITH {HISTORY_SQL} SELECT key, min(ts) AS found_time, min_by(event_id, (ts, event_id)) AS found_event, count(*) FILTER (action <> 'None') AS events, max(ts) FILTER (action = 'Success') AS latest_success, max(ts) FILTER (action = 'Failed') AS latest_failed FROM history GROUP BY key")
def history_summary(spark, sf_dir):
    return history.summary(v.history(spark, sf_dir))


@query(f"WITH {CRAWL_SQL} SELECT id, version FROM crawl WHERE version <> 5 OR schedule_time <= {NOW_SQL}")
def crawl_due(spark, sf_dir):
    return schedule.due(v.crawl_entries(spark, sf_dir), F.lit(NOW)).select("id", "version")


QUEUE_SQL = CRAWL_SQL + f""", known AS (SELECT id FROM crawl WHERE k % 4 = 0), q AS (SELECT id, host, schedule_time, id IN (SELECT id FROM known) AS in_docs FROM crawl WHERE (version <> 5 OR schedule_time <= {NOW_SQL}) AND NOT contains(id, '/vendor/') AND host IN ('github.com', 'bitbucket.org'))"""


def known(spark, sf_dir):
    return v.crawl_entries(spark, sf_dir).filter("k % 4 = 0").select(F.col("id").alias("package"))


def queued(spark, sf_dir):
    return schedule.queue(v.crawl_entries(spark, sf_dir), known(spark, sf_dir), F.lit(NOW), ["github.com", "bitbucket.org"])


@query(f"WITH {QUEUE_SQL} SELECT id, host, in_docs, row_number() OVER (PARTITION BY host ORDER BY in_docs, schedule_time, id) AS place FROM q")
def crawl_queue(spark, sf_dir):
    return schedule.ordered(queued(spark, sf_dir)).select("id", "host", "in_docs", F.col("place").cast("long").alias("place"))


@query(f"WITH {QUEUE_SQL}, a AS (SELECT *, date_diff('second', schedule_time, {NOW_SQL}) / 3600.0 AS age FROM q) SELECT host, round(max(age), 6) AS max_age, min_by(id, (-age, id)) AS max_id, round(avg(age), 6) AS mean_age, count(*) AS n, count(*) FILTER (NOT in_docs) AS n_new FROM a GROUP BY host")
def crawl_age_stats(spark, sf_dir):
    return schedule.age_statistics(queued(spark, sf_dir), F.lit(NOW)).withColumns({c: F.round(c, 6) for c in ("max_age", "mean_age")})


@query(f"WITH {CRAWL_SQL}, found AS (SELECT DISTINCT CASE WHEN k % 5 = 0 THEN 'new.org/' || CAST(k AS VARCHAR) ELSE id END AS id FROM crawl WHERE k % 3 = 0) SELECT f.id FROM found f LEFT JOIN crawl c ON f.id = c.id WHERE NOT (c.schedule_time IS NOT NULL AND (c.schedule_time < {NOW_SQL} OR c.k % 4 = 0))")
def append_new(spark, sf_dir):
    entries = v.crawl_entries(spark, sf_dir)
    found = entries.filter("k % 3 = 0").select(F.when(F.col("k") % 5 == 0, F.concat(F.lit("new.org/"), F.col("k"))).otherwise(F.col("id")).alias("id"))
    return schedule.append_new(entries, found, known(spark, sf_dir), F.lit(NOW)).select("id")


@query(f"WITH {CRAWL_SQL} SELECT id, CASE WHEN k % 3 = 0 THEN least(schedule_time, {NOW_SQL}) ELSE schedule_time END AS schedule_time, version FROM crawl")
def push_entries(spark, sf_dir):
    entries = v.crawl_entries(spark, sf_dir)
    return schedule.push(entries, entries.filter("k % 3 = 0").select("id"), F.lit(NOW)).select("id", "schedule_time", "version")


@query(f"WITH {CRAWL_SQL} SELECT id, CASE WHEN k % 7 = 0 THEN {NOW_SQL} ELSE schedule_time END AS schedule_time FROM crawl WHERE k % 11 <> 0")
def state_upsert_delete(spark, sf_dir):
    entries = v.crawl_entries(spark, sf_dir).select("id", "schedule_time", "k")
    new = entries.filter("k % 7 = 0").withColumn("schedule_time", F.lit(NOW))
    return schedule.delete(schedule.upsert(entries, new), entries.filter("k % 11 = 0")).select("id", "schedule_time")


@query(f"WITH {CRAWL_SQL} SELECT id, schedule_time - INTERVAL 10 DAY AS found_time, 'unknown' AS found_way FROM crawl WHERE k % 2 = 0")
def fill_found(spark, sf_dir):
    entries = v.crawl_entries(spark, sf_dir).filter("k % 2 = 0")
    old = entries.select(F.col("id").alias("key"), F.lit(None).cast("timestamp").alias("found_time"), F.lit("").alias("found_way"))
    return history.fill_found(old.withColumn("found_time", F.col("found_time").cast(entries.schema["schedule_time"].dataType)), entries).select(F.col("key").alias("id"), "found_time", "found_way")


# --- repositories ---------------------------------------------------------------------------------------------------

REPO_SQL = f"(SELECT o_orderkey AS k, 'r' || CAST(o_orderkey AS VARCHAR) AS name, 'u' || CAST(o_custkey AS VARCHAR) AS owner, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS crawl_time, o_orderdate + INTERVAL 3 DAY AS updated FROM orders)"


def repo_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("r"), k).alias("name"), F.concat(F.lit("u"), F.col("o_custkey")).alias("user"), F.when(k % 50 != 0, F.col("o_orderdate")).alias("crawl_time"), (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("updated"))


@query(f"SELECT name, owner, crawl_time FROM {REPO_SQL} ORDER BY crawl_time ASC NULLS FIRST, name || owner DESC LIMIT 1000")
def repo_select(spark, sf_dir):
    """The thousand most overdue repositories: the feature is a top-k."""
    return repos.most_overdue(repo_rows(spark, sf_dir), 1000).select("name", F.col("user").alias("owner"), "crawl_time")


@query(f"SELECT k, crawl_time IS NULL OR crawl_time < {NOW_SQL} - INTERVAL 1 DAY AS need FROM {REPO_SQL}")
def need_crawl(spark, sf_dir):
    return repo_rows(spark, sf_dir).select("k", repos.need_crawl(F.col("crawl_time"), F.lit(NOW)).alias("need"))


@query(f"""SELECT k, CASE WHEN crawl_time IS NULL THEN 'OutOfDate' WHEN crawl_time + INTERVAL 2 DAY > {NOW_SQL} - INTERVAL 10 DAY THEN CASE WHEN updated > crawl_time THEN 'OutOfDate' ELSE 'UpToDate' END
  WHEN crawl_time > {NOW_SQL} - INTERVAL 5 DAY THEN 'UpToDate' ELSE 'OutOfDate' END AS status FROM {REPO_SQL}""")
def package_status(spark, sf_dir):
    info = F.col("crawl_time") + F.expr("INTERVAL 2 DAYS")
    return repo_rows(spark, sf_dir).select("k", repos.status(F.col("crawl_time"), info, F.col("updated"), F.lit(NOW)).alias("status"))


@query(f"SELECT k, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'old' END AS signature, CASE WHEN k % 4 = 0 THEN crawl_time ELSE {NOW_SQL} END AS crawl_time FROM {REPO_SQL} WHERE NOT (k % 4 <> 0 AND k % 10 = 1) AND k % 4 <> 0 UNION ALL SELECT k, 'old', crawl_time FROM {REPO_SQL} WHERE k % 4 = 0")
def repo_unchanged(spark, sf_dir):
    rows = repo_rows(spark, sf_dir).withColumns({"site": F.lit("github.com"), "signature": F.lit("old"), "packages": F.col("k")})
    crawled = rows.filter("k % 4 <> 0").select("site", "user", "name", F.when(F.col("k") % 3 == 0, "new").otherwise("old").alias("signature"), "packages", (F.col("k") % 10 != 1).alias("found"))
    out = repos.refreshed(rows, crawled, F.lit(NOW).cast(rows.schema["crawl_time"].dataType))
    return out.select(F.col("packages").alias("k"), "signature", "crawl_time")


# words of parts as they are, with a sign or number that rules them out, and each of the names that hold no packages
FOLDERS = Given(
    "part", k="p_partkey",
    folder="CASE p_partkey % 9 WHEN 0 THEN lower(p_type) WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN concat(split_part(p_name, ' ', 2), p_partkey % 7) WHEN 3 THEN concat('_', lower(p_type)) WHEN 4 THEN concat(lower(p_type), '.v', p_size) "
    "WHEN 5 THEN concat(p_size, '-', p_partkey) WHEN 6 THEN concat('on', 'nodejs', p_size) WHEN 7 THEN concat(p_size, 'th') ELSE element_at(array_of_names, CAST(p_partkey % n_names AS INTEGER) + 1) END".replace("array_of_names", "{names}").replace("n_names", str(len(repos.NOT_SOURCE))),
)
_names = ", ".join(f"'{x if i % 2 else x.upper()}'" for i, x in enumerate(repos.NOT_SOURCE))
FOLDERS = Given("part", **{c: e.replace("{names}", f"array({_names})") for c, e in FOLDERS.columns.items()})
FOLDERS_SQL = FOLDERS.sql.replace(f"array({_names})", f"[{_names}]").replace("element_at", "list_extract")


@query(rf"SELECT k, NOT lower(folder) IN ({', '.join(repr(x) for x in repos.NOT_SOURCE)}) AND NOT regexp_full_match(lower(folder), '[0-9_-]+') AND NOT contains(folder, '.') AND regexp_matches(lower(folder), '^[a-z]') AND NOT contains(lower(folder), 'nodejs') AS source FROM {FOLDERS_SQL}")
def subfolder(spark, sf_dir):
    return FOLDERS.rows(spark, sf_dir).select("k", repos.like_source_folder(F.col("folder")).alias("source"))


READMES = Given("part", k="p_partkey", f="CASE p_partkey % 6 WHEN 0 THEN 'readme' WHEN 1 THEN concat('README.', lower(p_type)) WHEN 2 THEN concat('ReadMe.', p_size, '.md') WHEN 3 THEN concat(lower(p_type), '.md') WHEN 4 THEN concat('readme', p_size) ELSE 'ReadMe.' END")


@query(rf"SELECT k, lower(regexp_replace(f, '\.[^.]*$', '')) = 'readme' AS readme FROM {READMES.sql}")
def readme_file(spark, sf_dir):
    return READMES.rows(spark, sf_dir).select("k", repos.is_readme(F.col("f")).alias("readme"))


BROKEN_SQL = f"""(SELECT p_partkey AS k, 'github.com/u/r/' || a || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '/js' WHEN 2 THEN '/' || b || '/' || a WHEN 3 THEN '/' || b || '/' || p_partkey ELSE '/' || b || '/x/' || a || '/' || b END AS id
  FROM (SELECT p_partkey, lower(p_type) AS a, split_part(p_name, ' ', 2) AS b FROM part))"""
NOT_SOURCE_SQL = ", ".join(repr(x) for x in repos.NOT_SOURCE)


@query(rf"""SELECT id FROM (SELECT id, k, string_split(id, '/') AS s FROM {BROKEN_SQL}) WHERE k % 7 <> 0 AND (lower(s[-1]) IN ({NOT_SOURCE_SQL}) OR regexp_full_match(lower(s[-1]), '[0-9_-]+') OR contains(s[-1], '.') OR NOT regexp_matches(lower(s[-1]), '^[a-z]') OR contains(lower(s[-1]), 'nodejs')
  OR (len(s) = 6 AND s[4] = s[6]) OR (len(s) = 8 AND s[4:5] = s[7:8]))""")
def broken_path(spark, sf_dir):
    k, a, b = F.col("p_partkey"), F.lower("p_type"), F.get(F.split("p_name", " "), F.lit(1))
    tail = F.when(k % 5 == 0, "").when(k % 5 == 1, "/js").when(k % 5 == 2, F.concat(F.lit("/"), b, F.lit("/"), a)).when(k % 5 == 3, F.concat(F.lit("/"), b, F.lit("/"), k)).otherwise(F.concat(F.lit("/"), b, F.lit("/x/"), a, F.lit("/"), b))
    rows = table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("github.com/u/r/"), a, tail).alias("id"))
    docs = rows.filter("k % 7 = 0").select(F.concat(F.col("id"), F.lit("#"), F.col("k")).alias("package"))
    rows = rows.select(F.when(F.col("k") % 7 == 0, F.concat(F.col("id"), F.lit("#"), F.col("k"))).otherwise(F.col("id")).alias("id"))
    return schedule.broken(rows, docs, repos.like_source_folder)


TAGS = Given("events", k="event_id", tags="concat(CASE event_id % 3 WHEN 0 THEN '' ELSE '!' END, CASE event_id % 5 WHEN 0 THEN 'linux' WHEN 1 THEN 'darwin' WHEN 2 THEN '386' WHEN 3 THEN 'cgo' ELSE concat('go1.', event_id % 20) END, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ',cgo' ELSE concat(',', event_type) END)")


@query(f"SELECT k, len(list_filter(string_split(tags, ','), lambda t: NOT ltrim(t, '!') IN ('linux', '386', 'darwin', 'cgo') AND NOT starts_with(ltrim(t, '!'), 'go'))) > 0 AS ignored FROM {TAGS.sql}")
def build_tags(spark, sf_dir):
    return TAGS.rows(spark, sf_dir).select("k", repos.build_ignored(F.split("tags", ",")).alias("ignored"))


@query("SELECT s_suppkey, CASE WHEN a < 0 THEN b WHEN b < 0 THEN a WHEN least(a, b) <= greatest(a, b) // 3 THEN greatest(a, b) ELSE (a + b) * 3 // 4 END AS stars FROM (SELECT s_suppkey, s_suppkey % 40 - 2 AS a, s_suppkey * 7 % 60 - 3 AS b FROM supplier)")
def fuse_stars(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", scores.fuse_stars(k % 40 - 2, k * 7 % 60 - 3).alias("stars"))


LENGTHS = Given("orders", k="o_orderkey", n="CASE o_orderkey % 5 WHEN 0 THEN o_orderstatus WHEN 1 THEN '' WHEN 2 THEN concat('-', o_orderkey) ELSE concat('', o_orderkey % 150) END")


@query(f"SELECT k, least(greatest(coalesce(try_cast(n AS INTEGER), 0), 20), 100) AS length FROM {LENGTHS.sql}")
def clamp_len(spark, sf_dir):
    return LENGTHS.rows(spark, sf_dir).select("k", scores.list_length(F.col("n")).alias("length"))


LEADING_SQL = "(SELECT * FROM crawl WHERE starts_with(id, 'github.com/') OR starts_with(id, 'bitbucket.org/'))"


def crawled(spark, sf_dir):
    k = F.col("k")
    return v.crawl_entries(spark, sf_dir).select(F.col("id").alias("package"), F.concat(F.lit("u"), k % 50).alias("author"), F.array(F.concat(F.lit("imp/"), k)).alias("imports"), F.array(F.concat(F.lit("test/"), k)).alias("test_imports"), F.when(k % 3 == 0, F.array(F.concat(F.lit("ref/"), k % 10))).otherwise(F.array().cast("array<string>")).alias("references"))


@query(f"WITH {CRAWL_SQL} SELECT DISTINCT n_path AS package, way AS found_way FROM (SELECT 'imp/' || k AS n_path, 'impoted:' || id AS way FROM {LEADING_SQL} UNION ALL SELECT 'test/' || k, 'testimported:' || id FROM {LEADING_SQL} UNION ALL SELECT 'ref/' || k % 10, 'reference:' || id FROM {LEADING_SQL} WHERE k % 3 = 0)")
def related_packages(spark, sf_dir):
    return history.related(crawled(spark, sf_dir))


@query(f"WITH {CRAWL_SQL} SELECT DISTINCT host || ':u' || k % 50 AS id, host AS site, 'u' || k % 50 AS name FROM {LEADING_SQL}")
def related_persons(spark, sf_dir):
    return history.related_persons(crawled(spark, sf_dir))


TREE_SQL = """(SELECT CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE '/f' || l_suppkey END AS folder, 'x' || l_orderkey || '_' || l_linenumber || '.go' AS file, CASE WHEN l_linenumber = 7 AND l_orderkey % 97 = 0 THEN 'ParseFailed' WHEN l_linenumber = 6 THEN 'ShouldIgnore' ELSE 'ParseSuccess' END AS status,
  CASE WHEN l_suppkey % 3 = 0 THEN 'p' || l_orderkey % 2 WHEN l_suppkey % 7 = 1 THEN '' ELSE 'p' END AS name, CASE WHEN l_orderkey % 50 = 1 THEN 'doc ' || l_partkey ELSE '' END AS description, 'm.org/' || l_partkey % 30 AS import, l_linestatus = 'F' AS is_test FROM lineitem)"""


@query(f"""SELECT folder, CASE WHEN len(names) = 1 THEN names[1] END AS name, coalesce(description, '') AS description, array_to_string(list_sort(coalesce(i, [])), ',') AS imports, array_to_string(list_sort(coalesce(t, [])), ',') AS test_imports,
  CASE WHEN failed THEN 'parse failed' WHEN len(names) = 0 THEN 'no name' WHEN len(names) > 1 THEN 'conflicting names' END AS error
  FROM (SELECT folder, coalesce(list(DISTINCT name) FILTER (NOT is_test AND name <> ''), []) AS names, string_agg(description, chr(10) ORDER BY file, description) FILTER (description <> '') AS description, list(DISTINCT import) FILTER (NOT is_test) AS i, list(DISTINCT import) FILTER (is_test) AS t, bool_or(status = 'ParseFailed') AS failed
  FROM {TREE_SQL} WHERE status <> 'ShouldIgnore' GROUP BY folder)""")
def tree_folders(spark, sf_dir):
    li, n = table(spark, sf_dir, "lineitem"), lambda c: F.col(f"l_{c}")
    folder = F.when(n("suppkey") % 10 == 0, "").otherwise(F.concat(F.lit("f"), n("suppkey"), F.lit("/")))
    rows = li.select(
        F.concat(folder, F.lit("x"), n("orderkey"), F.lit("_"), n("linenumber"), F.lit(".go")).alias("path"),
        F.when((n("linenumber") == 7) & (n("orderkey") % 97 == 0), "ParseFailed").when(n("linenumber") == 6, "ShouldIgnore").otherwise("ParseSuccess").alias("status"),
        F.when(n("suppkey") % 3 == 0, F.concat(F.lit("p"), n("orderkey") % 2)).when(n("suppkey") % 7 == 1, "").otherwise("p").alias("name"),
        F.when(n("orderkey") % 50 == 1, F.concat(F.lit("doc "), n("partkey"))).otherwise("").alias("description"), F.array(F.concat(F.lit("m.org/"), n("partkey") % 30)).alias("imports"), (n("linestatus") == "F").alias("is_test"),
    )
    return repos.folders(rows).withColumns({c: F.array_join(c, ",") for c in ("imports", "test_imports")})


# --- sources and metrics --------------------------------------------------------------------------------------------


@query("SELECT event_type AS name, CASE event_type WHEN 'click' THEN 'sum' WHEN 'view' THEN 'max' ELSE 'average' END AS method, round(CASE event_type WHEN 'click' THEN sum(value) WHEN 'view' THEN max(value) ELSE avg(value) END, 4) AS value FROM events GROUP BY event_type")
def bi_rollup(spark, sf_dir):
    method = F.when(F.col("event_type") == "click", "sum").when(F.col("event_type") == "view", "max").otherwise("average")
    return tops.rollup(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), method.alias("method"), "value")).withColumn("value", F.round("value", 4))


@query("SELECT count(*) FILTER (value <= 1) AS within_1, count(*) FILTER (value > 1) AS over_1, count(*) FILTER (value > 10) AS over_10, count(*) FILTER (value > 100) AS over_100 FROM events")
def latency_buckets(spark, sf_dir):
    return tops.latency(table(spark, sf_dir, "events"), "value")


@query("""SELECT unnest(json_extract_string(js, '$[*]')) AS package FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN '[]' ELSE '["a.org/' || p_partkey || '", "b.org/' || p_size || '"]' END AS js FROM part)""")
def json_links(spark, sf_dir):
    js = F.when(F.col("p_partkey") % 4 == 0, "[]").otherwise(F.concat(F.lit('["a.org/'), "p_partkey", F.lit('", "b.org/'), "p_size", F.lit('"]')))
    return snapshots.links(table(spark, sf_dir, "part").select(js.alias("js")), "js")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT CAST(max(o_orderkey) FILTER (o_orderkey % 3 <> 0) AS VARCHAR) AS name FROM orders")
def segment_max(spark, sf_dir):
    names = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))
    return snapshots.newest(table(spark, sf_dir, "orders").select(names.alias("name")))


# --- the store ------------------------------------------------------------------------------------------------------

STORE_SQL = "store AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'github.com' WHEN 'O' THEN 'bitbucket.org' ELSE 'example.org' END AS site, 'u' || o_custkey AS usr, 'r' || o_orderkey AS name, o_orderkey AS k, o_custkey AS stars FROM orders)"


def stored(spark, sf_dir):
    return v.crawl_entries(spark, sf_dir).select(F.col("host").alias("site"), "k").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("stars")), "k").select("site", F.concat(F.lit("u"), "stars").alias("user"), F.concat(F.lit("r"), "k").alias("name"), F.concat_ws("/", F.concat(F.lit("u"), "stars"), F.concat(F.lit("r"), "k")).alias("path"), "k", "stars")


@query(f"WITH {STORE_SQL} SELECT site, row_number() OVER (ORDER BY site) AS place FROM (SELECT DISTINCT site FROM store)")
def store_sites(spark, sf_dir):
    """Sites in order, with their place (there are few)."""
    return store.sites(stored(spark, sf_dir)).withColumn("place", F.row_number().over(Window.orderBy("site")).cast("long"))


@query(f"WITH {STORE_SQL} SELECT usr || '/' || name AS path, stars, row_number() OVER (ORDER BY usr || '/' || name) - 1 AS place FROM store WHERE site = 'example.org'")
def store_packages_of_site(spark, sf_dir):
    rows = store.packages_of(stored(spark, sf_dir), "example.org").select("path", "stars")
    return graph.placed(rows, [F.asc("path")]).select("path", "stars", F.col("place").cast("long").alias("place"))


@query(f"WITH {STORE_SQL} SELECT usr AS owner, name, k, row_number() OVER (ORDER BY usr, name) - 1 AS place FROM store WHERE site = 'bitbucket.org'")
def store_repositories_of_site(spark, sf_dir):
    rows = store.repositories_of(stored(spark, sf_dir), "bitbucket.org").select(F.col("user").alias("owner"), "name", "k")
    return graph.placed(rows, [F.asc("owner"), F.asc("name")]).select("owner", "name", "k", F.col("place").cast("long").alias("place"))


@query(f"WITH {STORE_SQL} SELECT site, usr || '/' || name AS path, CASE WHEN k % 3 = 0 THEN stars + k ELSE stars END AS stars FROM store UNION ALL SELECT 'new.org', 'n' || k, k FROM store WHERE k % 30 = 0")
def store_update(spark, sf_dir):
    """Read, modify, write: every third record gets stars, and records that were not there come to be."""
    rows = stored(spark, sf_dir)
    more = rows.filter("k % 3 = 0").select("site", "path", F.col("k").alias("add")).unionByName(rows.filter("k % 30 = 0").select(F.lit("new.org").alias("site"), F.concat(F.lit("n"), "k").alias("path"), F.col("k").alias("add")))
    return store.update(rows.select("site", "path", "stars"), more, ["site", "path"], {"stars": F.coalesce("stars", F.lit(0)) + F.col("new.add")})


@query(f"WITH {STORE_SQL} SELECT name, site, stars, CASE WHEN k % 5 = 0 THEN 'delete' ELSE 'update' END AS action FROM (SELECT name, k, CASE WHEN k % 5 = 0 THEN NULL ELSE site END AS site, CASE WHEN k % 5 = 0 THEN NULL ELSE stars END AS stars FROM store)")
def packed_records(spark, sf_dir):
    """Records through their packed form and back; those to be deleted carry no value."""
    rows = stored(spark, sf_dir).select("name", F.when(F.col("k") % 5 == 0, "delete").otherwise("update").alias("action"), "site", "stars")
    return store.unpacked(store.packed(rows, "name"), "site string, stars long").select("name", "site", "stars", "action")


@query(rf"SELECT page_id, name AS package FROM (SELECT page_id, trim(pkg) AS name FROM {WEB_SQL}) WHERE regexp_full_match(name, '[^/\s]*[^/\s.]\.[^/\s.][^/\s]*(/[^/\s]+)*')")
def submitted_lines(spark, sf_dir):
    """Lines of the add page: the paths of the pages that are valid packages."""
    lines = web(spark, sf_dir).select("page_id", F.concat(F.lit(" "), "pkg", F.lit(" ")).alias("line"))
    return lines.select("page_id", paths.trim_name(F.col("line")).alias("package")).join(store.from_lines(lines).distinct(), "package").select("page_id", "package")


@query(f"WITH {HISTORY_SQL} SELECT key, ts, action, rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT 'pkg/' || key AS key, ts, event_id, action FROM history WHERE key = 7) WHERE action <> 'None') WHERE rn <= 10")
def crawl_history(spark, sf_dir):
    """The history page of one package, asked for in capitals."""
    events = v.history(spark, sf_dir).withColumn("key", F.concat(F.lit("pkg/"), "key"))
    found = events.select("key").distinct().withColumns({"found_time": F.lit(NOW), "found_way": F.lit("web")})
    rows = history.lookup(found, events, " PKG/7").select("key", F.posexplode("events").alias("rn", "e"))
    return rows.select("key", "e.ts", "e.action", (F.col("rn") + 1).cast("long").alias("rn"))


RESULTS_SQL = "results AS (SELECT o_custkey % 8 AS part, o_orderkey AS seq, TIMESTAMP '1999-06-17 00:00:00' + to_seconds(o_orderkey // 8) AS due, CASE o_orderpriority[1] WHEN '1' THEN 'ok' WHEN '2' THEN 'invalid' ELSE 'failed' END AS outcome, o_orderkey % 101 = 0 AS forbidden FROM orders)"


@query(f"""WITH RECURSIVE {RESULTS_SQL}, live AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seq) AS i FROM (SELECT *, max(due > TIMESTAMP '1999-06-17 00:02:00') OVER (PARTITION BY part ORDER BY seq) AS late FROM results) WHERE NOT late),
walk AS (SELECT part, i, seq, outcome, CAST(0 AS BIGINT) + CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END AS fails, outcome = 'failed' AND forbidden AS pauses FROM live WHERE i = 1
  UNION ALL SELECT l.part, l.i, l.seq, l.outcome, CASE WHEN l.outcome = 'ok' THEN 0 ELSE CASE WHEN w.pauses THEN 0 ELSE w.fails END + CASE WHEN l.outcome = 'failed' THEN 1 ELSE 0 END END,
    l.outcome = 'failed' AND (l.forbidden OR CASE WHEN w.pauses THEN 0 ELSE w.fails END + 1 >= 10) FROM walk w JOIN live l ON l.part = w.part AND l.i = w.i + 1)
SELECT seq, CASE outcome WHEN 'ok' THEN 'update' WHEN 'invalid' THEN 'delete' END AS action, CASE outcome WHEN 'ok' THEN 'Success' WHEN 'invalid' THEN 'Invalid' ELSE 'Failed' END AS event, CASE outcome WHEN 'ok' THEN 'age' WHEN 'failed' THEN 'failure' END AS next, pauses FROM walk""")
def crawl_outcomes(spark, sf_dir):
    """What follows from the results of a crawl in eight parts, up to its deadline."""
    k, word = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(NOW)) + F.floor(k / 8))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("part"), k.alias("seq"), at.alias("at"), F.when(word == "1", "ok").when(word == "2", "invalid").otherwise("failed").alias("outcome"), (k % 101 == 0).alias("forbidden"))
    return schedule.outcomes(rows, F.lit(NOW) + F.expr("INTERVAL 2 MINUTES")).select("seq", "action", "event", "next", "pauses")


@query(f"WITH {CRAWL_SQL} SELECT count(*) FILTER (contains(id, '/vendor/')) AS vendors FROM crawl WHERE version <> 5 OR schedule_time <= {NOW_SQL}")
def vendor_drops(spark, sf_dir):
    return schedule.skipped(v.crawl_entries(spark, sf_dir), F.lit(NOW))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 10 = 0 THEN 'kept ' ELSE 'read ' END || l_partkey AS info FROM lineitem")
def cache_lookup(spark, sf_dir):
    """Contents of the lines' parts: from the cache for every tenth part, else read anew, each once."""
    cache = table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("sha"), F.concat(F.lit("kept "), "p_partkey").alias("info"))
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("sha"))
    out, _ = snapshots.cached(files, cache, lambda d: d.withColumn("info", F.concat(F.lit("read "), "sha")))
    return out.select("l_orderkey", "l_linenumber", F.col("sha").alias("l_partkey"), "info")


@query("SELECT count(*) FILTER (l_partkey % 10 = 0) AS hit, count(*) FILTER (l_partkey % 10 <> 0) AS missed, count(DISTINCT l_partkey) FILTER (l_partkey % 10 <> 0) AS sign_saved FROM lineitem")
def cache_counts(spark, sf_dir):
    cache = table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("sha"), F.lit("").alias("info"))
    return snapshots.cache_counts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sha")), cache)


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (1, 7, 100, 500)")
def dump_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey").isin(1, 7, 100, 500)).select("l_orderkey", "l_linenumber", "l_quantity")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_scored(spark, sf_dir)
