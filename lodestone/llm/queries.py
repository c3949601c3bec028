"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, decontam, late, licenses, minhash, mixing, packing, pii, quality_classifier, quality_rules, retrieval, sharding, toxicity
from .common import held_out, text_of, word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules.apply_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(list_filter(w, lambda x: list_contains([STOPS], lower(x)))) AS BIGINT) AS n_stop_words, CAST(len(regexp_extract_all(t, '!!')) AS BIGINT) AS n_shouts
  FROM d LEFT JOIN cover USING (doc_id)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_symbols > 15 * n_words OR 100 * n_shouts > 15 * n_words
    OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_stop_words < 2 * n_words) AS kept
FROM f
""".replace("[STOPS]", "[" + ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS) + "]")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix_documents(docs, word_count(text_of("text")), carry=["doc_id"])
    return mixed.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", decontam.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), decontam.is_contaminated().alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)
), hits AS (SELECT doc_id, item_id, dw.m, i FROM dw JOIN bw USING (m, k)),
per_word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
per_item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat.examples(turns.unionByName(extra))
    digest = F.sha2(F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    read = made.select(
        "conv_id", "example", "n_turns", chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"), F.length("formatted").cast("long").alias("chars"),
        F.when(F.lead("example").over(Window.partitionBy("conv_id").orderBy("example")).isNull(), digest).alias("digest"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    out = read.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("digest").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _escaped(c: str) -> str:
    return f"regexp_replace({c}, '([<\\[])(\\\\*)(/?(?:s>|TURN\\]|INST\\]))', '\\1\\2\\\\\\3', 'g')"


OP5_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    3 + sum(length({_escaped("role")}) + length({_escaped("text")}) + 17) OVER w AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_private"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), t AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY item_id, term),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), t GROUP BY item_id, doc_id
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


def with_copies(sales: DataFrame) -> DataFrame:
    """``sales`` and the later copies that its contract adds."""
    kinds = {f.name: f.dataType for f in sales.schema.fields}
    h, day = F.crc32(F.col("sale_id").cast("string").cast("binary")), F.floor(late.micros("sold_at", kinds["sold_at"]) / F.lit(late.DAY).cast("decimal(20,0)"))
    again = sales.filter((h % 3 == 0) & (day % 7 == 0))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    moved = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)}
    return sales.unionByName(again.select(*[moved.get(c, F.col(c)).alias(c) for c in sales.columns]))


def op13_late_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    size = 1 + sales.count() // 700
    root, cutoff = late.new_folder(spark, "late-sales"), int(datetime(2024, 4, 10, tzinfo=UTC).timestamp()) * 1_000_000
    touched = late.lay_out(with_copies(sales), cutoff, size, root)
    return late.describe(spark, root, sales.schema, touched)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_minhash": op3_minhash,
    "op4_decontamination": op4_decontamination,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_sharding": op8_sharding,
    "op9_licenses": op9_licenses,
    "op10_pii": op10_pii,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_ranked_search": op12_ranked_search,
    "op13_late_partitions": op13_late_partitions,
}
ORACLE = {"op1_quality_rules": OP1_SQL, "op4_decontamination": OP4_SQL, "op5_chat": OP5_SQL, "op12_ranked_search": OP12_SQL}
