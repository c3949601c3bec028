"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every count of a text comes from one nested expression; there is no shuffle and
no user function. Repeated passages are found by hashing each window of eight
words (64 bits over the words themselves), so a document with no equal hashes
costs one pass; otherwise hashes are sorted with their positions, and windows of
equal hash are compared word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, text_of, unused

WINDOW = 8
# Frequent words of four languages.
STOP_WORDS = (
    "the of and to in is that it for on with as was be are this by at from or an have not "
    "le la les de des du et un une que qui dans en pour par sur est au aux "
    "der die das und den von zu mit ist nicht auf für im dem ein eine sich "
    "el los las del y se con una su es al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a document if ``scale * metric`` is below ``least`` or above ``most`` times ``per``."""

    name: str
    metric: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


BASE = (Rule("few_words", "n_words", least=20), Rule("repeated_words", "n_repeat_words", "n_words", most=0.30))
RULES = (
    Rule("short_or_long_words", "word_chars", "n_words", least=2.0, most=20.0),
    Rule("symbols", "n_symbols", "n_words", most=0.15),
    Rule("shouting", "n_shouts", "n_words", most=0.15),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.40),
    Rule("no_stop_words", "n_stop_words", "n_words", least=0.02),
)


def covered(hashes: Column, words: Column) -> Column:
    """Words covered by windows that occur twice or more, from the window hashes in order of position.

    Windows are sorted by their whole hash, then position; neighbours of equal
    hash count if their words are equal too.
    """

    def positions(k: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            other = F.get(k, j)
            return F.coalesce((x["h"] == other["h"]) & (F.slice(words, x["p"] + 1, F.lit(WINDOW)) == F.slice(words, other["p"] + 1, F.lit(WINDOW))), F.lit(False))

        return F.transform(F.filter(k, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"].cast("long"))

    return F.aggregate(
        F.sort_array(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), positions)),
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("to"), (a["n"] + WINDOW - F.greatest(a["to"] - p, F.lit(0).cast("long"))).alias("n")),
        lambda a: a["n"],
    )


def repeated_words(words: Column) -> Column:
    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes, words))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, of))


def metrics(text: Column) -> Column:
    """Struct of all counts of a text that is not null."""

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(rf"[^{SPACE}]"))
        line_counts = let(lines, lambda s: F.struct(F.size(s).alias("n"), (F.size(s) - F.size(F.array_distinct(s))).alias("dup")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            line_counts.alias("lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.regexp_count(text, F.lit("!!")).cast("long").alias("n_shouts"),
        )

    return let(F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0)), counts)


def fails(rule: Rule) -> Column:
    value = F.col(rule.metric)
    per = F.col(rule.per) if rule.per else F.lit(1)
    out = F.lit(False)
    if rule.least is not None:
        out = out | (100 * value < round(100 * rule.least, 6) * per)
    if rule.most is not None:
        out = out | (100 * value > round(100 * rule.most, 6) * per)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_shouts")


def apply_rules(docs: DataFrame, text_col: str = "text", base=BASE, rules=RULES, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all) plus the counts, ``failed_rules``, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rules. Repeated rows
    each get their verdict; an empty table gives no rows; texts of any length
    are counted whole. Columns of the input that have the name of a result
    column are replaced.
    """
    own = (*COUNTS, "failed_rules", "base_failed", "kept")
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in own]
    kept = [F.col(f"`{c}`") for c in names]
    (m,) = unused([*names, *own], "counts_")
    out = docs.select(*kept, metrics(text_of(text_col)).alias(m))
    out = out.select(
        *kept, *[F.col(f"{m}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols")], F.col(f"{m}.lines.dup").cast("long").alias("n_dup_lines"),
        F.col(f"{m}.n_repeat_words").alias("n_repeat_words"), F.col(f"{m}.lines.n").cast("long").alias("n_lines"), F.col(f"{m}.n_stop_words").alias("n_stop_words"), F.col(f"{m}.n_shouts").alias("n_shouts"),
    )
    bad = [F.when(fails(r), F.lit(r.name)) for r in (*base, *rules)]
    out = out.withColumn("failed_rules", F.filter(F.array(*bad), lambda x: x.isNotNull()))
    any_of = lambda rs: F.arrays_overlap("failed_rules", F.array(*[F.lit(r.name) for r in rs])) if rs else F.lit(False)
    return out.withColumn("base_failed", any_of(base)).withColumn("kept", F.size("failed_rules") == 0)
