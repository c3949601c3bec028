"""What a package is, as column expressions: sentences chosen by wording and by a pattern made of each row's names.

``sentences`` has the wording. The pattern of a row is built from the endings of
its path and from its name, and matched as a column. ``chosen_sql`` says the same
in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sentences
from .stemming import let, stem, stem_sql
from .tokens import tokens_among

#: Wording that tells by itself, from the start, at the end or of the whole sentence.
WORDING = f"^(?:{'|'.join(sentences.PREFIXES)})|{sentences.SUFFIX.pattern}|^(?:{sentences.WRAP.pattern})$"
SIGNS = r"([!-/:-@\[-`{-~])"
BEFORE, BEHIND = rf"^(?:package )?(?:{sentences.THE} )?(?:", f")(?: package)?(?:{sentences.VERB})"
#: Runs of brackets between two blanks, of which one goes with them; all other brackets.
SPACED, BRACKETS = r" (?:(?:\([^)]*\))+ )+", r"\([^)]*\)"


#: White space at the ends of texts and lines, for Spark and for DuckDB.
SPACE, SPACE_SQL = r"[\s\x{85}\p{Z}\x1C-\x1F]", r"[\s\x{85}\p{Z}\x1C-\x1F\x0B]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, SIGNS, r"\\$1")


def without_brackets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SPACED, " "), BRACKETS, ""), r"^\s+|\s+$", "")


def loose(name: Column) -> Column:
    """A name with optional blanks between its letters; a last d or s, or a last -go, may be missing."""
    keep = F.when(name.rlike("[ds]$"), F.length(name) - 1).when(name.endswith("-go"), F.length(name) - 3).otherwise(F.length(name))
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c, i: F.concat(escaped(c), F.when(i >= keep, "?").otherwise(""))), " ?")


def name_pattern(name: Column, pkg: Column) -> Column:
    """What a sentence about a package begins with: an ending of its path, or its name, and a verb."""

    def of(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: escaped(F.array_join(F.slice(parts, i, F.size(parts)), "/")))
        ends = F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<string>"))
        named = F.when((name != "") & (F.lower(name) != last), F.array(F.concat(F.lit("(?:go )?"), loose(F.lower(name)), F.lit(r"(?:\.go)?")))).otherwise(F.array().cast("array<string>"))
        forms = F.concat(ends, F.array(F.concat(F.lit("(?:go )?"), loose(last), F.lit(r"(?:\.go)?"))), named)
        return F.concat(F.lit(BEFORE), F.array_join(forms, "|"), F.lit(BEHIND))

    return let(F.split(F.lower(pkg), "/"), of)


def chosen(text: Column, name: Column, pkg: Column) -> Column:
    """The sentences of a text that say what the package is, in order, without pictures."""
    empty = lambda c: F.coalesce(c, F.lit(""))

    def by(pattern: Column) -> Column:
        # regexp_instr keeps the row's compiled pattern from one sentence to the next, regexp_like compiles it for each
        says = lambda s: let(without_brackets(F.lower(s)), lambda low: low.rlike(WORDING) | (F.regexp_instr(low, pattern) > 0))
        return F.transform(F.filter(sentences.split_sentences(empty(text)), says), lambda s: F.regexp_replace(s, sentences.IMAGE, ""))

    return let(name_pattern(empty(name), empty(pkg)), by)


def chosen_sql(rows: str) -> str:
    """CTEs ending in ``chosen`` (k, i, sentence) of the statement ``rows`` (k, i, sentence, name, pkg), for DuckDB."""
    q = lambda x: x.replace("'", "''")
    esc = lambda c: f"regexp_replace({c}, '{q(SIGNS)}', '\\\\\\1', 'g')"

    def loose_(c: str) -> str:
        keep = f"CASE WHEN regexp_matches({c}, '[ds]$') THEN length({c}) - 1 WHEN ends_with({c}, '-go') THEN length({c}) - 3 ELSE length({c}) END"
        return f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: {esc(f'{c}[i]')} || CASE WHEN i > {keep} THEN '?' ELSE '' END), ' ?')"

    own = rf"'(?:go )?' || {loose_('l')} || '(?:\.go)?'"
    named = rf"CASE WHEN n <> '' AND n <> l THEN '|(?:go )?' || {loose_('n')} || '(?:\.go)?' ELSE '' END"
    ends = f"list_transform(range(1, len(ps)), lambda j: {esc("array_to_string(ps[j:], '/')")} || '|')"
    low = f"trim(regexp_replace(regexp_replace(lower(sentence), '{SPACED}', ' ', 'g'), '{q(BRACKETS)}', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
    return f"""given AS ({rows}), parts AS (SELECT k, string_split(lower(pkg), '/') AS ps, lower(name) AS n FROM (SELECT DISTINCT k, name, pkg FROM given)), lasts AS (SELECT *, ps[-1] AS l FROM parts),
patterns AS (SELECT k, '{q(BEFORE)}' || array_to_string({ends}, '') || {own} || {named} || '{q(BEHIND)}' AS pattern FROM lasts),
chosen AS (SELECT k, i, regexp_replace(sentence, '{q(sentences.IMAGE)}', '', 'g') AS sentence FROM (SELECT k, i, sentence, pattern, {low} AS low FROM given JOIN patterns USING (k)) WHERE regexp_matches(low, '{q(WORDING)}') OR regexp_matches(low, pattern))"""


#: Words that may be marked; what stands between them is shown as it is.
WORD = r"[A-Za-z]+|[0-9]+|\p{L}[A-Za-z]*|\p{N}[0-9]*"
# Signs that HTML writes in another way.
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def html(text: Column) -> Column:
    for sign, written in HTML:
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def marked(text: Column, tokens: list[str]) -> Column:
    """The text as HTML, with the words whose normal form is a query token in bold."""
    own = sorted(tokens)
    bold = lambda w: F.when(stem(w).isin(own), F.concat(F.lit("<b>"), html(w), F.lit("</b>"))).otherwise(html(w))
    found, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    # one gap more than words
    return F.array_join(F.zip_with(gaps, F.transform(found, bold), lambda g, w: F.concat(html(g), F.coalesce(w, F.lit("")))), "")


def marked_sql(rows: str, tokens: list[str]) -> str:
    """CTEs ending in ``marked`` (k, marked) of the statement ``rows`` (k, text), for DuckDB."""

    def escape(c: str) -> str:
        for sign, written in HTML:
            c = f"replace({c}, '{sign.replace(chr(39), chr(39) * 2)}', '{written}')"
        return c

    own = ", ".join(f"'{t}'" for t in sorted(tokens))
    return rf"""shown AS ({rows}), cut AS (SELECT k, regexp_extract_all(text, '{WORD}') AS ws, regexp_split_to_array(text, '{WORD}') AS gs FROM shown), word_at AS (SELECT k, i, ws[i] AS word FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM cut)),
{stem_sql("SELECT word FROM word_at")},
bits AS (SELECT k, 2 * i AS place, CASE WHEN stem IN ({own}) THEN '<b>' || {escape("word")} || '</b>' ELSE {escape("word")} END AS bit FROM word_at JOIN stems USING (word) UNION ALL SELECT k, 2 * i - 1, {escape("gs[i]")} FROM (SELECT k, gs, unnest(range(1, len(gs) + 1)) AS i FROM cut)),
marked AS (SELECT k, string_agg(bit, '' ORDER BY place) AS marked FROM bits GROUP BY k)"""


def snippet(text: Column, tokens: list[str], most: int = 300) -> Column:
    """Lines of a text within ``most`` bytes, chosen by two folds: first those with query tokens not met before, then others in order.

    The first line is always there; gaps are shown as dots.
    """
    trimmed = lambda c: F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")
    state = lambda seen, used, chosen, stop: F.struct(seen.alias("seen"), used.cast("int").alias("used"), chosen.alias("chosen"), stop.alias("stop"))
    line = lambda s, i: F.struct(i.alias("i"), F.octet_length(s).alias("size"), tokens_among(s, sorted(tokens)).alias("hits"))

    def by_tokens(now: Column, x: Column) -> Column:
        new = F.array_except(x["hits"], now["seen"])
        take = ~now["stop"] & ((x["i"] == 0) | ((F.size(new) > 0) & (now["used"] + x["size"] + 1 < most)))
        used = now["used"] + F.when(take, x["size"] + 1).otherwise(0)
        return state(F.array_union(now["seen"], new), used, F.when(take, F.array_append(now["chosen"], x["i"])).otherwise(now["chosen"]), now["stop"] | (take & (used == most)))

    def in_order(now: Column, x: Column) -> Column:
        open_ = ~now["stop"] & ~F.array_contains(now["chosen"], x["i"]) & (x["size"] > 0)
        fits = now["used"] + x["size"] < most
        take = open_ & fits
        return state(now["seen"], now["used"] + F.when(take, x["size"] + 1).otherwise(0), F.when(take, F.array_append(now["chosen"], x["i"])).otherwise(now["chosen"]), now["stop"] | (open_ & ~fits))

    def shown(lines: Column) -> Column:
        def joined(chosen: Column) -> Column:
            gap = lambda i, k: F.when((i > 1) & ((k == 0) | (F.get(chosen, k - 1) != i - 1)), "...").when(k > 0, " ").otherwise("")
            said = F.array_join(F.transform(chosen, lambda i, k: F.concat(gap(i, k), F.get(lines, i))), "")
            return F.concat(said, F.when(F.element_at(chosen, -1) != F.size(lines) - 1, "...").otherwise(""))

        start = state(F.array().cast("array<string>"), F.lit(0), F.array().cast("array<int>"), F.lit(False))
        folded = lambda xs: let(F.aggregate(xs, start, by_tokens), lambda one: F.aggregate(xs, state(one["seen"], one["used"], one["chosen"], one["used"] >= most), in_order))
        return let(let(F.transform(lines, line), folded), lambda end: let(F.array_sort(end["chosen"]), joined))

    whole = lambda t: F.when(F.octet_length(t) <= most, t).otherwise(let(F.transform(F.split(t, "\n"), trimmed), shown))
    return let(trimmed(text), whole)


def snippet_sql(rows: str, hits: str, tokens: list[str], most: int = 300) -> str:
    """CTEs ending in ``snippets`` (k, snippet) of ``rows`` (k, text), for DuckDB; ``hits`` makes (k, i, token) of ``line`` (k, i, line).

    The folds are recursive, one step for each line.
    """
    trimmed = lambda c: rf"regexp_replace({c}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"
    own = ", ".join(f"'{t}'" for t in sorted(tokens))
    return f"""text_of AS (SELECT k, {trimmed('text')} AS t FROM ({rows})), cut AS (SELECT k, list_transform(string_split(t, chr(10)), lambda x: {trimmed('x')}) AS ls FROM text_of WHERE octet_length(encode(t)) > {most}),
line AS (SELECT k, i - 1 AS i, ls[i] AS line FROM (SELECT k, ls, unnest(range(1, len(ls) + 1)) AS i FROM cut)),
hit AS (SELECT k, i, list(token) AS hits FROM ({hits}) WHERE token IN ({own}) GROUP BY k, i),
told AS (SELECT line.k, line.i, octet_length(encode(line)) AS size, coalesce(hits, CAST([] AS VARCHAR[])) AS hits FROM line LEFT JOIN hit ON hit.k = line.k AND hit.i = line.i),
one AS (SELECT k, CAST(-1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS chosen, FALSE AS stop FROM cut
  UNION ALL SELECT k, i, list_distinct(list_concat(seen, new)), used + CASE WHEN take THEN size + 1 ELSE 0 END, CASE WHEN take THEN list_append(chosen, i) ELSE chosen END, stop OR (take AND used + size + 1 = {most})
  FROM (SELECT *, NOT stop AND (i = 0 OR (len(new) > 0 AND used + size + 1 < {most})) AS take FROM (SELECT o.k, t.i, o.seen, o.used, o.chosen, o.stop, t.size, list_filter(t.hits, lambda h: NOT list_contains(o.seen, h)) AS new FROM one o JOIN told t ON t.k = o.k AND t.i = o.i + 1))),
two AS (SELECT k, CAST(-1 AS BIGINT) AS i, used, chosen, used >= {most} AS stop FROM (SELECT k, arg_max(used, i) AS used, arg_max(chosen, i) AS chosen FROM one GROUP BY k)
  UNION ALL SELECT k, i, used + CASE WHEN free AND fits THEN size + 1 ELSE 0 END, CASE WHEN free AND fits THEN list_append(chosen, i) ELSE chosen END, stop OR (free AND NOT fits)
  FROM (SELECT o.k, t.i, o.used, o.chosen, o.stop, t.size, NOT o.stop AND NOT list_contains(o.chosen, t.i) AND t.size > 0 AS free, o.used + t.size < {most} AS fits FROM two o JOIN told t ON t.k = o.k AND t.i = o.i + 1)),
picked AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM (SELECT k, unnest(arg_max(chosen, i)) AS i FROM two GROUP BY k)),
said AS (SELECT p.k, string_agg(CASE WHEN p.i > 1 AND (before IS NULL OR before <> p.i - 1) THEN '...' WHEN before IS NOT NULL THEN ' ' ELSE '' END || line, '' ORDER BY p.i) AS s, max(p.i) AS last FROM picked p JOIN line l ON l.k = p.k AND l.i = p.i GROUP BY p.k),
snippets AS (SELECT k, t AS snippet FROM text_of WHERE octet_length(encode(t)) <= {most} OR t IS NULL UNION ALL SELECT said.k, s || CASE WHEN last <> len(ls) - 1 THEN '...' ELSE '' END FROM said JOIN cut ON cut.k = said.k)"""
