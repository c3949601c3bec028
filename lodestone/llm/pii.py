"""Personal data by weak supervision, in column expressions only.

1. Candidates: four base patterns with exact checks, and looser patterns for
   further kinds. Patterns are possessive and anchored so that each runs in
   time linear in the text; spans are put together from the pieces around them.
2. Labelers vote on each candidate (1, -1 or 0 for abstaining): pattern check,
   gazetteer, words before it, and its borders.
3. Votes are counted by pattern over all documents (at most a few thousand
   distinct rows, whatever the input); expectation-maximisation over these
   counts estimates how reliable each labeler is for each kind.
4. A logistic span classifier is trained on the soft labels and applied as a
   column expression. Candidates that pass the base checks stay in any case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, text_of, unused

# The base kinds in their order, each with what a text must hold for the pattern to be tried, and the pattern.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = (("email", "@", EMAIL), ("ip", r"[0-9]\.[0-9]", IP), ("card", r"[0-9](?:[ -]?[0-9]){15}", CARD), ("phone", r"\+[0-9]", PHONE))
# Given names, common in English, French, German, Spanish and Italian.
FIRST_NAMES = (
    "Adam Albert Alexander Alice Alfred Amelia Amy Andrea Andrew Anna Anne Antonio Arthur Barbara Benjamin Bernard Brian Camille Carl Carla Carlos Caroline Catherine Charles Charlotte Chloe Christian "
    "Christine Christopher Claire Claudia Clara Daniel David Deborah Diana Diego Dorothy Edward Elena Elisabeth Elizabeth Emily Emma Eric Esther Eva Felix Fernando Francesca Francis Francisco Frank Frederic "
    "Friedrich Gabriel George Giovanni Giulia Grace Greta Hannah Hans Heinrich Helen Helena Henri Henry Ines Ingrid Isabel Isabella Jack Jacques Jakob James Jane Javier Jean Jennifer Jessica Joan Johann John "
    "Jonas Jorge Joseph Juan Julia Julien Karen Karl Katharina Kevin Klaus Laura Lea Leon Linda Lisa Louis Louise Luca Lucas Lucia Luis Lukas Manuel Marco Margaret Maria Marie Mark Marta Martin Mary Matteo "
    "Matthew Max Michael Michel Miguel Monica Nancy Nicolas Nicole Nina Noah Oliver Olivia Oscar Otto Pablo Patricia Patrick Paul Paula Pedro Peter Philip Pierre Rachel Rebecca Richard Robert Roberto Rosa Ruth "
    "Samuel Sandra Sara Sarah Sebastian Sofia Sophie Stefan Stephen Susan Susanne Teresa Thomas Ursula Victor Victoria Walter Werner William Wolfgang Yves"
).split()
# Further kinds.
EXTRA = (
    ("name", r"\b(?:Mrs?|Dr|Prof)\. \p{Lu}", r"\b(?:Mrs?|Dr|Prof)\. \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?+"),
    ("secret", r"AKIA[0-9A-Z]{16}|(?:password|passwd|api_key|secret|token)[ \t]*+=", r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|api_key|secret|token)[ \t]*+=[ \t]*+(?:\"[^\"\n]{6,}+\"|'[^'\n]{6,}+'|[^\s,;]{6,}+)"),
    # 15 characters (4 + 4 + 4 + 3) are the fewest; compact or in groups of four with a shorter last one
    ("iban", r"\b[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"\b[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})\b"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
)
KINDS = tuple(k for k, _, _ in (*BASE, *EXTRA))
#: Words within 32 characters before a candidate that speak for or against it.
FOR = r"(?i)\b(?:e-?mail|mail|contact|write|call|phone|tel|fax|mobile|ip|host|server|address|card|visa|credit|password|key|token|secret|account|iban|ssn|name|mr|mrs|dr)\b[^\n]{0,12}$"
AGAINST = r"(?i)\b(?:version|section|isbn|order|page|figure|chapter|release|build|example)\b[^\n]{0,12}$"
LABELERS = ("check", "gazetteer", "context", "border")
SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,shape:int>"


def luhn(digits: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return a + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), let(digits, luhn)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def vote(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def gazetteer(kind: str, found: Column) -> Column:
    """A vote from short lists; written for each kind."""
    no = F.lit(False)
    if kind == "email":
        return vote(found.rlike(r"(?i)\.(?:com|org|net|edu|gov|de|fr|es|uk|io|eu)$"), found.rlike(r"(?i)\.(?:png|jpg|js|css|local)$"))
    if kind == "ip":
        return vote(no, found.rlike(r"^(?:0|127|255)\."))
    if kind == "card":
        return vote(found.rlike(r"^[3-6]"), found.rlike(r"^[0-27-9]"))
    if kind == "phone":
        return vote(found.rlike(r"^\+(?:1|33|34|44|49)(?![0-9]{12})"), no)
    if kind == "name":
        return vote(found.rlike(rf"\b(?:{'|'.join(FIRST_NAMES)})\b"), no)
    if kind == "secret":
        return vote(found.rlike("[0-9]"), found.rlike(r"=[ \t]*[\"']?(?:x+|\*+|none|null)[\"']?$"))
    if kind == "ssn":
        return vote(no, found.rlike(r"^(?:000|666|9)"))
    return vote(found.rlike(r"^(?:DE|FR|ES|GB|IT|NL|CH|AT|BE)"), no)


def scanned(xs: Column, zero: Column, join) -> Column:
    """``join`` over all elements before each one, beginning with ``zero``.

    Arrays can only be grown by copying them; blocks of about the root of the
    length keep that far below the square of it.
    """

    def running(part: Column, start: Column) -> Column:
        step = lambda a, x: F.struct(join(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("now"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])

    def of(size: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / size).cast("int") - 1), lambda b: F.slice(xs, b * size + 1, size))

        def blocks(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, zero, join))
            return F.flatten(F.zip_with(parts, running(totals, zero), running))

        return let(parts, blocks)

    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(let(F.ceil(F.sqrt(F.size(xs))).cast("int"), of))


def spans_of(text: Column, k: int, kind: str, hint: str, pattern: str, base: bool) -> Column:
    """The candidates of one kind. Positions come from the lengths of the matches and of the pieces between them.

    The context of a candidate is what lies between it and its neighbours, with
    the neighbour before: the text itself is never cut from its beginning.
    """

    def place(matches: Column) -> Column:
        pieces = F.split(text, pattern, -1)

        def collect(pieces: Column) -> Column:
            steps = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))

            def build(ends: Column) -> Column:
                def one(found: Column, i: Column) -> Column:
                    start = F.get(ends, i) + F.length(F.get(pieces, i))
                    end = start + F.length(found)
                    before = F.right(F.concat(F.coalesce(F.get(matches, i - 1), F.lit("")), F.get(pieces, i)), F.lit(32))
                    after = F.left(F.concat(F.left(F.get(pieces, i + 1), F.lit(1)), F.coalesce(F.left(F.get(matches, i + 1), F.lit(1)), F.lit(""))), F.lit(1))
                    ok = passes(kind, found)
                    votes = F.array(
                        vote(ok, ~ok), gazetteer(kind, found), vote(before.rlike(FOR), before.rlike(AGAINST)),
                        vote(before.rlike(r"(?:^|[\s(\[<:,;=])$") & after.rlike(r"^(?:$|[\s)\]>:,;.])"), before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]")),
                    )
                    shape = F.when(F.length(found) < 12, 0).when(F.length(found) < 20, 1).when(F.length(found) < 40, 2).otherwise(3)
                    return F.struct(F.lit(k).alias("kind"), start.alias("start"), end.alias("end"), (ok if base else F.lit(False)).alias("base"), votes.alias("votes"), shape.alias("shape"))

                return F.transform(matches, one)

            return let(scanned(steps, F.lit(0), lambda a, x: a + x), build)

        return F.when(F.size(matches) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(let(pieces, collect).cast(f"array<{SPAN}>"))

    tried = text.contains(hint) if hint == "@" else text.rlike(hint)
    return F.when(tried, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(F.array().cast(f"array<{SPAN}>"))


def apart(base: Column, more: Column) -> Column:
    """``base`` and those of ``more`` that overlap no span of ``base`` that passed its check.

    All spans in the order of their starts: the greatest end before a span and
    the least start after it tell whether one of them overlaps it.
    """
    far = 2**31 - 1

    def of(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(0))
        starts = F.reverse(F.transform(spans, lambda s: F.when(s["base"], s["start"]).otherwise(far)))

        def keep(found: Column) -> Column:
            free = lambda s, i: (F.get(found["to"], i) <= s["start"]) & (F.get(found["from"], F.size(spans) - 1 - i) >= s["end"])
            return F.filter(spans, lambda s, i: (s["kind"] >= len(BASE)) & free(s, i))

        return let(F.struct(scanned(ends, F.lit(0), lambda a, x: F.greatest(a, x)).alias("to"), scanned(starts, F.lit(far), lambda a, x: F.least(a, x)).alias("from")), keep)

    # equal starts: base spans first, so that a further span behind them sees their end
    by_start = F.transform(F.concat(base, more), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), s["votes"].alias("votes"), s["shape"].alias("shape")))
    kept = F.transform(let(F.array_sort(by_start), of), lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base", "votes", "shape")]))
    return F.when((F.size(more) == 0) | (F.size(base) == 0), F.concat(base, more)).otherwise(F.concat(base, F.array_sort(kept)))


def candidates(docs: DataFrame, text_col: str, keep: list[Column], spans: str = "spans") -> DataFrame:
    """``keep`` plus ``spans``: all candidates by kind and start; further kinds only where no base span lies."""

    def of(text: Column) -> Column:
        base = F.concat(*[spans_of(text, k, *x, base=True) for k, x in enumerate(BASE)])
        more = F.concat(*[spans_of(text, len(BASE) + k, *x, base=False) for k, x in enumerate(EXTRA)])
        return let(F.struct(base.alias("base"), more.alias("more")), lambda s: apart(s["base"], s["more"]))

    return docs.select(*keep, let(text_of(text_col), of).alias(spans))


def estimate(counts: list[tuple[int, tuple, int, float]], rounds: int = 50) -> list[float]:
    """EM over (kind, votes, shape, count): the posterior of each row that it is personal data.

    Each labeler has, for each kind, its rates of voting 1, -1 and 0 on true and
    on false candidates; the pattern check starts as the most trusted.
    """
    post = [1 / (1 + math.exp(-(2.5 * v[0] + 1.0 * v[1] + 1.0 * v[2] + 1.5 * v[3]))) for _, v, _, _ in counts]
    kinds = {k for k, _, _, _ in counts}
    for _ in range(rounds):
        prior, rate = {}, {}
        for k in kinds:
            own = [(v, n, p) for (kk, v, _, n), p in zip(counts, post, strict=True) if kk == k]
            yes, no = sum(n * p for _, n, p in own), sum(n * (1 - p) for _, n, p in own)
            prior[k] = (yes + 1) / (yes + no + 2)
            for j in range(len(LABELERS)):
                for x in (-1, 0, 1):
                    lean = 1.0 if x == 0 else 2.0 if x == 1 else 0.5
                    rate[k, j, x] = ((sum(n * p for v, n, p in own if v[j] == x) + lean) / (yes + 3.5), (sum(n * (1 - p) for v, n, p in own if v[j] == x) + 1 / lean) / (no + 3.5))
        new = []
        for k, v, _, _ in counts:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(math.log(rate[k, j, v[j]][0] / rate[k, j, v[j]][1]) for j in range(len(LABELERS)))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved = max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0.0)
        post = new
        if moved < 1e-9:
            break
    return post


def features(kind: int, votes, shape: int) -> list[float]:
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *map(float, votes), *[float(shape == s) for s in range(4)]]


def train(counts: list[tuple[int, tuple, int, float]], soft: list[float], rounds: int = 300, ridge: float = 1e-2) -> list[float]:
    """Weights of the span classifier: logistic regression on soft labels, by gradient steps on the counted rows."""
    import numpy as np

    x = np.array([features(k, v, s) for k, v, s, _ in counts])
    y, n = np.array(soft), np.array([c for _, _, _, c in counts], dtype=float)
    n = np.log1p(n)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) / len(counts)
        step = np.linalg.solve(hessian, x.T @ (n * (y - p)) - ridge * w / len(counts))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in np.round(w, 9)]


def find_pii(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """Columns ``carry`` (default: all) plus ``spans``: array of (kind, start, end, base, score) by kind, then start.

    Positions are code points, ends exclusive. A null text counts as empty and
    has no spans; repeated rows each get theirs; an empty table gives no rows;
    texts of any length are searched whole. An input column named ``spans`` is
    replaced.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() != "spans"]
    kept = [F.col(f"`{c}`") for c in names]
    (own,) = unused([*names, "spans"], "spans_")
    slim = materialize(candidates(docs, text_col, kept, own), "pii-spans")
    # one row for each kind, votes and shape: at most 8 * 81 * 4
    rows = slim.select(F.explode(own).alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").alias("n")).collect()
    counts = sorted((r["kind"], tuple(r["votes"]), r["shape"], float(r["n"])) for r in rows)
    weights = train(counts, estimate(counts)) if counts else [0.0] * (5 + len(KINDS) + len(LABELERS))
    k0, v0, s0 = 1, 1 + len(KINDS), 1 + len(KINDS) + len(LABELERS)

    def scored(s: Column) -> Column:
        lits = lambda a, b: F.array(*[F.lit(x) for x in weights[a:b]])
        z = F.lit(weights[0]) + F.get(lits(k0, v0), s["kind"]) + F.get(lits(s0, s0 + 4), s["shape"])
        for j in range(len(LABELERS)):
            z = z + F.lit(weights[v0 + j]) * F.get(s["votes"], j)
        names_ = F.array(*[F.lit(k) for k in KINDS])
        return F.struct(s["kind"].alias("rank"), F.get(names_, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), (1 / (1 + F.exp(-z))).alias("score"))

    # a candidate of a base kind that failed its check is dropped for good
    sure = F.filter(F.transform(own, scored), lambda s: s["base"] | ((s["rank"] >= len(BASE)) & (s["score"] >= least)))
    return slim.select(*kept, F.array_sort(sure).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays.

    A null text stays null. The text is taken apart into code points once.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    one = "struct<start:int,end:int,kind:string>"

    def step(a: Column, s: Column) -> Column:
        more = F.concat(a["out"], F.array(F.struct(a["pos"].alias("start"), s["start"].alias("end"), s["kind"].alias("kind")))).cast(f"array<{one}>")
        return F.when(s["start"] < a["pos"], a).otherwise(F.struct(s["end"].alias("pos"), more.alias("out")))

    kept = F.aggregate(ordered, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{one}>").alias("out")), step)

    def put(both: Column) -> Column:
        chars, gaps = both["chars"], both["kept"]
        cut = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
        parts = F.transform(gaps["out"], lambda g: F.concat(cut(g["start"], g["end"]), F.lit("["), g["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(gaps["pos"], F.size(chars)))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(F.split(text, "").alias("chars"), kept.alias("kept")), put))
