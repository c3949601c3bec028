"""Packing, ranked search and late partitions: brute force, round trips, odd rows."""

import glob
import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import late, packing, queries, retrieval

DATA = os.environ.get("LODESTONE_DATA", "/root/testdata/sf0.001")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_ids_are_those_of_the_tokenizer(tokenizer, monkeypatch):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", " \n", "a", "B", "é", "1", "'s", " '", "!", ".", ".,", ")", "\t", "\x1c", "　", "\xa0", "word", " Word", "<|endoftext|>", "漢", "\x85", "​", "ſ", "ªb", "aª", "Ωa", "ĳ", "Ǆ", "ʰ", "\r\n", " 're", "x" * 40]
    for stretch in (3, 1 << 20):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        encoder = packing.Encoder(TOKENIZER)
        for _ in range(2000):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
            assert ids_of(encoder.ids(text)) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_known_words_are_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "MEMO", 50)
    encoder = packing.Encoder(TOKENIZER)
    for i in range(0, 400, 20):
        text = " ".join(f"word{j}" for j in range(i, i + 20))
        assert ids_of(encoder.ids(text)) == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) <= 50 + 20 + 20


def brute_pieces(tokenizer, rows, capacity=1024, end=2):
    out = {}
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[doc, p] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    return out


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    return len(by)


def test_query_packs_every_piece(spark, documents, tokenizer):
    df = queries.op11_best_fit_packing(spark, DATA)
    assert [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "bigint", "bigint"]
    rows = df.collect()
    want = brute_pieces(tokenizer, documents)
    assert len(rows) == len(want) and {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    least = -(-sum(x[1] for x in want.values()) // 1024)
    full = sum(x[1] == 1024 for x in want.values())
    rest = sorted((x[1] for x in want.values() if x[1] < 1024), reverse=True)
    plain = packing.best_fit([], list(range(len(rest))), rest, 1024)
    assert least <= check_packed(rows, 1024) <= full + len(plain)


def test_sequences_give_the_texts_back(spark, tokenizer):
    rows = [(i, " ".join(random.Random(i).choices(["oak", "elm", "fir", "Ash,"], k=i % 23))) for i in range(60)] + [(None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("piece", "length", "ids", "sequence_id", "offset", "task", "id")})
    packed = packing.pack(docs, TOKENIZER, capacity=16, with_ids=True, template=32).cache()
    held = packed.collect()
    check_packed(held, 16)
    pieces = defaultdict(list)
    for r in held:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append((r["start"], r["piece"], ids_of(bytes(r["ids"]))))
    for doc, text in rows:
        if doc != 7:
            assert sum((x[2] for x in sorted(pieces[doc])), []) == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    assert len(pieces[7]) == 3
    whole = {r["sequence_id"]: ids_of(bytes(r["ids"])) for r in packing.sequences(packed).collect()}
    for r in held:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids_of(bytes(r["ids"]))


def test_pack_nothing_long_and_full(spark, tokenizer):
    schema = "doc_id string, text string"
    assert packing.pack(spark.createDataFrame([], schema), TOKENIZER).collect() == []
    exact = next(n for n in range(1, 3000) if len(tokenizer.encode("x" * n).ids) == 7)
    docs = spark.createDataFrame([("a", "x" * exact), ("b", "é " * 20_000)], schema)
    rows = packing.pack(docs, TOKENIZER, capacity=8).collect()
    assert sorted(r["length"] for r in rows if r["doc_id"] == "a") == [8]
    assert check_packed(rows, 8) >= len(tokenizer.encode("é " * 20_000).ids) // 8


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 100_000])
def test_templates_take_every_piece(n):
    counts = Counter(random.Random(n).choices(range(1, 32), k=n))
    plan = packing.templates(dict(counts), 64)
    taken = Counter()
    for copies, own in plan:
        assert copies > 0 and own and sum(own.values()) <= 64
        for k, m in own.items():
            taken[k] += copies * m
    assert taken == counts and len(plan) <= 2 + math.log2(max(n, 1))


def test_genetic_packing_beats_best_fit(spark):
    rng = random.Random(5)
    lengths = [rng.randint(150, 500) for _ in range(300)]
    by_size = sorted(range(300), key=lambda i: -lengths[i])
    plain = len(packing.best_fit([], by_size, lengths, 1024))
    found = packing.evolve(lengths, [], 1024, 8, 400, 1)
    assert all(sorted(i for b in p for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 1024 for b in p) for p in found)
    assert -(-sum(lengths) // 1024) <= len(found[0]) < plain
    a, b = found[0], packing.best_fit([], rng.sample(range(300), 300), lengths, 1024)
    for made in (packing.crossover(a, b, lengths, 1024, rng), packing.mutate(a, lengths, 1024, rng)):
        assert sorted(i for x in made for i in x) == list(range(300)) and max(sum(lengths[i] for i in x) for x in made) <= 1024
    # islands: each epoch is at least as good as what the best member was, with the elite of another island among them
    best = packing.islands(spark, [lengths, lengths[:40]], 1024, 2, 6, 3, 60, 2, 1).collect()
    assert {r["template"]: r["n_bins"] for r in best}[0] <= plain
    for r in best:
        fill = Counter()
        for length, b in zip(r["lengths"], r["bins"], strict=True):
            fill[b] += length
        assert len(fill) == r["n_bins"] and max(fill.values()) <= 1024


# --- ranked search


def brute_rank(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    terms = [(d, Counter(cut(t))) for d, t in docs]
    sizes = [c.total() for _, c in terms]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, c in terms for w in c)
    out = []
    for item, text in items:
        asked, hits = Counter(cut(text)), []
        for (d, c), n in zip(terms, sizes, strict=True):
            score = 0
            for w, times in asked.items():
                if c[w]:
                    m = 25 + (75 * n * n_docs) // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                hits.append((-score, d is None, d or 0, d))
        out += [(item, r, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_query_ranks_all_documents(spark, documents):
    df = queries.op12_ranked_search(spark, DATA)
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute_rank(documents, items)


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_search_ties_repeats_and_odd_rows(spark, monkeypatch, block):
    rng = random.Random(11)
    words = ["oak", "Elm", "fir", "ash", "ÉTÉ", "x1"]
    docs = [(rng.randrange(40), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for _ in range(150)] + [(None, "oak elm"), (None, "oak elm"), (5, None), (6, ""), (7, "!?")]
    docs += [(900 + i, "same text of yew") for i in range(60)]
    items = [(1, "oak oak elm"), (2, "yew"), (3, None), (4, "unknown"), (5, "ÉTÉ fir, x1"), (5, "fir"), (None, "ash"), (6, "Été")]
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", block)
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(3).withColumns({c: F.lit("own") for c in ("item", "item_id", "score", "n", "terms", "rank")})
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(0))
    for most in (1, 200_000):
        if block != 7 and most == 1:
            continue
        got = [tuple(r) for r in retrieval.rank(df, asked, max_terms=most).collect()]
        assert sorted(got, key=repr) == brute_rank(docs, items)


def test_search_in_blocks_of_tasks(spark, monkeypatch):
    """Blocks are made in the workers: their bounds hold there too."""
    monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", 5)
    rows = [(pos, [1, 2, 3][: pos % 4], [1] * (pos % 4), pos % 4 + 1) for pos in range(30)]
    docs = spark.createDataFrame([(i, " ".join("abc"[: i % 4])) for i in range(30)], "doc_id int, text string")
    got = [tuple(r) for r in retrieval.rank(docs, spark.createDataFrame([(0, "a b c")], "item_id int, text string"), k=30).collect()]
    assert sorted(got, key=repr) == brute_rank([(i, " ".join("abc"[: i % 4])) for i in range(30)], [(0, "a b c")], 30) and len(rows) == 30


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, q in ((docs.filter("false"), items), (docs, items.filter("false")), (docs.filter("false"), items.filter("false"))):
        assert retrieval.rank(d, q).collect() == []


def test_treaps_prune(spark):
    """Trees hold both orders, and only few documents are scored for a query with a strong term."""
    rng = random.Random(2)
    n = 4000
    pairs = [(d, t, rng.randint(1, 9) * 1000) for d in range(n) for t in range(3) if rng.random() < 0.5] + [(d, 3, 900_000 - d) for d in range(0, n, 97)]
    doc, term, impact = (np.array(x) for x in zip(*pairs, strict=True))
    t = retrieval.Treaps(doc, term, impact)
    seen = []

    def walk(node, low, high):
        if node >= 0:
            assert low <= t.doc[node] < high
            for child in (t.left[node], t.right[node]):
                assert child < 0 or t.impact[child] <= t.impact[node]
            seen.append(node)
            walk(t.left[node], low, t.doc[node])
            walk(t.right[node], t.doc[node] + 1, high)

    for root in t.roots.values():
        walk(root, 0, n)
    assert sorted(seen) == list(range(len(pairs)))
    best = retrieval.Best(10)
    scored = t.search([0, 1, 2, 3], [10, 10, 10, 1000], n, *best.bound_to(list(range(n))))
    scores = Counter()
    for d, w, i in pairs:
        scores[d] += i * (1000 if w == 3 else 10)
    assert [(-s, key[1]) for s, key in best.rows] == sorted(((s, d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:10]
    assert scored < n / 2


def test_long_text_terms(monkeypatch):
    text = " ".join(f"w{i % 50}É" for i in range(5000)) + "x" * 10_000
    whole = retrieval.terms_of(text)
    monkeypatch.setattr(retrieval, "PIECE", 7)
    assert retrieval.terms_of(text) == whole and whole.total() == 5000


# --- late partitions

EPOCH = datetime(1970, 1, 1)
CUT = datetime(2024, 4, 10)


def micros(t):
    return None if t is None else (t - EPOCH) // timedelta(microseconds=1)


def day_of(t):
    return -1 if t is None else micros(t) // late.DAY


def with_copies(rows):
    out = list(rows)
    for r in rows:
        if r["sale_id"] is None or r["sold_at"] is None:
            continue
        h = zlib.crc32(str(r["sale_id"]).encode())
        if h % 3 == 0 and day_of(r["sold_at"]) % 7 == 0:
            later = None if r["arrived_at"] is None else r["arrived_at"] + timedelta(days=1 + h % 97)
            out.append({**r, "total": None if r["total"] is None else r["total"] + 1, "sold_at": r["sold_at"] + timedelta(days=h % 2), "arrived_at": later})
    return out


def brute_layouts(rows):
    early = lambda r: r["arrived_at"] is not None and r["arrived_at"] < CUT
    order = lambda r: (r["arrived_at"] is not None, r["arrived_at"] or EPOCH)

    def last(of):
        out = {}
        for r in of:
            if r["sale_id"] not in out or order(out[r["sale_id"]]) < order(r):
                out[r["sale_id"]] = r
        return out

    start, end = last(filter(early, rows)), last(rows)
    touched = set()
    for k, r in end.items():
        if not early(r):
            touched |= {day_of(r["sold_at"])} | ({day_of(start[k]["sold_at"])} if k in start else set())
    return start, end, touched


def brute_files(rows, size):
    days = defaultdict(list)
    for r in rows:
        days[day_of(r["sold_at"])].append(r)
    text = lambda x: "" if x is None else str(x)
    out = []
    for d, own in days.items():
        own.sort(key=lambda r: (r["sold_at"] is not None, r["sold_at"] or EPOCH, r["sale_id"] is not None, r["sale_id"] or 0))
        for at in range(0, len(own), size):
            p = own[at : at + size]
            cents = sum(0 if r["total"] is None else math.floor(100 * r["total"] + 0.5) for r in p)
            crc = sum(zlib.crc32(f"{text(r['sale_id'])}:{text(micros(r['sold_at']))}:{text(micros(r['arrived_at']))}".encode()) for r in p)
            out.append((d, at // size, len(p), cents, crc, hashlib.sha256(",".join(text(r["sale_id"]) for r in p).encode()).hexdigest()))
    return sorted(out)


def listing(found):
    return sorted((r["day"], r["file_no"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"]) for r in found)


def local(path):
    return path.removeprefix("file:").replace("//", "/")


def test_query_lays_out_all_sales(spark):
    df = queries.op13_late_partitions(spark, DATA)
    assert dict(df.dtypes) == {"day": "bigint", "file_no": "bigint", "n_rows": "bigint", "cents": "bigint", "rows_crc": "bigint", "path": "string", "columns": "string", "ids_sha256": "string", "rewritten": "boolean"}
    found = df.collect()
    rows = pq.read_table(f"{DATA}/sales.parquet").to_pylist()
    _, end, touched = brute_layouts(with_copies(rows))
    assert listing(found) == brute_files(end.values(), 1 + len(rows) // 700)
    assert all(r["rewritten"] == (r["day"] in touched) for r in found) and {r["rewritten"] for r in found} == {True, False}
    root = os.path.dirname(os.path.dirname(local(found[0]["path"])))
    assert {local(r["path"]) for r in found} == set(glob.glob(f"{root}/*/*.parquet"))
    for r in found[:20]:
        t = pq.read_table(local(r["path"]), partitioning=None)
        assert ",".join(t.column_names) == r["columns"] and t.num_rows == r["n_rows"]
        assert hashlib.sha256(",".join(map(str, t["sale_id"].to_pylist())).encode()).hexdigest() == r["ids_sha256"]


ODD = "sale_id long, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, day string, started int, `kept` array<int>"


def odd_sales():
    rng = random.Random(6)
    at = lambda d, s=0: datetime(2024, 4, 1) + timedelta(days=d, seconds=s)
    rows = []
    for i in range(300):
        sold = None if i % 17 == 0 else at(rng.randint(0, 3), rng.choice([0, 0, 60])) if i % 3 else at(1)  # one day has most rows
        rows.append((i % 200 if i % 19 else 199, rng.choice([None, 1.005, 2.5, float("nan"), -0.5]), sold, None if i % 23 == 0 else at(rng.randint(0, 20), i), "x", None, [i]))
    rows += [(None, 1.0, at(0), at(1), None, None, None), (None, 2.0, at(2), at(15), None, None, None), (1000, 3.0, at(40), at(41), "gone", 1, None), (1000, 3.0, at(41), at(42), "gone", 1, None)]
    rows += [(2000, 4.0, at(-9), at(-8), "moves", 1, None), (2000, 4.0, at(1), at(30), "moves", 1, None)]  # its day keeps nothing
    rows += [(3000 + i, 5.0, at(-20, i % 2), at(-19), "stays", 1, None) for i in range(7)]
    return rows


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_layout_of_odd_rows(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(late, "HELD", 3)
    rows = odd_sales()
    df = spark.createDataFrame(rows, ODD).repartition(5)
    root = f"file://{tmp_path}/t"
    before: dict = {}
    real = late.write_cut

    def spied(part, fields, where, n, mode):
        if mode == "overwrite":
            before.update({p: open(p, "rb").read() for p in glob.glob(f"{tmp_path}/t/*/*.parquet")})
        real(part, fields, where, n, mode)

    monkeypatch.setattr(late, "write_cut", spied)
    cutoff = micros(CUT)
    touched = {r["day"] for r in late.lay_out(df, cutoff, size, root).collect()}
    named = [dict(zip(("sale_id", "total", "sold_at", "arrived_at"), (r[0], None if r[1] is not None and math.isnan(r[1]) else r[1], r[2], r[3]), strict=True)) for r in rows]
    start, end, want = brute_layouts(named)
    assert touched == want
    found = late.describe(spark, root, df.schema, spark.createDataFrame([(d,) for d in touched], "day long")).collect()
    assert listing(found) == brute_files(end.values(), size)
    assert {local(r["path"]) for r in found} == set(glob.glob(f"{tmp_path}/t/*/*.parquet"))
    # what stood at the start was the early layout, and files of other days are the same bytes
    assert sum(pq.read_metadata(io.BytesIO(data)).num_rows for data in before.values()) == len(start)
    kept = [r for r in found if not r["rewritten"]]
    assert kept and all(open(local(r["path"]), "rb").read() == before[local(r["path"])] for r in kept)
    assert all(local(r["path"]) not in before for r in found if r["rewritten"])
    assert found[0]["columns"] == "sale_id,total,sold_at,arrived_at,day,started,kept"
    whole = pq.read_table(local(found[0]["path"]), partitioning=None)
    assert whole.column_names == ["sale_id", "total", "sold_at", "arrived_at", "day", "started", "kept"]


def test_equal_arrivals_are_settled_alike(spark):
    rows = [(1, float(k), EPOCH, CUT - timedelta(1)) for k in range(9)]
    df = spark.createDataFrame(rows, "sale_id long, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz")
    picked = {late.winners(df.repartition(n), micros(CUT), "sale_id", "sold_at", "arrived_at").first()["c1"] for n in (1, 2, 5)}
    assert len(picked) == 1


def test_layout_of_nothing_and_of_zoned_times(spark, tmp_path):
    empty = spark.createDataFrame([], ODD)
    touched = late.lay_out(empty, 0, 5, f"file://{tmp_path}/e")
    assert touched.collect() == [] and late.describe(spark, f"file://{tmp_path}/e", empty.schema, touched).collect() == []
    zoned = spark.createDataFrame([("k", 1.0, EPOCH + timedelta(days=3), EPOCH)], "sale_id string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz").withColumns({c: F.col(c).cast("timestamp") for c in ("sold_at", "arrived_at")})
    touched = late.lay_out(zoned, 1, 5, f"file://{tmp_path}/z")
    row = late.describe(spark, f"file://{tmp_path}/z", zoned.schema, touched).first()
    assert (row["day"], row["n_rows"], row["rewritten"]) == (3, 1, False)


# --- the bound on training rows


def test_training_rows_are_bounded_where_ids_repeat(spark):
    from lodestone.llm import quality_classifier

    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).unionByName(spark.range(5).select((F.col("id") * 4).alias("doc_id"), F.lit("other").alias("text")))
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (8, 0)], "doc_id long, quality int")
    rows = quality_classifier.labelled(docs, labels, "quality", "text", "doc_id", 10).collect()
    assert len(rows) <= 4 and len({r["text"] for r in rows if r["id"] == 1}) == 1
    assert len(quality_classifier.labelled(docs, labels, "quality", "text", "doc_id", 2).collect()) == 2


# --- alignment of texts whose parts changed places


def test_swapped_halves_are_told_apart_quickly():
    import time

    from lodestone.llm import minhash

    half = [[b"w%d" % (2 * i + k) for i in range(100_000)] for k in (0, 1)]
    start = time.time()
    assert minhash.aligned_similarity(half[0] + half[1], half[1] + half[0]) == 0.0
    assert time.time() - start < 10


def test_order_bound_never_hides_a_pair():
    from itertools import combinations

    from lodestone.llm import minhash

    rng = random.Random(4)
    for _ in range(200):
        own = rng.sample(range(9), rng.randint(0, 9))
        want = max((n for n in range(len(own) + 1) for c in combinations(own, n) if list(c) == sorted(c)), default=0)
        assert minhash.increasing(own) == want
    for _ in range(150):
        a = [b"%d" % rng.randint(0, 30) for _ in range(60)]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b))
            kind = rng.randint(0, 3)
            b[i : i + (kind != 0)] = [b"x"] * (kind < 2)
            if kind == 3:
                b = b[i:] + b[:i]
        # with the bound (least 0.8) and without it (least so low that nothing is left out)
        exact = minhash.aligned_similarity(a, b, 1e-9)
        assert minhash.aligned_similarity(a, b) in (exact, 0.0) and (exact < 0.8 or minhash.aligned_similarity(a, b) == exact)
