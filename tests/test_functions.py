"""Literal cases of path, text and score functions."""

import datetime as dt
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import describing, paths, scores, sentences, source, stem, stemming, tokens, words
from lodestone.operators import repos, schedule
from lodestone.operators.search import page_links, pages

DATA = os.environ.get("LODESTONE_DATA", "/root/testdata/sf0.001")


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_projects_and_authors(spark):
    pkgs = ["github.com/mo/ship", "gopkg.in/kite.v3", "gopkg.in/lee/tide.v15", "gopkg.in/lee/v0/set"]
    assert column(spark, pkgs, paths.project) == ["ship", "kite", "tide", "gopkg.in"]
    assert column(spark, pkgs, paths.author) == ["mo", "go-kite", "lee", "lee"]


def test_full_project(spark):
    pkgs = ["github.com/mo/ship", "github.com/mo/ship/deck/low", "code.google.com/p/ship.deck/low", "launchpad.net/~mo/ship/deck", "golanger.com/a"]
    assert column(spark, pkgs, paths.full_project) == ["github.com/mo/ship", "github.com/mo/ship", "code.google.com/p/ship.deck", "launchpad.net/~mo", "golanger.com/golangers"]


def test_site_split_and_host(spark):
    assert column(spark, ["github.com/x", "github.com", ""], paths.site) == ["github.com", "github.com", ""]
    assert column(spark, ["github.com/x/y", "github.com", ""], paths.rest) == ["x/y", "", ""]
    assert column(spark, ["a.b:80/x", "a b/c", "a/b", "/a", "a/"], paths.remove_host) == ["x", "c", "b", "/a", "a/"]
    assert column(spark, ["a.b:80/x", "a b/c"], paths.host) == ["a.b:80", ""]


def test_partition_hash_may_return_its_bound(spark):
    def model(s, p=128):
        h = 0
        for b in s.encode():
            h = h * 33 + b
            h = h % p if h > p else h
        return h

    words = ["", "a", "é", "github.com/u/r", *(chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26))]
    assert column(spark, words, paths.partition_hash) == [model(w) for w in words]


def test_sizes_and_durations(spark):
    assert column(spark, [5, 1024, 15000, 102400, 3 << 30], paths.readable_size, "long") == ["5.00", "1.00K", "14.6K", "100K", "3.00G"]
    assert column(spark, [90000.0, 7200.0, 61.0, 2.0, 0.25, 0.000002], paths.readable_duration, "double") == ["1 days", "2 hours", "1 mins", "2 sec", "250 ms", "2 us"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("up-to it", {"up", "to", "up-to", "it"}),
        ("mp3 + 4 km", {"mp", "3", "mp-3", "4", "km"}),
        ("新しい", {"新", "し", "い", "新し", "しい"}),
        ("myHttpServer", {"my", "http", "server", "myhttp", "httpserver", "myhttpserver"}),
        ("look at https://q.example/z?k=1#top soon", {"look", "at", "soon"}),
        ("ask me_2.x@sub.host.example now", {"ask", "now"}),
        ("end\ufeff", {"end"}),
        ("", set()),
    ],
)
def test_tokens(spark, text, want):
    want = {stem.norm_word(w) if w.isascii() and w.isalpha() else w for w in want}
    assert words.tokens_of(text) == want
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert {r["token"] for r in tokens.tokenize(df, "id", "t").collect()} == want


def test_raw_tokens(spark):
    got = column(spark, ["é中x本y 5 n³7 Über"], lambda c: F.flatten(F.transform(tokens.blocks(c), tokens.raw_tokens)))
    assert got[0] == ["é", "中x", "本y", "5", "n", "³7", "Über"]


def test_stems():
    for word, want in (("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("generics", "generic"), ("ide", "ide"), ("sky", "sky"), ("probate", "probat"), ("controll", "control")):
        assert stem.norm_word(word) == want


def test_sentence_split(spark):
    """Paragraphs of known sentences, with line breaks and runs of blanks between words, and rules around headings."""
    rng = random.Random(12)
    texts, wants = ["", " \n "], [[""], [""]]
    for _ in range(40):
        body, want = [], []
        count = rng.randint(1, 5)
        for at in range(count):
            said = [[rng.choice(["moss", "fern.7", "(bark)", "-", "twig/leaf"]) for _ in range(rng.randint(1, 7))] for _ in range(rng.randint(1, 4))]
            said = [[*words_[:-1], "end"] for words_ in said]
            want += [" ".join(w) + "." for w in said[:-1]] + [" ".join(said[-1])]
            paragraph = ". ".join(rng.choice([" ", "\n", "   "]).join(w) for w in said)
            kind = rng.randint(0 if at < count - 1 else 1, 3)
            # a heading, which has a line behind it, is underlined, or stands between two kinds of strokes
            body.append(paragraph + "\n" + rng.choice("-=") * rng.randint(4, 9) + "\n" if kind == 0 else f"--{'=' * rng.randint(2, 4)} {paragraph} =={'-' * rng.randint(2, 3)}" if kind == 1 else paragraph)
        texts.append(rng.choice(["", "\n\n"]) + "\n\n".join(body) + rng.choice(["", "\n"]))
        wants.append(want)
    got = column(spark, texts, sentences.split_sentences)
    assert [[s.strip() for s in g] for g in got] == wants


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_both_splitters_agree(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("text", sentences.split_sentences(F.col("text")).alias("s")).filter("text IS NOT NULL").collect()
    assert rows and all(sentences.sentences_of(r["text"]) == r["s"] for r in rows)


@pytest.mark.parametrize("kind", ["library", "plugin", "wrapper", "tool"])
def test_important_sentences(kind):
    """A sentence counts by its own wording, by where it ends, or by the name of the package before a verb."""
    pkg = "host.org/lee/stone"
    wording = [f"This {kind} will allow us to sort maps", f"The {kind} can be used to count stars", f"A naive go {kind} that sorts", "Yet another sorter", f"The goal of this {kind} is peace", "Some functions for maps", "Api for stars"]
    ending = ["Sorted maps in golang.", "Fast counting using go"]
    whole = [f"A quick sorter {kind}."]
    named = ["Stone, sorted maps: it is fast", "Stone - sorted maps", "lee/stone wraps a sorter", "package stone is intended to sort", "S t o n e is a sorter"]
    other = ["Bread was late again.", f"Rain fell on every {kind}", "We sorted maps by hand", "pebble wraps a sorter"]
    mixed = [x for row in itertools.zip_longest(other, wording, named, ending, whole) for x in row if x]
    assert sentences.important("\n\n".join(mixed), "main", pkg) == [x for x in mixed if x not in other]


def test_names_with_signs_and_pictures():
    assert len(sentences.important("c++x wraps maps.", "main", "host.org/lee/c++x")) == 1
    assert sentences.important("Stone is a sorter ![pic](http://p.q/r.png)", "", "host.org/lee/stone") == ["Stone is a sorter "]


def test_brackets_and_markdown():
    assert sentences.remove_brackets("a (b) c (d") == "a c (d"
    assert sentences.plain("#abc") == "abc"
    assert "t" in sentences.plain("* [[t]](/t)")
    assert sentences.plain("## Head\n\n**bold** and [text](http://x) `code`") == "Head\n\nbold and text code"


def test_snippet_and_marks():
    text = "first line\n" + "filler words here\n" * 40 + "the needle line\n" + "more filler\n" * 40
    got = sentences.snippet(text, {"needl"}, 120)
    assert got.startswith("first line") and "needle" in got and got.endswith("...") and len(got) < 160
    assert sentences.snippet(" short ", {"x"}) == "short"
    assert sentences.marked("a <needle> here", {"needl"}) == "a &lt;<b>needle</b>&gt; here"


HEADS = [
    # path, body, status, name, doc, imports
    ("a_test.go", '// Doc of x.\npackage x\n\nimport "a.org/b"\nimport (\n\t"c.org/d"\n)\n', "ParseSuccess", "x", "Doc of x.", ["a.org/b", "c.org/d"]),
    ("a.go", 'package x; import ("a"; b "c"; . "d"; _ `e`); import "f"', "ParseSuccess", "x", "", ["a", "c", "d", "e", "f"]),
    ("a.go", '/* import "no" */ package x /* import ( */\nimport /* "no" */ "yes" // "no"\n', "ParseSuccess", "x", 'import "no"', ["yes"]),
    ("a.go", 'package x\n\nimport "a"\n\nvar s = `\nimport "no"\n`\nimport "no"', "ParseSuccess", "x", "", ["a"]),
    ("a.go", 'package x\n// import "no"\n/*\nimport "no"\n*/\nimport (\n)\nfunc f() {}', "ParseSuccess", "x", "", []),
    ("a.go", '// License.\n\n// One.\n// Two.\npackage x', "ParseSuccess", "x", "One.\nTwo.", []),
    ("a.go", '// One.\n\npackage x', "ParseSuccess", "x", "", []),
    ("a.go", '\ufeff/*\nLong\n  doc.\n*/\npackage über', "ParseSuccess", "über", "Long\ndoc.", []),
    ("a.go", 'package x\nimport "a\\x2fb\\u002fc\\"d"', "ParseSuccess", "x", "", ['a/b/c"d']),
    ("a.go", "// +build ignore\n\npackage x", "ShouldIgnore", "", "", []),
    ("a.go", "// +build linux,!cgo go1.2\n\npackage x", "ParseSuccess", "x", "", []),
    ("a.go", 'package x\n// +build ignore\nimport "a"', "ParseSuccess", "x", "", ["a"]),
    ("a.go", "no clause", "ParseFailed", "", "", []),
    ("a_test.go", "no clause", "ShouldIgnore", "", "", []),
    ("a.go", 'package x\nimport (\n"a"\n', "ParseFailed", "", "", []),
    ("a.go", "", "ParseFailed", "", "", []),
    ("a.go", "// package x", "ParseFailed", "", "", []),
    ("a.go", "package 7", "ParseFailed", "", "", []),
]


@pytest.mark.parametrize(("path", "body", "status", "name", "doc", "imports"), HEADS)
def test_header(path, body, status, name, doc, imports):
    assert source.header(path, body) == {"status": status, "name": name, "description": doc, "imports": imports, "is_test": path.endswith("_test.go")}


def test_header_of_a_long_file():
    """Only the head is read: what follows may be anything, and long."""
    import time

    start = time.time()
    assert source.header("a.go", 'package x\nimport "a"\nvar s = 1\n' + "/* '\"` " * 1_000_000)["imports"] == ["a"]
    assert source.header("a.go", "/*" * 200_000)["status"] == "ParseFailed" and time.time() - start < 20


def test_scores(spark):
    row = spark.range(1).select(
        scores.fuse_stars(F.lit(-1), F.lit(5)).alias("a"), scores.fuse_stars(F.lit(3), F.lit(9)).alias("b"), scores.fuse_stars(F.lit(8), F.lit(9)).alias("c"),
        scores.idf(F.lit(0), F.lit(1.0)).alias("d"), F.round(scores.idf(F.lit(1), F.lit(100.0)), 6).alias("e"),
        scores.legacy_factor(F.lit(dt.datetime(2015, 1, 1))).alias("f"), scores.legacy_factor(F.lit(dt.datetime(2015, 9, 1))).alias("g"), scores.legacy_factor(F.lit(dt.datetime(2020, 1, 1))).alias("h"),
    ).first()
    assert tuple(row) == (5, 9, 12, 0.0, 2.145966, 0.25, 0.1, 0.01)
    assert column(spark, ["5", "50", "500", "x"], scores.list_length) == [20, 50, 100, 20]


def test_folders_and_files(spark):
    """Random names and all fixed ones, against the rules in plain code."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abZ19-_.é") for _ in range(rng.randint(1, 4))) for _ in range(300)] + [n for x in repos.NOT_SOURCE for n in (x, x.upper(), x + "s")] + ["inNodeJSout", "golf", "ré"]

    def holds(name):
        low = name.lower()
        return low not in repos.NOT_SOURCE and "." not in name and "nodejs" not in low and "a" <= low[0] <= "z" and not all(c in "0123456789_-" for c in low)

    assert column(spark, names, repos.like_source_folder) == [holds(n) for n in names]
    files = [stem_ + end for stem_ in ("readme", "READme", "readme2", "unread", "") for end in ("", ".", ".txt", ".md", ".a.b")]
    assert column(spark, files, repos.is_readme) == [f.rpartition(".")[0].lower() == "readme" if "." in f else f.lower() == "readme" for f in files]


def test_broken_paths(spark):
    ids = ["github.com/u/r/go", "github.com/u/r/js", "github.com/u/r/x/y", "github.com/u/r/a/x/b", "github.com/u/r/a/b/a/b", "github.com/u/r"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r["id"] for r in schedule.broken(rows, spark.createDataFrame([("github.com/u/r",)], "package string"), repos.like_source_folder).collect()}
    assert "github.com/u/r/js" in got and "github.com/u/r/go" not in got and "github.com/u/r" not in got


def test_pages():
    assert pages(0) == 0 and pages(11) == 2
    assert page_links(1, 3) == {"before": [], "after": [2, 3], "prev": 0, "next": 2}
    assert page_links(20, 40)["before"] == list(range(11, 20))
    assert page_links(9, 3) == {"before": [1, 2, 3], "after": [], "prev": 0, "next": 0} and page_links(1, 0)["next"] == 0


def test_stem_columns_are_the_stems(spark):
    """Random words with all endings of the rules, against the plain algorithm."""
    rng = random.Random(1)
    ends = [a for a, _ in stem.STEP2 + stem.STEP3] + list(stem.STEP4) + ["ed", "ing", "eed", "sses", "ies", "s", "y", "e", "ll", "izing", "bled", "tted", ""]
    given = sorted({"".join(rng.choice("aeiouybcdtlszwx") for _ in range(rng.randint(0, 6))) + rng.choice(ends) + rng.choice(["", "s", "e"]) for _ in range(8000)} | {"IDE", "Generics", "yyyy", "ayy", "É", "no-word", "x1"})
    assert column(spark, given, stemming.stem) == [stem.norm_word(w) for w in given]


def test_token_columns_are_the_tokens(spark):
    rng = random.Random(2)
    bits = ["Hopping", "runs", "myHttpServer", "XMLFile", "the", "42", "新しい", "é", "a.b", "x-y", "http://q.r/s", "me@h.org", " ", "\n", "　", "!", "Ärger", "ÄrgerNis"]
    given = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    assert [set(t) for t in column(spark, given, tokens.token_set)] == [words.tokens_of(t) for t in given]


def test_chosen_columns_are_the_important_sentences(spark):
    rng = random.Random(7)
    bits = ["Stone", "stone", "stones", "s t o n e", "lee/stone", "package", "the", "go", "(x)", "(a) (b)", "wraps", "is a", "- ", ", ", "of", "a library", "using golang.", "![p](q)", "This tool", "that", "rain", "c++"]
    rows = []
    for i in range(400):
        text = ". ".join(" ".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, rng.choice(["", "main", "stone", "tool-go", None]), rng.choice(["host.org/lee/stone", "stones", "h.org/c++", "", "h.org/u/re.x-go", None])))
    df = spark.createDataFrame(rows, "i int, text string, name string, pkg string")
    got = {r["i"]: r["s"] for r in df.select("i", describing.chosen(F.col("text"), F.col("name"), F.col("pkg")).alias("s")).collect()}
    want = {i: sentences.important(t, n or "", p or "") for i, t, n, p in rows}
    assert got == want and sum(map(len, want.values())) > 100


def test_marked_columns_are_the_marked_texts(spark):
    rng = random.Random(9)
    bits = ["Running", "runs", "run", "<b>", "&", "'q'", '"', " ", "\n", "42", "新", "é", "x2y", "-", "the"]
    given = ["", " ", "runs", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(200)]]
    assert column(spark, given, lambda c: describing.marked(c, ["run", "42", "新"])) == [sentences.marked(t, {"run", "42", "新"}) for t in given]


def test_snippet_columns_are_the_snippets(spark):
    rng = random.Random(10)
    bits = ["running", "run", "moss", "fern", "42", " ", "é", "stone", "a-b", ""]
    given = ["", " ", *["\n".join(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 14))) for _ in range(150)]]
    for most in (20, 60, 120):
        assert column(spark, given, lambda c, most=most: describing.snippet(c, ["run", "42", "stone"], most)) == [sentences.snippet(t, {"run", "42", "stone"}, most) for t in given]


MARKDOWN = [
    ("One\n===\ntwo *em* and __st__\nmore\n\nThree ##\n---", "One\n\ntwo em and st\nmore\n\nThree ##"),
    ("#1 first\n# second #\n####### seven", "1 first\n\nsecond\n\n####### seven"),
    ("- a\n- b\n  1. c\n     still c\n\n     para of c\n- d\nlazy d\n\nafter", "a\n\nb\n\nc\nstill c\n\npara of c\n\nd\nlazy d\n\nafter"),
    ("> q\nlazy\n> - item\n> > deep\n\nout", "q\nlazy\n\nitem\n\ndeep\n\nout"),
    ("~~~~sh\n# *kept*\n~~~\n~~~~\nend", "# *kept*\n~~~\n\nend"),
    ("```\nno end", "no end"),
    ("para\n    not code\n\n    code *x*\n\n      more\n\nend", "para\nnot code\n\ncode *x*\n\n  more\n\nend"),
    ("[a](http://x.y/(z) \"t\") [b][R] [r] [none] [c][] ![p](q.png)\n\n[r]: <u> 'v'", "a b r [none] c p"),
    ("[![badge](b.svg)](http://ci) text", "badge text"),
    ("`a  *b*` ``c`d`` \\*e\\* &lt;f&gt; <g@h.i> <j:k> <b>l</b><br/>", "a *b* c`d *e* <f> g@h.i j:k l"),
    ("snake_case_x 2*3*4 **bold**ly ***both*** ~~old~~", "snake_case_x 2*3*4 boldly both old"),
    ("* * *\n___\nx\n<!-- y\nz --> w", "x\nw"),
    ("| h | i |\n|---|:-:|\n| j | k |", "h | i\nj | k"),
    ("a  \nb\\\nc", "a\nb\nc"),
    ("", ""), (" \n\t\n", ""), ("-", ""), ("x\r\ny", "x\ny"),
]


@pytest.mark.parametrize(("given", "want"), MARKDOWN)
def test_markdown(given, want):
    assert sentences.plain(given) == want


def test_markdown_of_marks_only_is_quick():
    import time

    start = time.time()
    for mark in ("[", "*a ", "`", "> ", "- ", "<", "_a ", "![", "\n- ", "~~a"):
        sentences.plain(mark * 10_000)
    sentences.plain("\n".join(" " * i + "- x" for i in range(200)))
    assert time.time() - start < 30


def test_sentences_are_split_once(spark):
    # a paragraph is split for itself, not again for each of its sentences
    own = sentences.split_sentences(F.col("t"))
    assert str(own).count("split(") == 2
    text = ". ".join(f"word{i}\tx" for i in range(5000)) + "\n\nlast"
    found = spark.createDataFrame([(text,)], "t string").select(own.alias("s")).first()["s"]
    assert found == [f"word{i} x." for i in range(4999)] + ["word4999 x", "last"]


def test_patterns_of_names_are_made_only_where_they_are_asked_for(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("compiled")

    assert sentences.important("Ship makes interface for x", "ship", "github.com/mo/ship") == ["Ship makes interface for x"]
    monkeypatch.setattr(sentences, "name_pattern", fail)
    assert sentences.important("", "ship", "github.com/mo/ship") == [] and sentences.important("This provides a thing", "ship", "a.b/c") == ["This provides a thing"]


def test_row_patterns_are_compiled_once_for_a_row(spark):
    assert "regexp_instr" in str(describing.chosen(F.col("t"), F.col("n"), F.col("p")))


def test_tokens_among_wanted_are_those_of_the_set(spark):
    import random

    from pyspark.sql import functions as F

    from lodestone.functions import stemming, tokens
    from lodestone.functions.stem import STEP2, STEP3, STEP4, norm_word
    from lodestone.functions.words import tokens_of

    random.seed(7)
    ends = [a for a, _ in (*STEP2, *STEP3)] + [*STEP4, "s", "es", "ed", "eed", "ing", "y", "e", "ll", "ies", "sses", ""]
    made = sorted({random.choice(["rel", "hop", "and", "to", "of", "abil", "xy", "cabl", "tro", "yel", "generic", "l", "i"]) + random.choice(ends) + random.choice(ends) for _ in range(1500)})
    assert all(w.startswith(stemming.kernel(norm_word(w))) for w in made)
    got = spark.createDataFrame([(w,) for w in made], "w string").select("w", stemming.stem(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in got] == [norm_word(r["w"]) for r in got]
    texts = ["And ANd aingNd toFrom To-day offs", "ToSwer TosWer inTheEnd", "andfulness, tower! ands", "Großand über-all 中文 and", ""] + [" ".join(random.choice(made).title() if random.random() < 0.3 else random.choice(made) for _ in range(12)) for _ in range(40)]
    for wanted in (["and", "of", "to"], ["and", "in", "tower"], ["relat", "the", "cabl", "hope"], ["and-of", "to"], ["中文"]):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.tokens_among(F.col("t"), wanted).alias("x"), tokens.token_set(F.col("t")).alias("all")).collect()
        assert all(set(r["all"]) == tokens_of(r["t"]) for r in rows)
        assert [r["x"] for r in rows] == [[w for w in wanted if w in tokens_of(r["t"])] for r in rows]
