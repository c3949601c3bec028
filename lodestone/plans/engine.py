"""The package search engine: load an index, answer queries and lookups."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, scores, sentences, tokens
from ..functions.words import tokens_of
from ..operators import blocks, index, packages, search, tops
from ..sources.snapshots import Segments

API_HITS = 100


class Engine:
    """Answers from the newest finished segment under ``root``; before there is one, from empty tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.segment = spark, root.rstrip("/"), None
        self.reload()

    def reload(self) -> bool:
        """Takes a newer finished segment if there is one."""
        name = Segments(self.spark, self.root).max_done()
        if name is None or name == self.segment:
            return False
        read = lambda t: self.spark.read.parquet(f"{self.root}/{name}/{t}")
        self.hits_full, self.hits, self.importers, self.postings, self.blocks, self.ranges = (read(t) for t in ("hits_full", "hits", "importers", "postings", "blocks", "ranges"))
        self.segment, self._total = name, self.hits.count()
        return True

    def index(self, docs: DataFrame, now: Column) -> None:
        index.write(self.spark, self.root, index.build(docs, now))
        self.reload()

    def total(self) -> int:
        return self._total if self.segment is not None else 0

    def _found(self, query: list[str]) -> DataFrame:
        if not query:
            return self.hits
        own = self.postings.filter((F.col("field") == "text") & F.col("token").isin(query))
        ids = own.groupBy("doc_id").agg(F.countDistinct("token").alias("n")).filter(F.col("n") == len(query)).select("doc_id")
        return self.hits.join(ids, "doc_id")

    def _idfs(self, query: list[str]) -> list[tuple[str, float, float]]:
        counts = {(r["field"], r["token"]): r["n"] for r in self.postings.filter(F.col("field").isin("text", "name") & F.col("token").isin(query)).groupBy("field", "token").agg(F.count("*").alias("n")).collect()}

        def one(field: str, t: str) -> float:
            x = math.log(self.total() / max(counts.get((field, t), 0), 1)) if self.total() else 0.0
            return math.sqrt(x) if x > 1 else x

        return [(t, one("text", t), one("name", t)) for t in query]

    def _scored(self, query: list[str]):
        """Adds ``match_score`` and ``score`` to hits."""
        words = lambda c: F.filter(F.flatten(F.transform(tokens.blocks(c), lambda b: tokens.raw_tokens(F.lower(b)))), lambda t: t != "")
        low = lambda c: F.lower(tokens.strip_links(c))
        said = F.array_join(F.transform("important_sentences", lambda s: F.lower(s)), " ")
        path = scores.match_path(F.col("package"))
        fields = {"synopsis": (low(F.col("synopsis")), words(F.col("synopsis"))), "sentences": (said, words(said)), "name": (F.lower("name"), words(F.col("name"))), "path": (path, words(path))}
        idfs = self._idfs(query)
        match = scores.match_score(idfs, fields) if query else F.lit(1.0)
        return idfs, lambda hits: hits.withColumn("match_score", match).withColumn("score", F.greatest("static_score", "test_static_score") * F.col("match_score"))

    def search(self, q: str) -> DataFrame:
        """All hits with ``match_score`` and ``score``, in no order; ``search.hit_order`` puts the best first. Nothing is written."""
        if self.segment is None:
            return self.spark.createDataFrame([], "package string, score double")
        query = sorted(tokens_of(q))
        _, score = self._scored(query)
        return search.demoted(score(self._found(query))).withColumn("score", F.col("final_score")).drop("final_score", "occurrence")

    def top(self, q: str, k: int = API_HITS) -> DataFrame:
        """The best ``k`` hits with ``score`` and ``rank`` (from 1).

        From so many hits on that repeated names are not demoted, they come from
        posting blocks: most hits are then neither read nor scored.
        """
        if self.segment is None:
            return self.spark.createDataFrame([], "package string, score double, rank int")
        query = sorted(tokens_of(q))
        if self._found(query).limit(search.RERANK_BELOW).count() < search.RERANK_BELOW:
            best = self.search(q).orderBy(*search.hit_order()).limit(k)
        else:
            idfs, score = self._scored(query)
            best = blocks.top(self.blocks, self.ranges, self.hits.withColumn("place", F.col("doc_id")), idfs, k, score, search.hit_order()[1:]).hits
        # k rows
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*search.hit_order())))

    def results(self, q: str, number: int = 1) -> dict:
        """One page of folded, marked-up results with totals and page links."""
        query = tokens_of(q)
        if self.segment is None:
            return {"total": 0, "entries": 0, "folded": 0, "docs": [], "pages": search.page_links(number, 0)}
        hits = self.search(q).select("package", "name", "synopsis", "score", "star_count").cache()
        rows = search.folded(hits, search.hit_key()).cache()
        try:
            total, shown = rows.count(), rows.filter("parent IS NULL")
            entries = shown.count()
            page = search.page(shown, search.hit_order(), number)
            subs = rows.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("up")).agg(F.array_sort(F.collect_list("package")).alias("subs"))
            full = self.hits_full.select("package", "description")
            page = page.join(subs, page["package"] == subs["up"], "left").join(full, "package").select(
                "package", "score", "star_count", sentences.marks(query)(paths.display_name(F.col("name"), F.col("package"))).alias("name"), sentences.marks(query)("package").alias("marked"),
                sentences.marks(query)(sentences.snippets(query)("description")).alias("summary"), F.coalesce("subs", F.array().cast("array<string>")).alias("subs"),
            )
            docs = [r.asDict() for r in page.orderBy(*search.hit_order()).collect()]
            # ranks of what is shown only
            for d, n in zip(docs, search.before(hits, [(d["package"], d["score"], d["star_count"]) for d in docs]), strict=True):
                d["rank"] = n + 1
        finally:
            rows.unpersist()
            hits.unpersist()
        return {"total": total, "entries": entries, "folded": total - entries, "docs": docs, "pages": search.page_links(number, search.pages(entries))}

    def _listed(self, name: str | None = None) -> DataFrame:
        """The row of a package, or all rows, with ``imported`` and ``test_imported``: the lists of its importers."""
        one = F.lit(True) if name is None else F.col("package") == name
        lists = self.importers.filter(one).groupBy("package").agg(
            F.array_sort(F.collect_list(F.when(~F.col("test"), F.col("importer")))).alias("imported"), F.array_sort(F.collect_list(F.when(F.col("test"), F.col("importer")))).alias("test_imported")
        )
        empty = F.array().cast("array<string>")
        return self.hits_full.filter(one).join(lists, "package", "left").withColumns({c: F.coalesce(c, empty) for c in ("imported", "test_imported")})

    def package(self, name: str) -> DataFrame:
        """The API row of a package; its rank counts from one."""
        return self._listed(name).select(
            "package", "name", F.greatest("star_count", F.lit(0)).alias("stars"), "synopsis", "description", "imports", "test_imports", "imported", "test_imported", "project_url", (F.col("static_rank") + 1).alias("static_rank"), "readme_fn", "readme_data"
        )

    def view(self, name: str) -> DataFrame:
        """``package`` with whether its readme is worth showing, cut to 20 KiB."""
        rows = self.package(name)
        return rows.withColumn("show_readme", search.shows_readme(F.col("description"), F.col("readme_data"))).withColumn("readme_data", packages.cut_bytes(F.col("readme_data"), 20 * 1024))

    def packages(self) -> DataFrame:
        return self.hits.select("package", "doc_id").orderBy("doc_id").select("package")

    def depends(self, name: str) -> DataFrame:
        return self._listed(name).select("package", "name", "imports", "test_imports", "imported", "test_imported")

    def tops(self, n: int = 20) -> DataFrame:
        rows = self.hits.select("package", "name", "static_score", "test_static_score", "imported_len", "test_imported_len", "star_count", "project_url")
        return tops.report(rows, min(max(n, 20), 100), F.col("project_url"))

    def totals(self) -> DataFrame:
        return self.hits.agg(F.count("*").alias("packages"), F.countDistinct("project_url").alias("projects"))

    def badge(self, name: str) -> DataFrame:
        return self.hits.filter(F.col("package") == name).select(search.badge(F.col("static_rank") + 1).alias("svg"))

    def found(self, q: str) -> DataFrame:
        """The first hits of a query as the interface returns them, best first."""
        top = self.top(q).select("rank", "name", "package", "author", "synopsis", "project_url")
        return top.join(self.hits_full.select("package", "description"), "package").orderBy("rank")

    def api(self, action: str, callback: str = "", **params) -> tuple[int, str]:
        """(status, JSON or JSONP body) of an action: package, packages, package_depends, tops, search."""
        action = action.lower()
        runs = self._runs(action)
        if runs is not None:
            return self._say(200, "[" + "".join(r["text"] for r in runs.orderBy("run").toLocalIterator()) + "]", callback)
        if action == "package":
            name = params.get("id", "")
            keys = {"package": "Package", "name": "Name", "stars": "StarCount", "synopsis": "Synopsis", "description": "Description", "imported": "Imported", "test_imported": "TestImported", "imports": "Imports", "test_imports": "TestImports", "project_url": "ProjectURL", "static_rank": "StaticRank"}
            bodies = self._json(self.package(name), keys)
            return self._say(200, bodies[0], callback) if bodies else self._say(404, json.dumps(f"Package {name} not found!"), callback)
        if action == "tops":
            size = str(params.get("len", ""))
            lists: dict[str, dict] = {}
            for r in self.tops(int(size) if size.isdigit() else 0).orderBy("place").collect():
                items = lists.setdefault(r["list"], {"Name": r["list"], "Info": r["about"], "Items": []})["Items"]
                items.append({"Index": r["place"], "Name": r["name"], "Package": r["package"], "Link": r["link"], "Info": r["info"]})
            bodies = [json.dumps(lists[k], ensure_ascii=False) for k in ("Hot", "Hot Test", "Most Imported", "Sites") if k in lists]
        elif action == "search":
            q = str(params.get("q", "")).strip()
            hits = self._json(self.found(q), search.API_KEYS)
            return self._say(200, '{"query":' + json.dumps(q, ensure_ascii=False) + ',"hits":[' + ",".join(hits) + "]}", callback)
        else:
            return self._say(400, json.dumps(f"Unknown action: {action}"), callback)
        return self._say(200, "[" + ",".join(bodies) + "]", callback)

    def answer(self, action: str, callback: str = "", **params) -> DataFrame:
        """``api`` as one row (status, body). Executors put the list of all packages together; it does not pass through the driver."""
        runs = self._runs(action.lower())
        if runs is None:
            return self.spark.createDataFrame([self.api(action, callback, **params)], "status int, body string")
        head, tail = self._say(200, "[\n]", callback)[1].split("\n")
        return search.json_list(runs, head, tail).select(F.lit(200).alias("status"), "body")

    def _runs(self, action: str) -> DataFrame | None:
        """The list of an action that gives all packages, in runs (``search.json_runs``); None for other actions."""
        if action == "packages":
            one = F.to_json(F.array("package"))
            return search.json_runs(self.hits.select(F.col("doc_id").alias("place"), F.substring(one, F.lit(2), F.length(one) - 2).alias("j")))
        if action == "package_depends":
            keys = {"name": "Name", "package": "Package", "imports": "Imports", "test_imports": "TestImports", "imported": "Imported", "test_imported": "TestImported"}
            return search.json_runs(self._listed().select(F.col("doc_id").alias("place"), search.as_json(keys).alias("j")))
        return None

    def _json(self, rows: DataFrame, keys: dict[str, str]) -> list[str]:
        """One JSON object for each row, in the order of the rows; ``keys`` renames its columns."""
        return [r["j"] for r in rows.select(search.as_json(keys).alias("j")).toLocalIterator()]

    def _say(self, code: int, body: str, callback: str) -> tuple[int, str]:
        name = "".join(c for c in callback if c.isascii() and (c.isalnum() or c in "_$"))
        return code, f"{name}({code}, {body});" if name else body
