from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docengine.operators import chunks, filters, pagination, ranking, search
from docengine.plans import lookup
from docengine.plans import search as plan

DOCS = [
    ("swiftui/view", "View", "symbol", "Protocol", "A type that represents part of your interface.", "protocol View", "apple-docc", "swift", None, 1),
    ("swiftui/navigationstack", "NavigationStack", "symbol", "Structure", "A view that displays a root view.", "struct NavigationStack", "apple-docc", "swift", "16.0", 1),
    ("swiftui/navigationview", "NavigationView", "symbol", "Structure", "Presents a stack of views.", "struct NavigationView", "apple-docc", "swift", "13.0", 1),
    ("uikit/uiview", "UIView", "symbol", "Class", "An object that manages content.", "class UIView", "apple-docc", "both", "2.0", 1),
    ("design/buttons", "Buttons", "article", "Article", "A button initiates an action.", None, "hig", None, None, 1),
    ("wwdc/wwdc2021-10018", "Discover concurrency in SwiftUI", "article", "Session", "Learn about async await.", None, "wwdc", None, None, 1),
    ("wwdc/wwdc2020-10041", "What's new in SwiftUI", "article", "Session", "New features.", None, "wwdc", None, None, 1),
    ("apple-archive/old/view", "View Programming Guide", "article", "Article", "Old views.", None, "apple-archive", None, None, 2),
    ("swiftui/release-notes/x", "SwiftUI release notes", "article", "Article", "Changes of the view.", None, "apple-docc", None, None, 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    names = "key string, title string, role string, role_heading string, abstract string, declaration string, source_type string, language string, min_ios string, url_depth int"
    d = spark.createDataFrame(DOCS, names).withColumn("id", F.monotonically_increasing_id()).withColumn("path", F.col("key"))
    year = F.regexp_extract("key", r"wwdc(\d{4})-", 1)
    extra = {
        "framework": F.substring_index("key", "/", 1), "root_slug": F.substring_index("key", "/", 1), "doc_kind": F.lower("role_heading"), "headings": F.lit(""), "body": F.concat("abstract", F.lit(" Body about gesture recognizers.")),
        "is_deprecated": F.col("key") == "swiftui/navigationview", "is_beta": F.lit(False), "is_release_notes": F.col("key").contains("release-notes"), "platforms": F.when(F.col("key") == "design/buttons", '{"macos":"11"}'),
        "source_metadata": F.when(year != "", F.concat(F.lit('{"year":'), year, F.lit(',"track":"SwiftUI & UI"}'))),
    }
    return d.coalesce(1).withColumns(extra).persist()


@pytest.fixture(scope="module")
def corpus(docs, spark):
    return plan.build(docs, synonyms=spark.createDataFrame([*search.SYNONYMS, ("swiftui", "uikit")], "canonical string, alias string"))


def paths(corpus, q, **kw):
    return [r["path"] for r in plan.ranked(corpus, q, **kw).results]


def test_parse():
    g = search.parse("NavigationStack.path view")
    assert g.groups == (search.Group(("navigationstack", "path", "navigationstackpath"), ("navigation", "stack")), search.Group(("view",)))
    assert search.parse("async-await").groups == (search.Group(("async-await",)),)
    assert search.parse('"exact" OR pre*').any and search.parse('"exact" OR pre*').groups == (search.Group((), ("exact",)), search.Group(("pre",)))
    assert search.parse("  ./ ").groups == ()


def test_ranked(corpus):
    assert paths(corpus, "View")[0] == "swiftui/view"
    assert paths(corpus, "NavigationStack")[0] == "swiftui/navigationstack"
    assert "swiftui/navigationview" in paths(corpus, "Navigation")
    assert paths(corpus, "Buttins")[0] == "design/buttons"  # fuzzy
    assert paths(corpus, "gesture recognizers") and set(paths(corpus, "gesture recognizers")) == {d[0] for d in DOCS}  # body
    assert paths(corpus, "  ") == [] and paths(corpus, "zzzz qqqq") == []
    a = plan.ranked(corpus, "how do you use the concurrency zzz in swiftui")
    assert a.relaxed == "pruned-or" and a.results[0]["match_quality"] == "relaxed-or"
    assert plan.ranked(corpus, "View", limit=1).has_more
    page = plan.ranked(corpus, "View", limit=2, offset=1).results
    assert [r["path"] for r in page] == paths(corpus, "View", limit=3)[1:3]
    assert {"snippet", "confidence", "related_count"} <= set(page[0])
    assert paths(corpus, "View", fast=True, limit=1) == ["swiftui/view"]


def test_filters(corpus):
    f = filters.Filters
    assert set(paths(corpus, "View", f=f(sources=("apple-archive",)))) == {"apple-archive/old/view"}
    assert "swiftui/navigationview" not in paths(corpus, "Navigation", f=f(deprecated="exclude"))
    assert set(paths(corpus, "SwiftUI", f=f(year=2021))) == {"wwdc/wwdc2021-10018"}
    assert paths(corpus, "SwiftUI", f=f(track="nothing")) == []
    assert "swiftui/navigationstack" not in paths(corpus, "Navigation", f=f(min_versions={"ios": "14"}))
    assert set(paths(corpus, "View", f=f(kind="Class"))) == {"uikit/uiview"}
    assert "uikit/uiview" in paths(corpus, "View", f=f(frameworks=("swiftui",)))  # a synonym's
    assert "design/buttons" not in paths(corpus, "Buttons", f=f(platform="ios"))
    assert filters.parse_sources("A, b,,") == ("a", "b") and filters.parse_sources(None) == () and filters.parse_deprecated("ONLY ") == "only" and filters.parse_deprecated("x") == "include"


def test_semantic_fusion(docs, spark):
    rnd = random.Random(2)
    vec = {r["id"]: [rnd.gauss(0, 1) for _ in range(64)] for r in docs.select("id").collect()}
    target = docs.where("key = 'design/buttons'").first()["id"]
    chunks_ = spark.createDataFrame([(i, i, 0, v) for i, v in vec.items()], "chunk_id long, document_id long, ord int, vector array<double>")
    from docengine.operators import semantic

    c = plan.build(docs, chunks=semantic.build_chunk_index(chunks_), embed=lambda q: vec[target])
    assert "design/buttons" in paths(c, "NavigationStack") and paths(c, "NavigationStack")[0] == "swiftui/navigationstack"
    assert "design/buttons" in paths(c, "NavigationStack", rrf=True)


def test_transient_and_invalid(spark):
    df = spark.createDataFrame([("HTTP 503 x", "a/b"), ("HTTP 404 x", "A/b"), (None, "a#b"), ("socket hang up", None)], "e string, p string")
    got = df.select(filters.is_transient_error(F.col("e")), filters.is_invalid_path(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, True), (True, True)]


def test_mmr_against_naive():
    rnd = random.Random(9)
    for n in [0, 1, 2, 3, 8, 30] * 40:
        codes = [None if rnd.random() < 0.2 else [rnd.getrandbits(64) - (1 << 63)] for _ in range(n)]
        lam = rnd.random()
        left, out = list(range(n)), []
        if n <= 2:
            out, left = left, []
        while left:
            score = lambda i: lam * (n - i) / n - (1 - lam) * max([0.0, *(ranking.hamming_similarity(codes[i], codes[j]) for j in out if codes[i] and codes[j])])  # noqa: B023, E731
            best = left[0] if not out else max(left, key=lambda i: (score(i), -i))  # noqa: B023
            out.append(best)
            left.remove(best)
        assert ranking.mmr(list(range(n)), lambda i: codes[i], ranking.hamming_similarity, lam) == out  # noqa: B023


def test_rerank_order():
    rows = [{"score": 1.0, "match_quality": "match", "source_type": "wwdc"}, {"score": 1.0005, "match_quality": "body", "source_type": "hig"}, {"score": 1.0, "match_quality": "match", "source_type": "HIG"}, {"score": 5.0, "match_quality": "body", "source_type": None}]
    assert [rows.index(r) for r in ranking.rerank_rows(rows)] == [3, 2, 0, 1]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "x", 1)], "query string, key string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("s", "y")], "query string, key string")
    got = {r["query"]: (round(r["recall"], 4), round(r["ndcg"], 4), r["mrr"]) for r in ranking.ir_metrics(ranked, rel).collect()}
    assert got == {"q": (0.5, 0.3869, 0.5), "s": (0.0, 0.0, 0.0)}


def test_chunks(spark):
    from docengine.operators.chunks import windows

    rnd = random.Random(6)
    texts = ["", "a", "x" * 880, "x" * 881, "".join(rnd.choice("abc ") for _ in range(3000))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", windows(F.col("t")).alias("w")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        want, i = [], 0
        while True:
            want.append(t[i : i + 880])
            if i + 880 >= len(t):
                break
            i += 720
        assert r["w"] == want
    docs = spark.createDataFrame([(1, "T", "", "H"), (2, None, "A", None)], "id long, title string, abstract string, headings string")
    secs = spark.createDataFrame([(1, "abstract", 0, None, "own"), (1, "Declaration", 1, None, "skip"), (1, "restParameters", 2, None, "skip"), (1, "discussion", 3, "Head", "x" * 9000), (2, "abstract", 0, None, "skip")], "document_id long, section_kind string, sort_order int, heading string, content_text string")
    out = {(r["document_id"], r["ord"]): r["text"] for r in chunks.chunk(docs, secs).collect()}
    assert out[1, 0] == "T. H" and out[2, 0] == "A" and out[1, 1] == "own" and out[1, 2].startswith("Head. xxx") and len(out) == 9


def test_lookup_and_pages(docs, spark):
    secs = docs.select(F.col("id").alias("document_id"), F.lit("discussion").alias("section_kind"), F.lit("Overview").alias("heading"), F.col("body").alias("content_text"), F.lit(0).alias("sort_order"))
    edges = spark.createDataFrame([("swiftui/view", "uikit/uiview", "see_also", None, 0)], "from_key string, to_key string, relation_type string, section string, sort_order int")
    got = lookup.read(docs, secs, edges, path="/documentation/SwiftUI/View/", query="interface")
    assert got["key"] == "swiftui/view" and got["relations"]["seeAlso"] == 1 and "# View" in got["markdown"] and "interface" in got["excerpts"][0]
    assert lookup.read(docs, secs, edges, title="view")["key"] == "swiftui/view" and lookup.read(docs, secs, edges, path="nothing") is None
    roots = spark.createDataFrame([(1, "wwdc", "WWDC"), (2, "swiftui", "SwiftUI")], "root_id int, slug string, display_name string")
    pages = docs.select("path", "title", F.when(F.col("framework") == "wwdc", 1).when(F.col("framework") == "swiftui", 2).otherwise(3).alias("root_id"), F.lit("active").alias("status"))
    assert [tuple(r) for r in lookup.browse(roots, pages, "wwdc").collect()] == [(2021, 1), (2020, 1)]
    assert lookup.browse(roots, pages, "wwdc", year=2020).count() == 1 and lookup.browse(roots, pages, "SwiftUI", limit=2).count() == 2
    assert lookup.browse(roots, pages, "swiftui", edges, "swiftui/view").first()["title"] == "UIView"


def test_pagination():
    items = [{"x": "y" * n} for n in (5, 50, 500, 5, 5)]
    for p in pagination.with_totals(items, 200, {"query": "q"}):
        assert p["totalPages"] == 3
    assert sum((p["items"] for p in pagination.with_totals(items, 200, {})), []) == items
    for budget in (5, 40, 1000):
        parts = pagination.split_text("para one\n\npara two\nline " + "é" * 60, budget)
        assert all(len(p.encode()) <= budget for p in parts) and "".join(parts).replace("\n", "") == ("para onepara two" + "line " + "é" * 60)
    pages = pagination.paginate_document([{"heading": "A", "content": "x " * 400}, {"heading": "B", "content": "y"}], 300)
    assert "".join(s["content"] for p in pages for s in p if s["heading"] == "A").replace(" ", "") == "x" * 400
    assert pagination.excerpts("aaa needle bbb", "NEEDLE", context=2) == ["...a needle b..."] and pagination.excerpts("x", "") == []
