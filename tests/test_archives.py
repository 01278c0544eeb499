from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docengine import content_queries
from docengine.sources import adapters, archives, base  # noqa: F401 - adapters register themselves

COLUMNS = {"name": 0, "type": 1, "url": 2, "platform": 3}


def test_catalogue(spark):
    rows = [
        ["First &amp; best", 3, "../documentation/A/Guide/index.html#x", "X"],
        ["Copy", "3", "documentation/A/Guide/guide.htm", "X"],
        ["Page", "3", "documentation/A/Guide/ch1.html", None],
        ["Other type", "5", "documentation/A/no.html", "X"],
        ["Skipped", "3", "documentation/QuickTime/whatsnew.htm", "X"],
        ["Zip", "3", "documentation/A/x.zip", "X"],
        ["Short"],
        ["Bare", "3", "featuredarticles/Bare", "X"],
    ]
    strict = json.dumps({"columns": COLUMNS, "documents": rows})
    loose = "({columns: {name: 0, type: 1, url: 2,}, documents: [['no'], ]})".replace("'", '"')
    more = '({columns: {name: 0, type: 1, url: 2, platform: 3}, documents: [["L, {x}", "3", "documentation/L/One.pdf", "X",], ],})'
    table = spark.createDataFrame([(x,) for x in (strict, loose, more, "", None, "{", '{"documents": 3}')], "payload string")
    got = {r["key"]: r for r in archives.catalogue(table).collect()}
    assert {k: r["title"] for k, r in got.items()} == {
        "apple-archive/documentation/A/Guide": "First & best", "apple-archive/documentation/A/Guide/ch1.html": "Page", "apple-archive/featuredarticles/Bare": "Bare",
        "apple-archive/documentation/L/One.pdf": "L, {x}",
    }
    assert got["apple-archive/documentation/A/Guide"]["url"] == "https://developer.apple.com/library/archive/documentation/A/Guide/index.html"
    assert got["apple-archive/documentation/L/One.pdf"]["format"] == "pdf"
    assert json.loads(got["apple-archive/documentation/A/Guide/ch1.html"]["source_metadata"])["archivePath"] == "documentation/A/Guide/ch1.html"
    assert archives.catalogue(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://x.github.io/CareKit/documentation/CareKit/OCKTask/", ("carekit", "https://x.github.io/CareKit", "carekit/ocktask")),
        ("HTTPS://Security.org:8443/documentation/private?q=/documentation/z#y", ("private", "https://security.org:8443", "private")),
        ("http://x.org/documentation/a", None),
        ("https://developer.apple.com/documentation/a", None),
        ("https://beta.developer.apple.com/documentation/a", None),
        ("https://notdeveloper.apple.com.org/a/b/documentation/c", ("c", "https://notdeveloper.apple.com.org/a/b", "c")),
        ("https://x.org/documentation/", None),
        ("https://x.org/documentation/a//b", None),
        ("https://x.org/documentation/a/..<(_:_:)", None),
        ("https://x.org/documentation/one/documentation/two", ("one", "https://x.org", "one/documentation/two")),
        ("https://x.org/page?to=/documentation/a", None),
        ("", None),
        (None, None),
    ],
)
def test_archive_url(spark, url, want):
    got = spark.createDataFrame([(url,)], "u string").select(archives.archive_url(F.col("u")).alias("a")).first()["a"]
    assert (tuple(got) if got else None) == want


def test_detected_and_listed(spark):
    pages = spark.createDataFrame([("https://x.org/documentation/kit", None), ("https://y.org/documentation/kit/a", "Y"), ("https://z.org/documentation/known", "Z"), (None, "N")], "url string, title string")
    got = archives.detected_archives(pages, spark.createDataFrame([("known",)], "slug string")).collect()
    assert [tuple(r) for r in got] == [("kit", "https://x.org", "kit", "kit")]
    tree = json.dumps({"interfaceLanguages": {"swift": [{"path": "/documentation/kit", "children": [{"path": "/documentation/Kit/A"}, {"path": "/documentation/other/b"}]}]}})
    index = spark.createDataFrame([("kit", tree), ("bad", "["), ("none", None), ("list", "[1]"), ("odd", '{"interfaceLanguages": []}')], "slug string, payload string")
    assert sorted(tuple(r) for r in archives.listed_pages(index).collect()) == [("kit", "kit", 0), ("kit", "kit/a", 1)]
    assert sorted(r["key"] for r in archives.listed_pages(index, scope=True).collect()) == ["kit/documentation/kit", "kit/documentation/kit/a", "kit/documentation/other/b"]


def test_a_crawl_needs_no_limit_and_leaves_owned_slugs_out(spark):
    def page(*to):
        return json.dumps({"topicSections": [{"identifiers": [f"doc://o/documentation/{t}" for t in to]}]})

    pages = [("a", page("a/1", "b", "a/gone")), ("a/1", page("a/2", "a")), ("a/2", page()), ("a/far", page()), ("b", page("b/1")), ("b/1", page()), ("c", page("c/1")), ("c/1", page())]
    table = spark.createDataFrame(pages, "key string, payload string")
    own = spark.createDataFrame([("b", "packages"), ("c", None), ("a", "external-docc")], "slug string, source_type string")
    slugs, index = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "slug string"), spark.createDataFrame([], "slug string, payload string")
    got = archives.enumerate_archives(slugs, index, table, own)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "a"), ("a", "a/1"), ("a", "a/2")]


def test_scoped_keys(spark):
    raw = spark.createDataFrame([("comp/documentation/diag", json.dumps({"metadata": {"title": "D"}, "topicSections": [{"title": "T", "identifiers": ["doc://o/documentation/diag/x"]}], "references": {}})), ("other/x", json.dumps({"metadata": {"title": "O"}}))], "key string, payload string")
    bundles = base.adapter("swift-docc").normalize(raw)
    got = {r["document"]["key"]: r for r in archives.scoped(bundles, spark.createDataFrame([("comp", "https://docs.org/c")], "slug string, base_url string")).collect()}
    assert [(r["from_key"], r["to_key"]) for r in got["comp/documentation/diag"]["relationships"]] == [("comp/documentation/diag", "comp/documentation/diag/x")]
    assert got["comp/documentation/diag"]["document"]["url"] == "https://docs.org/c/documentation/diag"
    assert got["other/x"]["document"]["url"] == bundles.where("document.key = 'other/x'").first()["document"]["url"]


def test_entry_points_come_last(spark):
    raw = spark.createDataFrame([("swift-org/a", "<title>A | Swift.org</title><main><p>x</p><h2>H</h2><p>y</p></main>"), ("swift-org/b", "")], "key string, payload string")
    registry = spark.createDataFrame([(["swift-org/a", "none"], "k2", "Two", None), (["swift-org/a"], "k1", "One", "first"), (["swift-org/a"], "k1", "One", "first")], "parents array<string>, key string, title string, summary string")
    bundles = base.adapter("swift-org").normalize(raw)
    got = {r["document"]["key"]: r for r in archives.with_entry_points(bundles, registry).collect()}
    last = got["swift-org/a"]["sections"][-1]
    assert (last["section_kind"], last["content_text"], last["sort_order"]) == ("topics", "One: first\nTwo:", 2)
    items = json.loads(last["content_json"])[0]["items"]
    assert [x["key"] for x in items] == ["k1", "k2"] and items[0]["abstract"] == [{"type": "text", "text": "first"}] and items[1]["abstract"] is None
    assert [(e["to_key"], e["relation_type"], e["sort_order"]) for e in got["swift-org/a"]["relationships"]] == [("k1", "see_also", 0), ("k2", "see_also", 1)]
    assert got["swift-org/b"] == {r["document"]["key"]: r for r in bundles.collect()}["swift-org/b"]


def test_chapters(spark):
    root = f"tspl/{archives.BOOK_ROOT}"
    text = "# Book\n\nAbout.\n\n## Topics\n\n### One\n- <doc:Basics>\n- <doc:GONE>\n### None\ntext\n### Two\n- <doc:basics>\n"
    raw = spark.createDataFrame([(root, text), ("tspl/GuidedTour/Basics", "x"), ("tspl/LanguageGuide/basics", "# Own title"), ("tspl/ABCNotes", None)], "key string, payload string")
    got = {r["document"]["key"]: r for r in archives.with_chapters(base.adapter("swift-book").normalize(raw), raw).collect()}
    assert [(e["to_key"], e["section"], e["sort_order"]) for e in got[root]["relationships"]] == [("tspl/GuidedTour/Basics", "One", 0), ("tspl/GuidedTour/Basics", "Two", 1)]
    topics = [s for s in got[root]["sections"] if s["heading"] == "Topics"]
    assert [s["section_kind"] for s in topics] == ["topics"]
    assert [[i["key"] for i in g["items"]] for g in json.loads(topics[0]["content_json"])] == [["tspl/GuidedTour/Basics", None], ["tspl/GuidedTour/Basics"]]
    assert {k: r["document"]["title"] for k, r in got.items()} == {root: "Book", "tspl/GuidedTour/Basics": "Basics", "tspl/LanguageGuide/basics": "Own title", "tspl/ABCNotes": "ABC Notes"}
    assert json.loads(got["tspl/LanguageGuide/basics"]["document"]["source_metadata"]) == {"bookSection": "Language Guide", "bookSectionDir": "LanguageGuide"}
    assert got["tspl/ABCNotes"]["document"]["source_metadata"] is None and got[root]["document"]["kind"] == "collection"


def test_a_catalogue_is_parsed_once(spark):
    """The plan has the parser twice: as it is, and mended where that fails."""
    table = spark.createDataFrame([("{}",)], "payload string").selectExpr("concat(payload, '') as payload")
    plan = archives.catalogue(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and plan.count(" concat(payload") <= 1


def test_pages_of_a_site_are_read_once(spark):
    """Whether a page has moved is told in the same pass, page by page: nothing is joined or shuffled for it."""
    moved = '<title>Redirecting</title><link rel="canonical" href=" https://x.org/new ">'
    rows = [("apple-archive/a", moved), ("apple-archive/a", "<title>A</title><main><p>x</p></main>"), ("apple-archive/b", "<title>B</title><main><p>y</p></main>"), ("apple-archive/c", None), ("apple-archive/d", "<title>Redirecting</title>")]
    bundles = base.adapter("apple-archive").normalize(spark.createDataFrame(rows, "key string, payload string"))
    plan = bundles._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Union" not in plan
    got = sorted((r["document"]["key"], r["document"]["kind"], r["document"]["title"], r["document"]["url"]) for r in bundles.collect())
    assert got == [
        ("apple-archive/a", "article", "A", None), ("apple-archive/a", "redirect", "Moved to https://x.org/new", "https://x.org/new"), ("apple-archive/b", "article", "B", None),
        ("apple-archive/c", "article", "c", None), ("apple-archive/d", "article", "Redirecting", None),
    ]


def test_brackets_around_a_catalogue(spark):
    mend = r"(?s)^\((.*)\)$"
    odd = spark.createDataFrame([(x,) for x in ("", None, "(", ")", "()", "(a)", "((é))", "(a)\n", "(a)\r\n", "(a)x", "a)", "(a\n)b)")], "p string")
    assert odd.where(~archives._unwrapped(F.col("p")).eqNullSafe(F.regexp_replace("p", mend, "$1"))).count() == 0


def test_names_of_guides_that_go_are_not_decoded(spark):
    table = spark.createDataFrame([("{}",)], "payload string")
    plan = archives.catalogue(table)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, x in enumerate(plan) if "Aggregate" in x)
    assert any("&amp;" in x for x in plan[:first]) and not any("&amp;" in x for x in plan[first:])


def test_words_are_letters_and_single_spaces(spark):
    odd = ("", None, " ", "a", "don't  stop", " -  a\t b\n\nc ", "é ü", "日本 語", "x" * 5000 + ".", "a - - b", " a b")
    old = F.concat(F.lit("L "), F.trim(F.regexp_replace(F.regexp_replace("p", "[^A-Za-z ]+", ""), " +", " ")), F.lit("."))
    table = spark.createDataFrame([(x,) for x in odd], "p string")
    assert table.where(~content_queries.words(F.col("p")).eqNullSafe(old)).count() == 0


def test_lines_of_a_document(spark):
    odd = ("", None, "\n", "\n\n", "a", "a\n", "a\nb", "a\nb\n", "a\n\nc", "\n\n\nd", "é1\nü\n日 x\ny\n", "a\r\nb\rc\n\r\nd")
    table = spark.createDataFrame([(x,) for x in odd], "text string")
    for n in (1, 2, 3):
        assert table.where(~content_queries.line(n).eqNullSafe(content_queries.words(F.split_part("text", F.lit("\n"), F.lit(n))))).count() == 0
    assert table.where(~content_queries.after_lines(2).eqNullSafe(F.regexp_replace("text", content_queries._HEAD, ""))).count() == 0
