from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docengine.functions import trees, urls
from docengine.operators import corpus_stats, docc, graph, html, maintenance, markdown
from docengine.operators.client_search import build, query_terms
from docengine.operators.client_search import search as title_search
from docengine.plans import sync
from docengine.sources import adapters, snapshot, versions
from docengine.sources.base import SourceAdapter, adapter, register, validate
from docengine.streaming import incremental

PAGE = """<!DOCTYPE html><html><head><title>The &amp; Page</title><meta content="A &lt;b&gt;" name="description"></head><body><nav><a href="/x">no</a></nav><main>
<h1>Top</h1><p>Lead <b>bold</b> <a href="/docs/a">link</a> and <code>a`b</code>.</p><section><h2>First <i>part</i></h2><p>One</p><ul><li>a</li><li>b <em>c</em></li></ul></section>
<h2>Second</h2><pre>  x = 1
  y</pre><dl><dt>T</dt><dd>D</dd></dl><ol><li>n</li></ol><script>bad()</script></main></body></html>"""  # fmt: skip


def test_html_parser():
    d = html.parse(PAGE, preserve=True)
    assert d["title"] == "The & Page" and d["description"] == "A <b>"
    assert [s["heading"] for s in d["sections"]] == [None, "First part", "Second"]
    assert d["sections"][0]["content"].endswith("Lead **bold** [link](/docs/a) and `a'b`.")
    assert d["sections"][1]["content"] == "One\n\n- a\n- b *c*"
    assert d["sections"][2]["content"] == "```\n  x = 1\n  y\n```\n\n**T** — D\n\n1. n"
    assert html.parse("", True)["sections"] == [] and html.parse(None)["title"] is None
    assert html.parse("<p>only <div>nested<div>text")["sections"][0]["content"] == "only\n\nnested\n\ntext"
    assert html.parse("<div id=content><h3>A</h3>x</div>")["sections"] == [{"heading": "A", "content": "x"}]
    resolve = lambda h: None if h == "/docs/a" else h
    assert "link and" in html.parse(PAGE, True, resolve=resolve)["sections"][0]["content"]
    html.parse("<div>" * 300 + "deep")


def test_html_columns(spark):
    moved = '<html><head><title>Redirecting...</title><meta http-equiv="refresh" content="0; url=/new"></head></html>'
    df = spark.createDataFrame([(1, PAGE), (2, moved), (3, None)], "page_id int, html string")
    h = F.col("html")
    out = df.select("page_id", html.title(h).alias("t"), html.meta_content(h, "name", "description").alias("d"), html.redirect_target(h).alias("r"), html.plain_text(F.lit("<p>a</p>b<br>c &lt;<b>d</b>")).alias("p")).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in out] == [("The & Page", "A <b>", None, "a\n\nb\n\nc < d"), ("Redirecting...", None, "/new", "a\n\nb\n\nc < d"), (None, None, None, "a\n\nb\n\nc < d")]
    links = html.links(df).select("href", "section").collect()
    assert sorted(tuple(r) for r in links) == [("/docs/a", "breadcrumb"), ("/x", "breadcrumb")]
    assert html.sections(df).where("page_id = 1").count() == 3 and html.markdown(df).count() == 3


def test_markdown():
    text = "---\ntitle: 'T'\ntags:\n  - a\n  - b\nnote: long\n  text\n---\n# Head\n\nFirst para.\n\n## One\nx\n\n## Two\n\n### Three\ny\n"
    values, body = markdown.front_matter(text)
    assert values == {"title": "T", "tags": ["a", "b"], "note": "long text"} and body.startswith("# Head")
    assert markdown.front_matter("--- x\n") == (None, "--- x\n") and markdown.front_matter("---\nno end") == (None, "---\nno end")
    d = markdown.normalize(text, "k")
    assert (d["title"], d["abstract_text"], d["headings"]) == ("Head", "First para.", "One Two")
    assert [(s["section_kind"], s["heading"], s["content_text"], s["sort_order"]) for s in d["sections"]] == [("abstract", None, "First para.", 0), ("discussion", "One", "x", 1), ("discussion", "Two", "### Three\ny", 2)]
    assert markdown.normalize(None, "k")["sections"] == []
    assert markdown.split_headings("a\n## b\nc\n## \n") == [(None, "a"), ("b", "c")]
    assert markdown.read_yaml(markdown.write_yaml({"a": "x: y", "b": ["p", "q"], "c": True}).strip("-\n")) == {"a": "x: y", "b": ["p", "q"], "c": "true"}
    out = markdown.render({"title": "T", "key": "k"}, [{"section_kind": "declaration", "content_text": "let x", "sort_order": 1}, {"section_kind": "abstract", "content_text": "A", "sort_order": 0}, {"section_kind": "topics", "content_text": "a\nb", "sort_order": 2}])
    assert out == "---\ntitle: T\nkey: k\n---\n\n\n# T\n\nA\n\n## Declaration\n\n```swift\nlet x\n```\n\n## Topics\n\n- a\n- b\n"


DOCC = {
    "metadata": {"title": "View", "role": "symbol", "roleHeading": "Protocol", "symbolKind": "protocol", "modules": [{"name": "SwiftUI"}], "platforms": [{"name": "iOS", "introducedAt": "13.0"}, {"name": "macOS"}], "beta": True},
    "abstract": [{"type": "text", "text": "A "}, {"type": "codeVoice", "code": "type"}, {"type": "reference", "identifier": "doc://x/documentation/SwiftUI/Text"}],
    "primaryContentSections": [
        {"kind": "declarations", "declarations": [{"languages": ["swift"], "tokens": [{"text": "protocol "}, {"text": "View"}]}]},
        {"kind": "parameters", "parameters": [{"name": "p", "content": [{"type": "paragraph", "inlineContent": [{"type": "text", "text": "a value"}]}]}]},
        {"kind": "content", "content": [{"type": "heading", "text": "Overview"}, {"type": "unorderedList", "items": [{"content": [{"type": "paragraph", "inlineContent": [{"type": "strong", "inlineContent": [{"type": "text", "text": "item"}]}]}]}]}, {"type": "aside", "style": "Tip", "content": [{"type": "paragraph", "inlineContent": [{"type": "text", "text": "t"}]}]}]},
    ],
    "topicSections": [{"title": "Basics", "identifiers": ["doc://x/documentation/SwiftUI/Text", "doc://com.externally.resolved/y"]}],
    "relationshipsSections": [{"type": "conformsTo", "title": "Conforms To", "identifiers": ["doc://x/documentation/Swift/Equatable"]}],
    "seeAlsoSections": [{"title": "More", "identifiers": ["doc://x/documentation/SwiftUI/App"]}],
    "references": {"doc://x/documentation/SwiftUI/Text": {"title": "Text", "url": "/documentation/swiftui/text", "type": "topic", "abstract": [{"type": "text", "text": "x"}]}, "m": {"type": "topic", "url": "/documentation/swiftui/mentioned", "abstract": [1]}},
}


def test_docc(spark):
    b = docc.normalize(DOCC, "swiftui/view")
    d = b["document"]
    assert (d["title"], d["kind"], d["language"], d["abstract_text"], d["declaration_text"], d["headings"], d["platforms_json"], d["min_ios"], d["is_beta"], d["url_depth"]) == ("View", "protocol", "swift", "A typeText", "protocol View", "Overview", '{"ios":"13.0"}', "13.0", True, 1)
    assert [(s["section_kind"], s["sort_order"]) for s in b["sections"]] == [("abstract", 0), ("declaration", 1), ("parameters", 2), ("discussion", 4), ("topics", 5), ("relationships", 6), ("see_also", 7)]
    assert b["sections"][2]["content_text"] == "p: a value" and b["sections"][3]["content_text"] == "Overview\nitem\nTip: t"
    assert [(r["to_key"], r["relation_type"], r["sort_order"]) for r in b["relationships"]][-2:] == [("swift/equatable", "conforms_to", len(b["relationships"]) - 2), ("swiftui/app", "see_also", len(b["relationships"]) - 1)]
    assert docc.references(DOCC) == ["swiftui/text", "swift/equatable", "swiftui/app", "swiftui/mentioned"]
    deep = node = {"type": "paragraph", "inlineContent": []}
    for _ in range(600):
        node["inlineContent"] = [{"type": "strong", "inlineContent": []}]
        node = node["inlineContent"][0]
    node["inlineContent"] = [{"type": "text", "text": "x"}]
    assert docc.text_of([deep], {}) == "x\n" and docc.markdown_of([deep], {}).count("*") == 2400
    assert docc.is_payload(json.dumps(DOCC)) and not docc.is_payload("x") and not docc.is_payload("[]")
    assert docc.nav_keys({"interfaceLanguages": {"swift": [{"path": "/documentation/a", "children": [{"type": "groupMarker", "title": "x"}, {"path": "/documentation/a/b"}]}]}}) == ["a", "a/b"]
    tree = [{"type": "reference", "_resolvedKey": "gone"}, {"type": "link", "destination": "https://developer.apple.com/documentation/a/b"}, {"x": {"type": "reference", "_resolvedKey": "a"}}]
    assert docc.consolidate_links(tree, {"a", "a/b"}) == {"added": 1, "removed": 1, "kept": 1} and "_resolvedKey" not in tree[0]
    rows = spark.createDataFrame([("swiftui/view", json.dumps(DOCC)), ("bad", "{"), ("null", None)], "key string, payload string")
    assert docc.normalize_pages(rows).select("document.key").collect()[0][0] == "swiftui/view" and docc.normalize_pages(rows).count() == 1


def test_sources_and_sync(spark, tmp_path):
    files = {
        "docc/documentation/swiftui/view.json": json.dumps(DOCC), "evo/0001-x.md": "# Name\n\n* Proposal: [SE-0001](x)\n* Status: **Implemented (Swift 5.1)**\n\nIntro.\n\n## Why\nb", "web/about/index.html": PAGE,
        "web/old.html": '<html><head><title>Redirecting</title></head><a href="/new">x</a></html>', "rules/g.html": '<div><h3 data-sidenav>1. Safety</h3>Be safe.<li data-sidenav><b>1.1 Objectionable</b> Not ok.</li></div>',
        "talks/wwdc2021-1.vtt": "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nhello\nhello", "talks/wwdc2021-2.html": PAGE,
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    use = {"apple-docc": "docc", "swift-evolution": "evo", "swift-org": "web", "guidelines": "rules", "wwdc": "talks"}
    stored, errors = sync.sync(spark, sync.empty(spark), {k: (adapter(k), str(tmp_path / v)) for k, v in use.items()} | {"hig": (adapter("hig"), str(tmp_path / "none"))})
    assert list(errors) == ["hig"]
    docs = {r["key"]: r for r in stored.documents.collect()}
    assert set(docs) == {"swiftui/view", "swift-evolution/0001-x", "swift-org/about", "swift-org/old", "app-store-review/1", "app-store-review/1.1", "wwdc/wwdc2021-1", "wwdc/wwdc2021-2"}
    assert json.loads(docs["swift-evolution/0001-x"]["source_metadata"])["seNumber"] == "SE-0001" and docs["swift-org/old"]["kind"] == "redirect" and docs["swift-org/about"]["title"] == "The & Page"
    assert stored.relationships.where("from_key = 'app-store-review/1'").first()["to_key"] == "app-store-review/1.1"
    assert stored.sections.where("key = 'wwdc/wwdc2021-1'").first()["content_text"] == "hello"
    again, _ = sync.sync(spark, stored, {"wwdc": (adapter("wwdc"), str(tmp_path / "talks"))})
    assert again.documents.count() == 8 and again.sections.count() == stored.sections.count()
    assert sync.body_index(stored.documents, stored.sections).count() == 8
    a = adapter("wwdc")
    raw = a.read(spark, str(tmp_path / "talks"))
    old = raw.select("key", F.when(F.col("key").endswith("-1"), "x").otherwise(F.col("etag")).alias("etag")).union(spark.createDataFrame([("gone", "e")], "key string, etag string"))
    assert {r["key"][-4:]: r["status"] for r in a.check(old, raw).collect()} == {"21-1": "modified", "21-2": "unchanged", "gone": "deleted"}
    assert len(adapters.adapters() if hasattr(adapters, "adapters") else {}) in (0, 12)
    with pytest.raises(TypeError):
        register(object())
    with pytest.raises(ValueError):
        validate(raw)
    assert issubclass(adapters.DocC, SourceAdapter)
    lists = adapters.packages(spark.createDataFrame([("a", "u1")], "key string, url string"), spark.createDataFrame([("a", "u2"), ("b", "u3")], "key string, url string"), 5)
    assert sorted((r["key"], r["url"]) for r in lists.collect()) == [("a", "u1"), ("b", "u3")]
    filled, new = adapters.enrich(spark.createDataFrame([("a", None, None)], "key string, usr string, platforms_json string"), spark.createDataFrame([("a", "s:1", "{}"), ("b", "s:2", "{}"), ("a#x", "s:3", "{}")], "key string, usr string, platforms_json string"))
    assert filled.first()["usr"] == "s:1" and [r["key"] for r in new.collect()] == ["b"]


def test_snapshot(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a/x", "T", "ab", "swift", "class", "Class"), (2, "b/y", "U", None, None, None, None)], "id long, key string, title string, abstract string, framework string, doc_kind string, role_heading string")
    path = f"{tmp_path}/snap"
    snapshot.write_snapshot({"documents": docs, "crawl_state": docs.select("key")}, path, "v1")
    back = snapshot.read_snapshot(spark, path)
    assert back["documents"].count() == 2 and back["crawl_state"].count() == 0 and snapshot.read_manifest(spark, path)["tag"] == "v1"
    docs.limit(1).write.mode("overwrite").parquet(f"{path}/documents")
    with pytest.raises(ValueError):
        snapshot.read_snapshot(spark, path)
    secs = spark.createDataFrame([(1, 0, "x" * 600), (1, 1, "y"), (2, 0, "z")], "document_id long, sort_order int, content_text string")
    shards = {r["letter"]: r["n"] for r in snapshot.write_body_shards(docs, secs, f"{tmp_path}/shards").collect()}
    assert shards == {"s": 1, "_": 1}
    snapshot.materialize(docs, f"{tmp_path}/out", "title", ["a"])
    assert spark.read.text(f"{tmp_path}/out").count() == 1
    assert [r["file"] for r in snapshot.sitemap(docs, "https://x", 1).orderBy("file").collect()] == ["sitemap-a-0.xml", "sitemap-b-0.xml"]


def test_maintenance(spark):
    cache = spark.createDataFrame([(k, k % 7, 10 + k % 3) for k in range(500)], "cache_key int, updated_at int, size_bytes int")
    for quota in (0, 55, 1000, 10_000):
        rows = sorted(((r["updated_at"], r["cache_key"], r["size_bytes"]) for r in cache.collect()), reverse=True)
        want, total = set(), 0
        for _, k, n in rows:
            total += n
            if total <= quota:
                want.add(k)
        assert {r["cache_key"] for r in maintenance.evict_to_quota(cache, quota, buckets=4).collect()} == want
    assert maintenance.evict_to_quota(cache.limit(0), 5).count() == 0
    assert maintenance.balanced_bins({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == [["a", "d"], ["b", "c"]]
    groups = spark.createDataFrame([("k", "topics", "T", ["a", "b"], 0), ("k", "conformsTo", "C", ["c"], 1), ("k", "odd", None, ["x"], 2)], "from_key string, type string, title string, identifiers array<string>, place int")
    assert [(r["to_key"], r["relation_type"], r["sort_order"]) for r in graph.extract_relationships(groups).orderBy("sort_order").collect()] == [("a", "child", 0), ("b", "child", 1), ("c", "conforms_to", 2)]
    nums = spark.createDataFrame([("1", "p1"), ("1.2", "p12"), ("1.2.3(a)", "x"), ("9.9", "p99")], "number string, path string")
    assert {r["number"]: r["parent_path"] for r in graph.parent_by_number(nums).collect()} == {"1": None, "1.2": "p1", "1.2.3(a)": None, "9.9": None}


def test_title_search(spark):
    index = spark.createDataFrame([("a/navigationstack", "NavigationStack", "a"), ("a/view", "View", "a"), ("b/stack", "Stack View", "b"), ("c/quartz", "Quartz", "quartzcore")], "key string, title string, framework string")
    postings = build(index)
    rank = lambda q, **kw: [r["key"] for r in title_search(index, postings, q, **kw).collect()]
    assert query_terms("navStack.view") == ["nav", "stack", "view"]
    assert rank("view") == ["a/view", "b/stack"] and rank("stack view")[0] == "b/stack" and rank("navig") == ["a/navigationstack"] and rank("") == [] and rank("zzz") == []
    assert rank("ca", aliases={"ca": "quartz"}) == []


def test_streaming(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:10:00", "view", 1.0), (2, 1, "2024-01-01 00:20:00", "view", 2.0), (3, 2, "2024-01-01 05:00:00", "error", 3.0)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = incremental.crawl_metrics(events).writeStream.outputMode("complete").format("memory").queryName("m").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["n"]) for r in spark.table("m").collect()) == [("error", 1), ("view", 2)]
    changes = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").select(F.col("user_id").alias("k"), "value", F.col("event_id").alias("version"))
    store = versions.VersionedTables(spark, f"{tmp_path}/out")
    incremental.upsert_stream(changes, store, "t", "k", f"{tmp_path}/cp").awaitTermination()
    assert {r["k"]: r["value"] for r in store.read("t").collect()} == {1: 2.0, 2: 3.0}
    assert incremental.sessions(df).count() == 2


def test_package_is_sent_once(spark):
    from docengine import session

    one, two = session.archive(), session.archive()
    assert one.name == two.name and one.read_bytes() == two.read_bytes()
    session.ship(spark)
    session.ship(spark)
    assert spark.range(10).groupBy().sum().first()[0] == 45


def nested(levels: int) -> str:
    return '[{"type":"strong","inlineContent":' * levels + '[{"type":"text","text":"a\\u00e9\\n"}]' + "}]" * levels


def test_trees_of_any_depth(spark):
    import random

    chance = random.Random(7)

    def tree(depth):
        kind = chance.randrange(3) if depth else 2
        if kind == 0:
            return [tree(depth - 1) for _ in range(chance.randrange(4))]
        if kind == 1:
            return {chance.choice('ab"\\é\n') * k: tree(depth - 1) for k in range(chance.randrange(4))}
        return chance.choice([None, True, False, 0, -12, 1.5, 1e300, "", 'x"\\\u2028', "\U0001f600"])

    for _ in range(200):
        t = tree(5)
        for text in (json.dumps(t), json.dumps(t, indent=1, ensure_ascii=False)):
            assert trees.unwound(trees._document(text)) == t
    for bad in ("", "[", "[1,", "[1 2]", '{"a" 1}', "{1:2}", "[1]]", '{"a":1,}', "nul", '"a', "01"):
        with pytest.raises(ValueError):
            trees.unwound(trees._document(bad))
    deep = trees.loads(nested(50_000))
    assert docc.text_of(deep, {}) == "aé\n" and docc.markdown_of(deep, {}).count("*") == 200_000
    assert trees.loads(trees.dumps(deep, sort_keys=True)) is not None and trees.dumps(deep).replace(" ", "") == nested(50_000)
    page = '{"metadata":{"title":"T"},"primaryContentSections":[{"kind":"content","content":' + nested(5_000) + "}]}"
    rows = spark.createDataFrame([("a/b", page), ("c", None), ("d", "[")], "key string, payload string")
    assert docc.normalize_pages(rows).select(F.explode("sections").alias("s")).select("s.content_text").collect()[0][0] == "aé"
    assert {r["key"]: r["markdown"] and r["markdown"].count("*") for r in docc.render_pages(rows).collect()} == {"a/b": 20_000, "c": None, "d": None}
    assert [tuple(r) for r in docc.render_contents(spark.createDataFrame([("a", "{}"), ("b", None), ("c", "[]")], "key string, payload string")).select("text", "markdown").collect()] == [(None, None), (None, None), ("", "")]
    many = "<main>" + "<div>" * 20_000 + "<h2>H</h2>deep" + "</div>" * 20_000 + "</main>"
    assert html.parse(many)["sections"] == [{"heading": "H", "content": "deep"}] and html.to_markdown(html._Tree(many).root) == "H\n\ndeep"


def test_links_of_a_page(spark):
    for source, target, way in (("a/b", "a/c", "c.md"), ("a/b", "a/b", "b.md"), ("a/b/c", "a", "../../a.md"), ("a", "x/y", "x/y.md"), ("a/b", "a/b/c", "b/c.md"), ("", "a/b", "a/b.md")):
        assert docc.relative(source, target) + ".md" == way
    pairs = [("a/b", "a/c"), ("a/b", "a/b"), ("a/b/c", "a"), ("a", "x/y"), ("a/b", "a/b/c"), ("p/q/r", "p/x/r"), ("", "a/b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(urls.relative_path(F.col("a"), F.col("b"))).collect()] == [docc.relative(*p) for p in pairs]
    refs = {"doc://x/documentation/Kit/View": {"title": "View"}}
    nodes = [{"type": "reference", "identifier": "doc://x/documentation/Kit/View"}, {"type": "reference", "identifier": "doc://x/documentation/Kit/View", "isActive": False}, {"type": "reference", "identifier": "https://x.org"}, {"type": "image", "alt": "i", "source": "s.png"}, {"type": "strikethrough", "inlineContent": [{"type": "text", "text": "t"}]}]
    assert docc.markdown_of(nodes, refs, "kit/app") == "[View](view.md)`View``https://x.org`![i](s.png)~~t~~"
    assert docc.markdown_of([{"type": "links", "items": ["doc://x/documentation/Kit/View", "https://x.org"]}], refs, "other") == "- [View](kit/view.md)\n- https://x.org\n\n"


def test_external_references(spark):
    rules = spark.createDataFrame([("x.org", "site"), ("x.org/a", "one"), ("x.org/a/b/", "two"), ("x.org/a/b", "zwei"), ("y.org/deep/er/path", "y"), (None, "n"), ("z.org", None)], "prefix string, key string")
    want = {
        "https://X.org/a/b/C?q#f": "two/C", "https://x.org/a/bc": "one/bc", "https://x.org/": "site", "https://x.org": "site", "https://x.org/a/b//c/": "two/c", "https://x.org/other": "site/other",
        "https://y.org/deep/er": None, "https://y.org/deep/er/path/z": "y/z", "https://z.org/a": None, "x.org/a": None, "": None, None: None, "https://x.org/a/" + "s/" * 3000: "one/" + "/".join("s" * 3000),
    }
    links = spark.createDataFrame([(i, u) for i, u in enumerate([*want, *want])], "i int, url string")
    rows = urls.by_longest_prefix(links, rules).collect()
    assert len(rows) == 2 * len(want) and all(r["mapped"] == want[r["url"]] for r in rows)
    assert urls.by_longest_prefix(links, rules.limit(0)).where("mapped IS NOT NULL").count() == 0 and urls.by_longest_prefix(links.limit(0), rules).count() == 0
    page = {"topicSections": [{"title": "G", "identifiers": ["i1", "doc://o/documentation/K/b", "https://n.org/x", "i2", "gone"]}], "references": {"i1": {"url": "https://x.org/a/q"}, "doc://o/documentation/K/b": {"url": "/documentation/K/B"}, "https://n.org/x": {"url": "https://n.org/x"}, "i2": {"url": "https://developer.apple.com/videos/play/wwdc2024/10001"}}}
    pages = spark.createDataFrame([("k/a", json.dumps(page)), ("bad", "["), ("null", None)], "key string, payload string")
    listed = docc.resolve_references(docc.listed_references(pages), rules).orderBy("place").collect()
    assert [r["to_key"] for r in listed] == ["one/q", "k/b", None, "wwdc/wwdc2024-10001", "gone"]
    near = docc.normalize_pages(pages).where("document.key = 'k/a'").select(F.explode("relationships").alias("r")).select("r.to_key", "r.sort_order").collect()
    assert [tuple(r) for r in near] == [("i1", 0), ("k/b", 1), ("wwdc/wwdc2024-10001", 2), ("gone", 3)]


def plainly_without(text: str, name: str) -> str:
    """The same by a scan with a counter."""
    import re

    tags = list(re.finditer(rf"(?i)</?{name}(?:[\s/][^>]*)?>", text))
    cuts, depth, begin = [], 0, 0
    for m in tags:
        closing, alone = m[0].startswith("</"), m[0].endswith("/>")
        if closing and depth == 1:
            cuts.append((begin, m.end()))
        elif depth == 0 and (closing or alone):
            cuts.append(m.span())
        elif not closing and not alone and depth == 0:
            begin = m.start()
        depth = max(0, depth + (0 if alone and not closing else -1 if closing else 1))
    if depth:
        cuts += [m.span() for m in tags if m.start() >= begin]
    out, at = [], 0
    for a, b in cuts:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def test_elements_are_balanced(spark):
    import random

    chance = random.Random(11)
    pieces = ["<nav>", "</nav>", "<NAV a='b'>", "</nav >", "<nav/>", "a", "b c", "<navy>", "</div>", "\n", "<footer>", "</footer>"]
    texts = ["".join(chance.choice(pieces) for _ in range(chance.randrange(14))) for _ in range(400)] + ["", "<nav>" * 3000 + "x" + "</nav>" * 3000 + "y", "z<nav>" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = [r[0] for r in df.select("i", html.strip_elements(F.col("t"), ("nav",)).alias("s")).orderBy("i").select("s").collect()]
    assert got[-1] is None
    assert got[:-1] == [plainly_without(t, "nav") for t in texts]
    both = df.select("i", html.strip_elements(F.col("t"), ("nav", "footer")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in both][:-1] == [plainly_without(plainly_without(t, "nav"), "footer") for t in texts]


def test_requested_pages(spark):
    roots = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "root_id int, slug string, source_type string")
    pages = spark.createDataFrame([(10, 1), (20, 2), (21, 2), (30, 3), (90, 9), (91, None)], "page_id int, root_id int")
    ask = lambda *a: sorted(r["page_id"] for r in corpus_stats.requested_pages(pages, roots, *a).collect())
    assert ask() == [10, 20, 21, 30, 90, 91] and ask(["a", "b"]) == [10, 20, 21] and ask(["a", "b"], ["y", "z"]) == [20, 21]
    assert ask(None, ["x"]) == [10] and ask([]) == [] and ask(["c"], None) == [30] and ask(["c"], ["x"]) == []
    assert corpus_stats.requested_pages(pages.limit(0), roots, ["a"]).count() == 0
