from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from docengine.functions import identifiers, text, urls, vectors, versions
from docengine.model import coerce_source_type, framework_of, root_source_type, url_depth


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def many(spark, expr, cases):
    rows = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(cases)], "i int, x string").select("i", "x", expr(F.col("x")).alias("y")).orderBy("i").collect()
    for r, (_, want) in zip(rows, cases, strict=True):
        assert r["y"] == want, r


def test_versions(spark):
    many(spark, versions.encode_version, [("13.4.1", 13004001), (" 9 ", 9000000), ("10.15 beta", 10015000), ("1.2.3.4", 1002003), ("1000.1", None), ("1.2.3.1000", None), ("beta", None), ("", None), (None, None)])
    many(spark, lambda c: versions.version_at_most(c, "12.3"), [("12.3", True), ("12.3.1", False), (None, True), ("x", True), ("9", True)])
    many(spark, lambda c: versions.tidy_float(c.cast("double")), [("13.0", "13"), ("13.40", "13.4"), ("10.15", "10.15")])


def test_identifiers(spark):
    cases = [
        ("doc://com.x/documentation/SwiftUI/View", "swiftui/view"), ("/documentation/UIKit/", "uikit"), ("/design/human", "design/human"), ("doc://com.x/design/a", "design/a"), ("documentation/a/b#c", "a/b"),
        ("https://x.y/z", None), ("a//b", None), ("a/.+(_:)", None), ("", None), ("#x", None), (None, None), ("/app-store-review/1.1", "app-store-review/1.1"), ("a/...", None),
    ]
    many(spark, identifiers.normalize_identifier, cases)
    from docengine.operators.docc import identifier

    assert [identifier(k) for k, _ in cases] == [v for _, v in cases]
    many(spark, identifiers.root_slug, [("a/b", "a"), ("a", "a"), ("", None), (None, None)])
    many(spark, identifiers.camel_subwords, [("NavigationStack", ["Navigation", "Stack"]), ("view", []), ("iOS17Beta", ["i", "OS17", "Beta"])])
    many(spark, identifiers.trigrams, [("AbcA", ["abc", "bca"]), ("ab", []), ("aaaa", ["aaa"])])
    cases = [("NavigationStack", "symbol"), ("View", "symbol"), ("Foo.bar", "symbol"), ("a::b", "symbol"), ("app crash", "error"), ("how to use it", "howto"), ("what is x", "concept"), ("wwdc 2021", "wwdc"), ("in 2019", "wwdc"), ("list", "general"), ("", "general"), ("  ", "general"), (None, "general")]
    many(spark, lambda c: identifiers.intent(c)["type"], cases)
    assert [identifiers.detect_intent(q)[0] for q, _ in cases] == [t for _, t in cases]


def test_relaxing():
    t = identifiers.tokenize("how to use the NavigationStack 5 in v2.0?")
    assert t == ["how", "to", "use", "the", "NavigationStack", "in", "v2.0"]
    assert identifiers.prune_stopwords(t) == ["NavigationStack", "v2.0"]
    assert identifiers.high_signal_token(["abc", "longer", "camelCase"]) == "camelCase" and identifiers.high_signal_token(["four", "five5", "seven"]) == "five5" and identifiers.high_signal_token(["abc"]) is None
    assert identifiers.sanitize_trigram('a "b"') == '"a ""b"""' and identifiers.sanitize_trigram("a b") == "a b" and identifiers.sanitize_trigram(" ") == '""'
    assert len(identifiers.STOPWORDS) == 54


def test_fuzzy(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("view", "veiw"), ("abc", "xyzabc"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(identifiers.fuzzy_distance(F.col("a"), F.col("b"))).collect()] == [3, 2, 3, 0]


def test_text(spark):
    many(spark, text.decode_entities, [("&lt;a&gt; &amp;lt; &#39;&#x2F;&#233; &#x1F600;&nbsp;&quot;", "<a> &lt; '/é \U0001f600 \""), ("&#x;&bad;", "&#x;&bad;")])
    many(spark, text.slugify, [("Hello,  World!", "hello-world"), ("--a--b--", "a-b"), (None, "")])
    many(spark, text.is_safe_href, [("#a", True), ("/a", True), ("//a", False), ("HTTPS://a", True), ("javascript:x", False), (None, False)])
    many(spark, text.readable_name, [("swiftui/animation/linear-curve", "Linear Curve"), ("", "")])
    many(spark, text.escape_html, [("<a href=\"x\">'&'</a>", "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;")])
    many(spark, text.evolution_status, [("Implemented (Swift 5)", "Implemented"), ("active review (1)", "Active Review"), ("", "Other"), ("odd", "Other"), (None, "Other")])
    many(spark, text.section_number, [("1.2.3 Title", "1.2.3"), ("3.1.3(a) X", "3.1.3(a)"), ("5. Legal", "5"), ("Legal", None)])
    many(spark, text.parent_number, [("1.2.3", "1.2"), ("3.1.3(a)", "3.1.3"), ("4", None)])
    many(spark, text.first_sentence, [("# T\n- **Be** [nice](x). More.\nEnd", "Be nice."), ("no end", "no end")])
    many(spark, text.markdown_abstract, [("![b](x)\n# T\n\n[![c](y)](z)\n## H\nFirst  line\nmore", "First line"), ("Straight away\n# T", "Straight away"), ("# only", None)])
    many(spark, text.clean_transcript, [("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<v A>Hi &amp; lo</v>\nHi &amp; lo\nNOTE x\n2\nbye", "Hi & lo\nbye")])
    many(spark, lambda c: text.snippet(c, F.lit("needle!")), [("a " * 100 + "needle" + " b" * 200, "..." + ("a " * 100 + "needle" + " b" * 200)[123:343].strip() + "..."), ("short", "short"), ("", ""), ("x" * 300, "x" * 217 + "...")])
    many(spark, urls.safe_key, [("a/b", "a/b")])
    long = one(spark, urls.safe_segment, "é" * 150)
    assert long.startswith("é" * 90 + "~") and len(long) == 90 + 13
    many(spark, urls.is_storage_key, [("a/b", True), ("/a", False), ("a/../b", False), ("a\\b", False), ("", False), (None, False)])


def test_urls(spark):
    a = "https://developer.apple.com"
    many(spark, urls.map_url_to_key, [
        (f"{a}/documentation/SwiftUI/View/", "swiftui/view"), (f"{a}/documentation/", None), (f"{a}/design/Human", "design/human"), (f"{a}/library/archive/docs/Foo/index.html", "apple-archive/docs/Foo"),
        (f"{a}/library/archive/docs/Foo/Foo.html", "apple-archive/docs/Foo"), (f"{a}/library/archive/docs/Foo/bar.HTML", "apple-archive/docs/Foo/bar.html"), (f"{a}/videos/play/wwdc2020/10041/", "wwdc/wwdc2020-10041"),
        ("https://docs.swift.org/swift-book/", "swift-book"), ("https://docs.swift.org/swiftpm/a/b?x=1#y", "swift-package-manager/a/b"), ("https://www.swift.org/migration/x/", "swift-migration-guide/x"),
        ("https://swift.org/documentation/tspl/", "swift-book/The-Swift-Programming-Language"), ("https://swift.org/swift-evolution/proposals/0001-x.html", "swift-evolution/0001-x"),
        ("https://github.com/apple/swift-evolution/blob/main/proposals/0302-s.md", "swift-evolution/0302-s"), ("https://example.com/documentation/x", None), ("no url", None), (None, None),
    ])


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=70).astype(np.float32).tolist()) for i in range(40)] + [(40, [0.0] * 70)]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    q = rows[0][1]
    out = df.select("i", vectors.sign_code(F.col("v"), 70).alias("c"), vectors.quantize_i8(F.col("v")).alias("q"), vectors.l2_normalize(F.col("v")).alias("n"), vectors.truncate(F.col("v"), 8).alias("t"))
    q_code = out.where("i = 0").first()["c"]
    lit = F.array(*[F.lit(x).cast("long") for x in q_code])
    out = out.withColumn("d", vectors.hamming(F.col("c"), lit)).withColumn("dot", vectors.dot_i8(F.array(*[F.lit(float(x)) for x in q]), F.col("q.codes"), F.col("q.scale"))).collect()
    for r in out:
        v = np.array(rows[r["i"]][1], np.float32).astype(float)
        assert r["d"] == int(((v >= 0) != (np.array(q) >= 0)).sum())
        top = np.abs(v).max()
        scale = top / 127 if top else 1.0
        codes = np.sign(v) * np.floor(np.abs(v / scale) + 0.5)
        assert r["q"]["codes"] == codes.astype(int).tolist() and abs(r["dot"] - scale * float(np.array(q) @ codes)) < 1e-9
        if top:
            assert np.allclose(r["n"], v / np.linalg.norm(v)) and np.allclose(r["t"], v[:8] / np.linalg.norm(v[:8]))
    pools = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "v array<array<double>>, m array<int>")
    got = pools.select(vectors.mean_pool(F.col("v"), F.col("m"), 2), vectors.last_token_pool(F.col("v"), F.col("m"))).collect()
    assert [tuple(r) for r in got] == [([2.0, 3.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 2.0])]


def test_model(spark):
    many(spark, coerce_source_type, [("wwdc", "wwdc"), ("x", "apple-docc"), (None, "apple-docc")])
    many(spark, lambda c: root_source_type(c, F.lit("design")), [("wwdc", "wwdc"), ("other", "hig")])
    many(spark, framework_of, [("documentation/uikit/x", "uikit"), ("a/b", "a")])
    many(spark, url_depth, [("a/b/c", 2), ("a", 0)])
    df = spark.createDataFrame([([("iOS", "13.0"), ("macOS", None), ("ios", "14.0"), (None, "1")],)], "p array<struct<name:string,introducedAt:string>>")
    assert df.select(versions.platform_map(F.col("p"))).first()[0] == {"ios": "14.0"}


def test_random_plain_distance(spark):
    rnd = random.Random(4)
    pairs = [("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))), "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6)))) for _ in range(200)]

    def naive(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if not b else (lambda prev: [cur := [i], [cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))) for j, y in enumerate(b, 1)], cur][2])(row)
        return min(row[-1], 3)

    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(identifiers.fuzzy_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [naive(a, b) for a, b in pairs]
