from __future__ import annotations

from docengine.llm import url_filter as uf
from docengine.llm.queries import URL_RULES

URLS = [
    "http://Www.Example.com/en/x?a=1#b", "https://a.b.example.com/en/", "https://example.com/fr/", "http://x.net/es/1", "http://net/fr/", "http://knet/fr/", "http://x.org/en", "ftp://com", "http://com?/en/",
    "nothing", "", None, "a://b://c/d", "http://example.com", "http://[::1]/x",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def given_rule(url):
    h, p = parts(url)
    fits = [(len(a + b), a + b, v) for v, a, b in URL_RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
    return max(fits)[1:] if fits else (None, None)


def test_given_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string")
    none = uf.mine(pages.limit(0).selectExpr("url", "'block' as label"))
    out = uf.judge(pages, none, URL_RULES).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        rule, verdict = given_rule(r["url"])
        assert (r["host"], r["path"]) == parts(r["url"]) and (r["rule"], r["verdict"]) == (rule, verdict or "allow"), r


def brute(urls, rules):
    """The rule of highest confidence, support, then order of tokens, among all that fit."""
    out = {}
    for u, toks in urls.items():
        fit = [(-r["confidence"], -r["support"], sorted(r["tokens"]), r["label"]) for r in rules if set(r["tokens"]) <= set(toks)]
        out[u] = min(fit)[3] if fit else "allow"
    return out


def test_mined_rules(spark):
    good = [f"http://good{k % 5}.site.org/en/{k}" for k in range(60)]
    bad = [f"http://cheap-pills.site.org/{'xyz'[k % 3]}/{k}?buy=1" for k in range(40)]
    data = spark.createDataFrame([(u, "allow") for u in good] + [(u, "block") for u in bad] + [("http://cheap-pills.site.org/q/1", None)], "url string, label string")
    mined = uf.mine(data, support=0.05, confidence=0.7)
    got = mined.rules.collect()
    assert any(set(r["tokens"]) == {"host:cheap-pills"} and r["label"] == "block" and r["confidence"] == 1.0 for r in got)
    for r in got:  # exact counts
        own = [l for u, l in [(u, "allow") for u in good] + [(u, "block") for u in bad] if set(r["tokens"]) <= set(uf_tokens(spark, u))]
        assert abs(r["confidence"] - own.count(r["label"]) / len(own)) < 1e-9 and r["key"] in r["tokens"]
    shown = [tuple(sorted(r["tokens"])) for r in got]
    assert ("host:cheap-pills", "query:buy") not in shown  # no better than a shorter rule
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good[:3] + bad[:3] + ["http://cheap-pills.other.org/new", "http://new.org/", None])], "page_id long, url string")
    out = {r["url"]: r["verdict"] for r in uf.judge(pages, mined).collect()}
    toks = {r["url"]: r["t"] for r in pages.select("url", uf.tokens(pages.url).alias("t")).collect()}
    stands = {r["token"]: r["stand"] for r in mined.alike.collect()}
    toks = {u: [stands.get(t, t) for t in ts] for u, ts in toks.items()}
    assert out == brute(toks, got) and out["http://cheap-pills.other.org/new"] == "block"


def uf_tokens(spark, url):
    cache = uf_tokens.__dict__.setdefault("cache", {})
    if url not in cache:
        df = spark.createDataFrame([(url,)], "url string")
        cache[url] = df.select(uf.tokens(df.url)).first()[0]
    return cache[url]


def test_clash_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://com/x", "h", "r", "v")], "page_id long, url string, host string, Rule string, row string")
    none = uf.mine(pages.limit(0).selectExpr("url", "'x' as label"))
    out = uf.judge(pages, none, URL_RULES)
    assert out.columns == ["page_id", "url", "host", "Rule", "row", "_host", "path", "_rule", "verdict", "mined"] and out.first()["_rule"] == "com/"
    assert uf.judge(pages.limit(0), none, URL_RULES).count() == 0


def test_every_rule_is_found(spark):
    """All rules of the support and confidence that no shorter rule makes superfluous, by enumeration."""
    import random
    from itertools import combinations

    rnd = random.Random(4)
    rows = [(f"http://{rnd.choice('ab')}.{rnd.choice('cd')}.org/{rnd.choice(['x', 'y', 'x/z'])}?{rnd.choice('qr')}=1", rnd.choice(["allow", "block", "block"])) for _ in range(120)]
    mined = uf.mine(spark.createDataFrame(rows, "url string, label string"), support=0.1, confidence=0.6)
    stands = {r["token"]: r["stand"] for r in mined.alike.collect()}
    baskets = [(frozenset(stands.get(t, t) for t in uf_tokens(spark, u)), label) for u, label in rows]
    assert len({t for b, _ in baskets for t in b}) < 12
    found = {}
    for b in {b for b, _ in baskets}:
        for n in range(1, len(b) + 1):
            for some in combinations(sorted(b), n):
                own = [label for c, label in baskets if c.issuperset(some)]
                for label in ("allow", "block"):
                    if own.count(label) >= 0.1 * len(rows) and own.count(label) >= 0.6 * len(own):
                        found[(some, label)] = own.count(label) / len(own)
    want = {k: c for k, c in found.items() if not any(found.get((tuple(t for t in k[0] if t != x), k[1]), 0) >= c for x in k[0])}
    got = {(tuple(sorted(r["tokens"])), r["label"]): r["confidence"] for r in mined.rules.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_urls_that_repeat(spark):
    """Hundreds of tokens that always come together are mined as one: 2^300 sets of them would be frequent."""
    long = "http://long.org/" + "/".join(f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300))
    data = [(long, "block")] * 30 + [(f"http://short.org/p{chr(97 + k % 20)}", "allow") for k in range(60)]
    mined = uf.mine(spark.createDataFrame(data, "url string, label string"), support=0.05, confidence=0.7)
    assert mined.rules.count() < 50
    pages = spark.createDataFrame([(1, long), (2, "http://x.org/saa"), (3, "http://short.org/pa"), (4, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in uf.judge(pages, mined).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_long_urls_nearly_alike(spark):
    """40 segments that nearly always come together: 2^40 sets of them are frequent, and rules of a bounded number are mined in seconds."""
    import time

    segments = [f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]
    long = "http://long.org/" + "/".join(segments)
    data = [(long, "block")] * 300 + [(f"http://other.org/{s}", "block") for s in segments] + [(f"http://short.org/p{chr(97 + k % 20)}", "allow") for k in range(300)]
    begin = time.monotonic()
    mined = uf.mine(spark.createDataFrame(data, "url string, label string"), support=0.05, confidence=0.7)
    rules = mined.rules.collect()
    assert time.monotonic() - begin < 60 and len(rules) < 2000
    blocked = {t for r in rules if r["label"] == "block" for t in r["tokens"]}
    assert {f"path:{s}" for s in segments} <= blocked  # each segment alone says it
    pages = spark.createDataFrame([(1, long), (2, f"http://x.org/{segments[0]}"), (3, f"http://x.org/{segments[39]}"), (4, "http://short.org/pa")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in uf.judge(pages, mined).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def every_rule(baskets, support, confidence):
    """All rules that no shorter rule makes superfluous, by enumeration: {(tokens, label): confidence}."""
    from itertools import combinations

    found = {}
    for some in {x for b in {b for b, _ in baskets} for n in range(1, len(b) + 1) for x in combinations(sorted(b), n)}:
        own = [label for c, label in baskets if c.issuperset(some)]
        for label in set(own):
            if own.count(label) >= support * len(baskets) and own.count(label) >= confidence * len(own):
                found[(some, label)] = own.count(label) / len(own)
    return {k: c for k, c in found.items() if not any(found.get((tuple(t for t in k[0] if t != x), k[1]), 0) >= c for x in k[0])}


def test_wide_urls_bring_all_their_combinations(spark):
    """However few tokens of a URL FP-growth gets, the rules are those of all combinations."""
    import random

    rnd = random.Random(11)
    rows = []
    for _ in range(250):
        have = [x for x in "abcdef" if rnd.random() < 0.6]
        rows.append((f"http://h.org/{'/'.join('s' + x for x in have)}", "block" if ({"a", "b", "c"} <= set(have)) ^ (rnd.random() < 0.15) else "allow"))
    baskets = None
    for widest in (1, 3):
        mined = uf.mine(spark.createDataFrame(rows, "url string, label string"), support=0.03, confidence=0.6, widest=widest)
        stands = {r["token"]: r["stand"] for r in mined.alike.collect()}
        baskets = baskets or [(frozenset(stands.get(t, t) for t in uf_tokens(spark, u)), label) for u, label in rows]
        want = every_rule(baskets, 0.03, 0.6)
        got = {(tuple(sorted(r["tokens"])), r["label"]): r["confidence"] for r in mined.rules.collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want), widest
    assert any(len(k[0]) >= 3 for k in want)


def test_long_urls_nearly_alike_of_both_labels(spark):
    """30 segments that nearly always come together, of mixed labels: 2^30 frequent sets, of which pairs say all; two late ones together tell the label."""
    segments = [f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30)]
    long = "http://long.org/" + "/".join(segments)
    pair = f"http://p.org/{segments[28]}/{segments[29]}"
    data = [(long, "block")] * 90 + [(long, "allow")] * 90 + [(f"http://other.org/{s}", label) for s in segments for label in ("allow", "block") * 5] + [(pair, "block")] * 200
    data += [(f"http://q.org/{segments[k]}", "allow") for k in (28, 29)] * 150
    mined = uf.mine(spark.createDataFrame(data, "url string, label string"), support=0.05, confidence=0.6)
    want = (f"path:{segments[28]}", f"path:{segments[29]}")
    assert (want, "block") in {(tuple(sorted(r["tokens"])), r["label"]) for r in mined.rules.collect()}
    pages = spark.createDataFrame([(1, f"http://n.org/{segments[29]}/{segments[28]}"), (2, f"http://n.org/{segments[28]}")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in uf.judge(pages, mined).collect()} == {1: "block", 2: "allow"}
