from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from docengine.llm import quality


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts(spark, docs, clash, empty, rows):
    trusted = docs.where("doc_id < 30").select("doc_id").distinct()
    more = spark.createDataFrame([(900, "a b c d e f a b c d e f # a b c d e"), (901, "x y\nx y\n \nx y \n***"), (902, "a a a a a a a"), (903, "a b c d")], "doc_id long, text string")
    for d in (docs.select("doc_id", "text").unionByName(more),):
        out = quality.judge(d, trusted).collect()
        assert len(out) == len(rows) + 4
        for r in out:
            assert tuple(r[n] for n in NAMES) == base(r["text"]), r["doc_id"]
            assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
    out = quality.judge(clash, trusted)
    assert out.columns[len(clash.columns) :] == ["_n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_base_failed", "_score", "_kept"] and out.count() == len(rows)
    assert quality.judge(empty, empty.select("doc_id")).count() == 0


def test_scores_against_counts(spark):
    """The score from buckets that Spark itself names, counted and summed in plain Python."""
    texts = {1: "good words are here to stay and read", 2: "good words stay here", 3: "bad junk ### junk ###", 4: "", 5: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trusted = df.where("doc_id <= 2").select("doc_id")
    own = {r[0]: [b for b in r[1] if b >= 0] for r in df.select("doc_id", quality.words(F.col("text")).alias("w")).select("doc_id", F.expr(quality.ngram_buckets("w"))).collect()}
    raw, target = Counter(b for x in own.values() for b in x), Counter(b for i in (1, 2) for b in own[i])
    n, t, k = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS, quality.BUCKETS
    ratio = lambda b: math.log(((target[b] + 1) / t) / ((raw[b] + 1) / n))
    assert k == 10_000
    for r in quality.judge(df, trusted).collect():
        x = own[r["doc_id"]]
        assert abs(r["score"] - (sum(map(ratio, x)) / len(x) if x else 0.0)) < 1e-9
    assert {r["score"] for r in quality.judge(df, trusted.limit(0)).collect()} == {0.0}
