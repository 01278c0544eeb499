from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, src).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held.append(docs)
        assert k == 4 or docs.columns == columns
    lang, lines, near, mixed, tokens = held
    assert lang.count() == len(before)  # all have a language
    where = Counter()
    for t in before.values():
        where.update({x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")} - {""})
    for r in lines.collect():
        want = [x for x in before[r["doc_id"]].split("\n") if where[x.strip(" \t\n\x0b\x0c\r").lower()] < 10 or not x.strip()]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])
    text = {r["doc_id"]: r["text"] for r in lines.collect()}
    grams = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in text.items() if (w := re.findall(r"[^\x20\x09-\x0D]+", t))}
    up = {i: i for i in grams}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(grams)
    for a in ids:
        for b in ids:
            if a < b and 5 * (c := len(grams[a] & grams[b])) >= 4 * (len(grams[a]) + len(grams[b]) - c):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    kept = {r["doc_id"] for r in near.collect()}
    assert kept == {i for i in text if i not in grams or root(i) == i}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= kept and max(copies.values()) <= 2
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(near)) < 0.1 * words(near)
    assert Counter(r["doc_id"] for r in tokens.collect()) == copies


def test_empty(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
