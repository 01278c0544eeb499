from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docengine.operators import search, semantic


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_finds_every_title(spark):
    rnd = random.Random(2)
    base = ["navigation", "view", "abab", "buttons éa", "aaaa aaaa"]
    titles = [None, "", "a", "x" * 3000]
    for _ in range(600):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "É", "n"])
        titles.append("".join(t))
    docs = spark.createDataFrame(list(enumerate(titles)), "id long, title string").persist()
    parts = search.store_parts(docs)
    assert parts.where("id = 3").count() == 3
    for q in [*base, "vieww", "Abab", "navgatoin"]:
        want = sorted((d, i) for i, t in enumerate(titles) if t is not None and (d := edits(t.lower(), q.lower())) <= 2)
        assert [(r["distance"], r["id"]) for r in search.fuzzy(docs, parts, q, 10000).collect()] == want, q
    assert search.fuzzy(docs, parts, "abc", 10).count() == 0


@pytest.mark.parametrize("dims", [64, 128])
def test_subcodes_find_the_same(spark, dims):
    rnd = random.Random(dims)
    centres = [[rnd.choice([-1.0, 1.0]) for _ in range(dims)] for _ in range(6)]
    vectors = [[-x if rnd.random() < 0.08 else x for x in rnd.choice(centres)] for _ in range(600)] + [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(1400)]
    rows = [(i, i // 3, 0, v) for i, v in enumerate(vectors)]
    index = semantic.build_chunk_index(spark.createDataFrame(rows, "chunk_id long, document_id long, ord int, vector array<double>"), dims).persist()
    table = semantic.store_subcodes(index, dims)
    assert table.count() == len(rows) * dims // 16
    for query, n in ((centres[0], 20), (centres[1], 50), (vectors[-1], 16), (vectors[5], 700)):
        want = [(r["chunk_id"], r["distance"]) for r in semantic.shortlist(index, query, n).collect()]
        got = semantic.nearest(table, query, n)
        assert [(r["chunk_id"], r["distance"]) for r in got.collect()] == want
        assert set(got.columns) == {*index.columns, "distance"}
    near = semantic.within(table, centres[0], 2)
    assert near.count() == near.select("chunk_id").distinct().count() < len(rows) / 4  # few are read, each once
    folders = table.where(F.col("part") == 0).select("high").distinct().count()
    assert folders > 30
