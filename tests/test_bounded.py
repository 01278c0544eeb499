from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docengine.operators import bounded, search


@pytest.fixture(scope="module")
def index(spark):
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(3000):
        body = rnd.choices(words, [1 / (k + 1) for k in range(60)], k=rnd.choice([3, 8, 30, 90]))
        rows.append((i, " ".join(body)))
    rows += [(i, rows[5][1]) for i in range(3000, 3100)] + [(3100, None), (3101, ""), (3102, "w7 " * 3000)]
    docs = spark.createDataFrame(rows, "id long, body string")
    postings, stats = search.store(docs, {"body": 1.0})
    return postings, stats, bounded.store_blocks(postings, stats, size=16)


def asked(index, query, k, among=None):
    postings, stats, blocks = index
    every = search.match(postings, stats, query, {"body": 1.0})
    if among is not None:
        every = every.join(among, "id", "left_semi")
    want = [tuple(r) for r in every.orderBy(F.col("score").desc(), "id").limit(k).collect()]
    got = bounded.best(blocks, stats, query, k, among)
    assert [tuple(r) for r in got.rows.collect()] == want, query
    return want, got


@pytest.mark.parametrize("text", ["w3", "w59", "w1 w2 w5", "w1 none", "w40 NOT w0", "(w9 OR w11) AND w2", "w3 AND w4* NOT w50"])
def test_best_equals_all(index, text):
    asked(index, search.parse(text), 20)


def test_few_blocks_are_read(index):
    one = search.Query((search.Group((), ("w20",)),))
    want, got = asked(index, one, 10)
    assert len(want) == 10 and got.read < got.blocks / 3
    some = search.Query((search.Group((), ("w30",)), search.Group((), ("w41",))), any=True)
    _, got = asked(index, some, 10)
    assert got.read < got.blocks


def test_rounds_grow_until_enough_are_found(index, spark):
    among = spark.range(0, 3100, 97)
    want, _ = asked(index, search.parse("w0"), 15, among)
    assert len(want) == 15
    want, got = asked(index, search.parse("w0"), 100_000)
    assert got.read == got.blocks and len(want) > 1000
    assert asked(index, search.parse("w0"), 5, spark.range(0))[0] == []


def test_edges(index, spark):
    postings, stats, blocks = index
    assert bounded.best(blocks, stats, search.parse(""), 5).rows.count() == 0
    assert bounded.best(blocks, stats, search.parse("w1"), 0).rows.count() == 0
    with pytest.raises(ValueError):
        bounded.best(blocks, stats, search.parse('"w1 w2"'), 5)
    none, nothing = search.store(spark.createDataFrame([], "id long, body string"), {"body": 1.0})
    assert bounded.best(bounded.store_blocks(none, nothing), nothing, search.parse("w1"), 5).rows.count() == 0
    assert blocks.groupBy("term", "block").count().where("count > 1").count() == 0
    assert blocks.agg(F.sum("n")).first()[0] == postings.count()


def test_blocks_of_documents_serve_for_postings_too(spark, index):
    """One table, written from one shuffle: its postings, places included, are those of the table of postings, and its best are the best."""
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices([f"w{k}" for k in range(40)], k=rnd.choice([1, 5, 40]))), rnd.choice([None, "", "w1 w2", "w3"])) for i in range(700)]
    docs = spark.createDataFrame(rows + [(700, None, None), (701, "", ""), (702, "é w7 " * 2000, "w7")], "id long, body string, title string").repartition(3)
    fields = {"body": 1.0, "title": 2.5}
    postings, stats = search.store(docs, fields)
    blocks, own = bounded.store(docs, fields, size=16)
    view = bounded.postings(blocks)
    assert own == stats and stats[0] == 703 and view.columns == postings.columns
    assert sorted(map(tuple, view.collect())) == sorted(map(tuple, postings.collect()))
    assert blocks.groupBy("term", "block").count().where("count > 1").count() == 0 and blocks.agg(F.max("n")).first()[0] == 16
    for text in ("w3", "w1 w2 w5", "w4* NOT w0", "(w9 OR w11) AND w2"):
        asked((postings, stats, blocks), search.parse(text), 20)
    by = lambda rows: [tuple(r) for r in search.match(rows, stats, search.parse('"w1 w2" OR title: w3'), fields).orderBy("id").collect()]
    assert by(view) == by(postings) and len(by(view)) > 10
    none, nothing = bounded.store(spark.createDataFrame([], "id long, body string"), {"body": 1.0})
    assert bounded.best(none, nothing, search.parse("w1"), 5).rows.count() == 0 and bounded.postings(none).count() == 0
