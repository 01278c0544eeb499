from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import language_id as li

EN = ["the cat sat on the mat and the dog", "she sells sea shells on the shore", "this is the house that they built"]
DE = ["der hund und die katze sind im haus", "das ist ein schöner tag für uns alle", "wir gehen über die straße nach hause"]


def brute_bits(train: list[str], text: str) -> float:
    """PPM, method C, orders 3 to 0, frozen counts, byte by byte."""
    counts: list[dict] = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        b = b"\n\n\n" + t.encode()
        for i in range(3, len(b)):
            for d in range(4):
                counts[d][b[i - d : i]][b[i]] += 1
    b, bits = b"\n\n\n" + text.encode(), 0.0
    for i in range(3, len(b)):
        for d in (3, 2, 1, 0):
            c = counts[d].get(b[i - d : i])
            if c:
                n, q = sum(c.values()), len(c)
                if b[i] in c:
                    bits -= math.log2(c[b[i]] / (n + q))
                    break
                bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


@pytest.fixture(scope="module")
def model():
    return li.Model({"en": [t.encode() for t in EN], "de": [t.encode() for t in DE]})


@pytest.mark.parametrize("text", ["the dog sat", "die katze ist da", "Ωμέγα", "x", "zzzz qqqq", "für\n\nuns " * 50])
def test_code_lengths_are_exact(model, text):
    got = model.code_lengths([text.encode(), b"", text.encode()])
    for lang, train, row in zip(("de", "en"), (DE, EN), got, strict=True):
        assert row[0] == row[2] and row[1] == 0
        assert abs(row[0] / li.UNIT - brute_bits(train, text)) < 0.001 * len(text.encode()) * 5, lang


def test_long_texts_in_pieces(model, monkeypatch):
    text = ("the cat and die katze " * 400).encode()
    whole = model.code_lengths([text, b"the"])
    monkeypatch.setattr(li, "_PIECE", 1000)
    assert np.array_equal(whole, model.code_lengths([text, b"the"]))


def test_columns(spark, docs, clash, empty, rows):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in EN] + [(t, "de") for t in DE] + [("nothing known", None)])], "doc_id long, text string, lang string")
    m = li.fit(train, F.lit(True))
    assert m.langs == ["de", "en"]
    out = li.identify(docs, m).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de")) == letters and (r["lang_pred"] == "und") == (not letters)
    got = li.identify(spark.createDataFrame([("the cat is on the mat",), ("der hund ist im haus",)], "text string"), m).collect()
    assert [r["lang_pred"] for r in got] == ["en", "de"]
    out = li.identify(clash, m)
    assert out.columns == [*clash.columns, "_lang_pred", "_score", "_code_bits"] and out.count() == len(rows)
    assert li.identify(empty, m).count() == 0


def test_nothing_learned(docs, empty):
    m = li.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in li.identify(docs, m).collect()} == {"und"}


def test_sample_is_bounded_and_whole(docs):
    m = li.fit(docs, F.lit(True), sample_rows=2)
    assert m.langs == ["de", "en", "fr"]


def test_repeated_rows_do_not_enlarge_the_sample(spark, monkeypatch):
    held = []
    monkeypatch.setattr(li, "Model", lambda texts: held.append(texts))
    rows = [(1, "the same text again", "en")] * 3000 + [(k, f"text number {k} of these", "en") for k in range(50)] + [(k, "x" * 50 + str(k), "xx") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    li.fit(df, F.lit(True), sample_rows=20)
    assert len(held[0]["en"]) == 20 and len(held[0]["xx"]) == 20 and len(set(held[0]["en"])) == len(held[0]["en"])
    li.fit(df, F.lit(True), sample_rows=1000)
    assert len(held[1]["en"]) == 51
    li.fit(df, F.lit(True), sample_bytes=300)
    assert all(sum(map(len, t)) <= 300 for t in held[2].values()) and len(held[2]["xx"]) == 5
    li.fit(df, F.lit(True), text_bytes=30)
    assert set(held[3]) == {"en"}
    with pytest.raises(ValueError, match="more than 1 languages"):
        li.fit(df, F.lit(True), languages=1)


def test_copies_and_useless_rows_do_not_shrink_the_sample(spark, monkeypatch):
    """A million copies of one row, and as many rows without a letter, leave the sample as large as it was."""
    held = []
    monkeypatch.setattr(li, "Model", lambda texts: held.append(texts))
    distinct = spark.range(600).selectExpr("id", "concat('text number ', id, ' of these') AS text")
    copies = spark.range(1_000_000).selectExpr("cast(-1 as bigint) AS id", "'the same text again' AS text")
    useless = spark.range(100_000).selectExpr("id", "cast(id AS string) AS text")
    df = distinct.union(copies).union(useless).selectExpr("id AS doc_id", "text", "'en' AS lang")
    li.fit(df, F.lit(True), sample_rows=800)
    assert len(held[0]["en"]) == 601
    li.fit(df, F.lit(True), sample_rows=100)
    assert len(held[1]["en"]) == 100
    li.fit(df, F.lit(True), total_bytes=300)
    assert 0 < sum(map(len, held[2]["en"])) <= 300


def test_held_out_accuracy(spark):
    from docengine.llm import queries

    src = "/root/testdata/sf0.01"
    got = queries.op6_language_ppm(spark, src).join(spark.read.parquet(f"{src}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right >= 0.95 * n, right / n
