from __future__ import annotations

import numpy as np

from docengine.functions import embedding as e

VOCABULARY = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "un", "##aff", "##able", "hello", "!", "cafe", "日"])}


def test_tokens():
    assert e.normalize("Café\tHÉLLO\x00日本") == "cafe hello 日  本 "
    assert e.pre_tokenize("hello,world! it's $5") == ["hello", ",", "world", "!", "it", "'", "s", "$", "5"]
    assert e.word_pieces("unaffable", VOCABULARY) == ["un", "##aff", "##able"] and e.word_pieces("unx", VOCABULARY) == ["[UNK]"] and e.word_pieces("x" * 101, VOCABULARY) == ["[UNK]"]
    assert e.tokenize("Café hello! zzz", VOCABULARY) == [7, 5, 6, 1]


def test_embedders(spark):
    rows = np.random.default_rng(0).normal(size=(len(VOCABULARY), 8)).astype(np.float32)
    s = e.StaticEmbedder(VOCABULARY, rows)
    mean = rows[[5, 6]].mean(0)
    assert np.allclose(s("hello!"), mean / np.linalg.norm(mean), atol=1e-6) and np.allclose(s(""), rows[0] / np.linalg.norm(rows[0]), atol=1e-6)
    h = e.hashing_embedder()
    assert np.allclose(h("a b"), h("B A")) and h("a") != h("b") and h("") == [0.0] * 64 and abs(np.linalg.norm(h("x y z")) - 1) < 1e-6
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert np.allclose(df.select(e.embed(df.t, h, spark)).collect()[0][0], h("a b"))
