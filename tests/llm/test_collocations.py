from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import collocations


def brute(rows, longest, least, top, share=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    longer = Counter()
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                longer[lang, words[i : i + k]] = max(longer[lang, words[i : i + k]], a)
    out = {}
    for (lang, words), a in found.items():
        if 100 * longer[lang, words] >= share * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, some in out.items() for k, (s, a, p, l, r) in enumerate(sorted(some)[:top]))


def some_rows(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["a", "b", "C", "é", "日本", "the", "of", "\x00", "x-y", "\U0001f600", "c"]
    fixed = ["a b c é the", "Of the a", "x-y \x00 b"]
    out = []
    for _ in range(n):
        text = "".join(rnd.choice([rnd.choice(words), rnd.choice(words), rnd.choice(fixed)]) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", " ", "!?"]) for _ in range(rnd.randint(0, 40)))
        out.append((text, rnd.choice(["en", "en", "de", None, "x\ny"])))
    return [*out, (None, "en"), ("", None), (None, None), ("only one", "fr"), out[0], out[0], (" ".join(rnd.choice(words) for _ in range(20000)), "en")]


@pytest.mark.parametrize(("longest", "least", "top", "share", "chunk", "parts"), [(5, 20, 2000, 100, 1 << 21, 3), (5, 5, 7, 60, 50, 3), (3, 2, 50, 100, 7, 1), (2, 300, 10, 100, 1000, 2)])
def test_against_brute_force(spark, longest, least, top, share, chunk, parts):
    rows = some_rows(4, 300)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(parts).withColumns({c: F.lit(1) for c in ("phrase", "key", "n", "rank", "SIZE")})
    out = collocations.phrases(docs, longest=longest, min_count=least, top=top, share=share, chunk=chunk, counters=1 << 24)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, longest, least, top, share)
    assert sorted(tuple(r) for r in out.collect()) == want and want


def test_collisions_and_full_counters(spark, monkeypatch):
    """Fingerprints of few bits collide all the time, counters are full, words share their bits: counts stay exact."""
    import docengine.llm.collocations as c

    x = np.random.default_rng(1).integers(0, 4, 500).astype(np.int32)
    reader = c.Reader(np.full(c.WORD_BITS // 8, 255, np.uint8), 4, 100)
    for w in (b"a", b"b", b"c", b"d"):
        reader.of(b"en")[w]
    monkeypatch.setattr(c, "mixed", lambda f: f & np.uint64(3))
    known = type("B", (), {"value": reader.known})
    likely = type("B", (), {"value": np.full(8, 255, np.uint8)})

    class Texts:
        """Runs what it is given on one batch, as one task."""

        def __init__(self, batches):
            self.batches = batches

        def mapInArrow(self, run, schema):
            return Texts(list(run(iter(self.batches))))

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([" ".join("abcd"[k] for k in x)]), pa.array(["en"])], names=["text", "lang"])
    got = Counter()
    for b in c.count_phrases(Texts([batch]), known, likely, 4, 1 << 24, 64, 100, 1, 2, held=10).batches:
        for r in b.to_pylist():
            got[r["phrase"]] += r["n"]
    want = Counter(" ".join("abcd"[k] for k in x[i : i + n]) for n in (2, 3, 4) for i in range(len(x) - n + 1))
    assert got == want


def test_fingerprints_depend_on_words_alone():
    c = collocations
    reader = c.Reader(np.full(c.WORD_BITS // 8, 255, np.uint8), 3, 100)
    a, b, d = (reader.of(b"en")[w] for w in (b"a", b"b", b"d"))
    x = np.array([a, b, d, -1, a, b, d, a, d, b, -1], np.int32)
    found = {n: dict(zip(at.tolist(), f.tolist(), strict=True)) for n, at, f in reader.fingerprints(x, len(x), c.powers_of_base(len(x)))}
    assert found[2][0] == found[2][4] and found[3][0] == found[3][4] and set(found[3]) == {0, 4, 5, 6, 7} and len({*found[2].values(), *found[3].values()}) == 9
    assert pow(c._BASE, 5, 1 << 64) == int(c.powers_of_base(6)[0][5])


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000
    exact = f"cast(cast(1000 as decimal(38, 0)) * cast({big} as decimal(38, 0)) * cast({big + 1} as decimal(38, 0)) div (cast({big - 1} as decimal(38, 0)) * cast(7 as decimal(38, 0))) as bigint)"
    assert spark.range(1).select(F.expr(exact)).first()[0] == 1000 * big * (big + 1) // ((big - 1) * 7)


def test_slices_keep_words_whole(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 3)
    for text in (b"", b"abcdef gh", b" a  b,c d\te", b"abcdefgh"):
        got = [w for part in collocations.pieces(text) for w in part if w]
        assert got == [w for w in text.replace(b",", b" \n ").replace(b"\t", b" ").split(b" ") if w]


def test_empty(empty):
    assert collocations.phrases(empty, counters=1 << 24).count() == 0
