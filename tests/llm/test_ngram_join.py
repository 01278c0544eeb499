from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import ngram_join as nj
from tests.llm.conftest import sentence


WORDS_OF = r"[^\x20\x09-\x0D]+"


def grams_of(text, n=5):
    w = tuple(re.findall(WORDS_OF, text or ""))
    return frozenset(w[i : i + n] for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similar(a, b):
    c = len(a & b)
    return bool(c) and 5 * c >= 4 * (len(a) + len(b) - c)


def brute(rows, n=5):
    """All pairs of distinct texts: rows of (id, class, copy, copies), and the links between texts."""
    words = [tuple(re.findall(WORDS_OF, t or "")) for _, t, *_ in rows]
    grams = {w: grams_of(" ".join(w), n) for w in set(words) if w}
    where = defaultdict(list)
    for k, w in enumerate(words):
        where[w].append(rows[k][0])
    up = {w: w for w in grams}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    all_, links = list(grams), 0
    for i, a in enumerate(all_):
        for b in all_[:i]:
            if similar(grams[a], grams[b]):
                links += 1
                up[root(a)] = root(b)
    members = defaultdict(list)
    for w in grams:
        members[root(w)] += [i for i in where[w] if i is not None]
    out = []
    for k, w in enumerate(words):
        i = rows[k][0]
        if not w:
            out.append((i, i, i, 1))
        else:
            ids = [x for x in where[w] if x is not None]
            own = members[root(w)]
            out.append((i, min(own) if own else None, min(ids) if ids else None, len(where[w])))
    return sorted(out, key=str), links, len(grams) - len({root(w) for w in grams})


@pytest.fixture(scope="module")
def family():
    """A base text, many variants of few edits, and texts that share a long passage with each other but aren't near."""
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    out = []
    for k in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(1000)}"
        out.append((k, " ".join(w)))
    for k in range(60):
        out.append((200 + k, " ".join([f"p{i}" for i in range(60)] + [f"x{k}{i}" for i in range(40)])))
    return out + [(300 + k, sentence(rnd, 40)) for k in range(40)]


def same(df, rows):
    """Classes equal brute force; pairs of representatives are true links, as many as it takes to connect the classes."""
    got = df.select("doc_id", "class_id", "copy_id", "copies", "near_ids").collect()
    want, _, joins = brute(rows)
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, []).append(grams_of(t))
    pairs = {(r["copy_id"], near) for r in got if r["copy_id"] is not None for near in r["near_ids"]}
    assert all(any(similar(x, y) for x in text[a] for y in text[b]) for a, b in pairs)
    assert joins <= len(pairs) <= 3 * joins


def test_against_brute_force(docs, clash, rows):
    same(nj.near_duplicates(docs), rows)
    same(nj.near_duplicates(clash), rows)


@pytest.mark.parametrize(("bucket", "block"), [(256, 256), (8, 16)])
def test_large_buckets_and_blocks(spark, family, bucket, block):
    same(nj.near_duplicates(spark.createDataFrame(family, "doc_id long, text string"), bucket=bucket, block=block), family)


def test_keep_one(docs, rows, empty):
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    worded = [r for r in kept.collect() if (r["text"] or "").split()]
    ids = sorted(r["doc_id"] for r in worded if r["doc_id"] is not None)
    want = sorted({r[1] for r in brute(rows)[0] if r[1] is not None} - {i for i, t, *_ in rows if not (t or "").split()})
    assert ids == want
    assert sum(1 for r in kept.collect() if not (r["text"] or "").split()) == sum(1 for _, t, *_ in rows if not (t or "").split())
    assert nj.keep_one(empty).count() == 0


def test_keep_one_takes_columns_of_any_name(docs, rows):
    names = "_id _i _t _tie _may _gone _id2 _tie2 cid id tie rep class_key near_ids".split()
    clash = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    kept = nj.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted(kept.select(*docs.columns).collect(), key=str) == sorted(nj.keep_one(docs).collect(), key=str)


@pytest.mark.parametrize("size", [30])
def test_chains_over_many_blocks(spark, size):
    """A chain of texts, each near the next one alone, is one class however its sets are dealt to blocks."""
    words = [f"c{k}" for k in range(40 + 3 * size)]
    chain = [(k, " ".join(words[3 * k : 3 * k + 40])) for k in range(size)]
    assert brute(chain)[1] == size - 1
    same(nj.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), block=4), chain)


def test_recall(spark):
    """Of all links that brute force finds in pairs around the threshold, those whose ends get into one class."""
    rnd = random.Random(21)
    rows = []
    for k in range(150):
        w = [f"r{k}x{i}" for i in range(60)]
        rows.append((2 * k, " ".join(w)))
        for _ in range(rnd.choice([1, 1, 2])):
            w[rnd.randrange(5, 55)] = "edit"
        rows.append((2 * k + 1, " ".join(w)))
    want = {(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2], strict=True) if similar(grams_of(a[1]), grams_of(b[1]))}
    cls = {r["doc_id"]: r["class_id"] for r in nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 50 and sum(cls[a] == cls[b] for a, b in want) >= 0.99 * len(want)
    assert all(cls[2 * k] != cls[2 * k + 1] for k in range(150) if (2 * k, 2 * k + 1) not in want)


def test_empty(empty):
    assert nj.near_duplicates(empty).count() == 0


def test_word_hashes_do_not_depend_on_place():
    a, _, w, _ = nj.shingles(["a b c d e f".encode(), "zz  a\tb c d e\nf".encode(), b"", "é".encode()], 5)
    assert a[0] == a[3] and a[1] == a[4] and len(set(a.tolist())) == 4 and len(w) == 14 and w[0] == w[7]


def test_words_of_segments():
    rnd = random.Random(5)
    data = np.frombuffer(("".join(rnd.choice("ab \n\t") for _ in range(3000)) + "x" * 500 + " ").encode(), np.uint8)
    h, b = nj.word_hashes(data)
    for size in (1, 7, 64, 10_000):
        g, a = nj.words_of(data, size)
        assert np.array_equal(h, g) and np.array_equal(b, a)


def test_runs_reach_recall():
    assert nj.runs_for(0.99999) * nj.SAMPLED <= nj.LANES and nj.runs_for(0.9) < nj.runs_for(0.999)


def test_components(spark):
    from docengine.llm.common import components

    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_links_of_blocks():
    sets = [np.array(sorted(s), np.uint64) for s in ({1, 2, 3, 4, 5}, {1, 2, 3, 4}, {9}, {1, 2, 3, 4, 6})]
    a, b = nj.exact_links(sets, np.array([0, 1]), np.array([2, 3]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 1)]


def test_vectors_of_long_texts_tell_them_apart(spark):
    """Positions agree with the probability of the similarity, however long the texts are."""
    rnd = random.Random(2)
    word = lambda: f"v{rnd.randrange(10**6)}"
    base = [word() for _ in range(6000)]
    near = [w if rnd.random() > 0.02 else word() for w in base]
    texts = [" ".join(base), " ".join(near), " ".join(word() for _ in range(6000))]
    lanes = [np.frombuffer(r["lanes"], np.uint8) for r in nj.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 5, 7).orderBy("id").collect()]
    a, b, c = (grams_of(t) for t in texts)
    true = len(a & b) / len(a | b)
    assert abs((lanes[0] == lanes[1]).mean() - true) < 0.12 and (lanes[0] == lanes[2]).mean() < 0.05
