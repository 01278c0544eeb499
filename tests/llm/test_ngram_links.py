from __future__ import annotations

import random
import re

import pytest

from docengine.llm import ngram_join as nj
from tests.llm.conftest import sentence


def linked(rows, n=5):
    """How many other rows each row is linked to, by all pairs."""
    words = [tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    grams = [frozenset(w[i : i + n] for i in range(max(1, len(w) - n + 1))) if w else frozenset() for w in words]
    near = lambda a, b: bool(c := len(a & b)) and 5 * c >= 4 * (len(a) + len(b) - c)
    return sorted((i, sum(near(grams[k], grams[j]) for j in range(len(rows)) if j != k)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [256, 16, 5])
def test_every_link_is_counted(spark, block):
    """Many variants of a text, some with copies: a tree of a class has fewer links than the class."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [sentence(rnd, 40) for _ in range(10)] + texts[:7] + texts[:3] + ["", None]
    rows = list(enumerate(texts))
    df = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    got = sorted((r["doc_id"], r["links"]) for r in df.select("doc_id", "links").collect())
    assert got == linked(rows)
    pairs = sum(len(r["near_ids"]) for r in df.collect())
    assert sum(n for _, n in got) // 2 > 3 * pairs
