from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from docengine.llm import exact_dedup


def test_groups_match_brute_force(docs, clash, rows):
    for d in (docs, clash):
        out = exact_dedup.exact_groups(d, carry={"sha": F.sha2("_norm", 256)}).collect()
        assert len(out) == len(rows)
        groups = defaultdict(list)
        for i, text, *_ in rows:
            groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(i)
        for r in out:
            own = groups[r["sha"]]
            ids = [i for i in own if i is not None]
            assert r["group_size"] == len(own) and r["keep_id"] == (min(ids) if ids else None)
        kept = defaultdict(int)
        for r in out:
            kept[r["sha"]] += r["kept"]
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
        assert set(kept.values()) == {1} and set(kept) == set(groups)


def test_collisions_of_length_and_prefix(spark):
    """Texts that agree in length and prefix alone are told apart by the full hash."""
    texts = ["x" * 300 + str(k) for k in (1, 2, 2, 3)]
    out = exact_dedup.exact_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["keep_id"] for r in out} == {0: 0, 1: 1, 2: 1, 3: 3}


def test_keep_one_and_empty(docs, empty):
    one = exact_dedup.keep_one(docs)
    assert one.columns == docs.columns
    want = exact_dedup.exact_groups(docs).where("kept")
    assert sorted(r["doc_id"] or -1 for r in one.collect()) == sorted(r["doc_id"] or -1 for r in want.collect())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def test_keep_one_takes_columns_of_any_name(docs):
    clash = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate("_i _id _t _tie _may _gone _id2 _tie2 keep_id kept".split())])
    out = exact_dedup.keep_one(clash)
    assert out.columns == clash.columns
    assert sorted(out.select("doc_id", "text").collect(), key=str) == sorted(exact_dedup.keep_one(docs).select("doc_id", "text").collect(), key=str)
