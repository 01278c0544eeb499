from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docengine.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least, min_chars=1):
    seen = defaultdict(set)
    for n, (_, text, *_) in enumerate(rows):
        for line in (text or "").split("\n"):
            seen[key(line)].add(n)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(seen[key(x)]) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "chars", "broadcast"), [(10, 1, 1000), (2, 1, 0), (2, 12, 1000)])
def test_against_brute_force(docs, rows, least, chars, broadcast):
    out = line_dedup.dedup_lines(docs, min_docs=least, min_chars=chars, bits=1 << 16, broadcast_lines=broadcast)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str) == brute(rows, least, chars)


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_first_occurrence_stays(spark, broadcast):
    rows = [(3, "x\ny"), (1, "a\nX \nx"), (2, "x\nb"), (None, "c")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True, bits=1 << 16, broadcast_lines=broadcast)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a\nX ", 2: "b", 3: "y", None: "c"}


def test_clash_and_empty(clash, empty, rows):
    out = line_dedup.dedup_lines(clash, min_docs=10, bits=1 << 16)
    assert out.columns == [*clash.columns, "_n_lines", "_n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["_n_lines"], r["_n_dropped"]) for r in out.collect()), key=str) == brute(rows, 10)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_filter_misses_nothing_when_full(docs, rows):
    """A filter of few bits suspects every line, and the exact count still decides."""
    out = line_dedup.dedup_lines(docs, min_docs=10, bits=1 << 15)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str) == brute(rows, 10)


def test_a_filter_for_each_range(docs, rows, monkeypatch):
    """Many ranges, each with its filter, whether the second filter is broadcast or stays dealt out."""
    monkeypatch.setattr(line_dedup, "RANGE_BITS", 1 << 16)
    bits, hashes = 1 << 20, docs.select(F.transform(line_dedup.lines_of(F.col("text")), lambda x: F.xxhash64(line_dedup.line_key(x))).alias("h"))
    chunks = [r["chunk"] for r in line_dedup.seen_twice(hashes.select(F.array_distinct("h")), bits).collect()]
    assert len(set(chunks)) == len(chunks) and max(chunks) > 2 and max(chunks) < bits // line_dedup.CHUNK_BITS
    same = [sorted(tuple(r) for r in line_dedup.repeated_lines(docs, bits=bits, broadcast_bits=most).select("n_docs", "first_tie").collect()) for most in (1 << 30, 0)]
    assert same[0] == same[1] and same[0]


def test_clash_where_repeated_lines_are_joined(docs, rows):
    names = "_id _t _tie _own _id2 _tie2 digest key first_id".split()
    clash = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    out = line_dedup.dedup_lines(clash, min_docs=10, bits=1 << 16, broadcast_lines=0)
    assert out.columns == [*clash.columns, "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str) == brute(rows, 10)
