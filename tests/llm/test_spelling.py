from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docengine.llm import spelling
from docengine.llm.queries import op13_spelling_variants


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts: dict[str, int], ratio: int) -> set[tuple]:
    forms, out = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(close))
    rows = set()
    for w, (n, n_near) in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, n, n_near, forms[w], counts[forms[w]] if forms[w] else None, root))
    return rows


def some_words(rnd: random.Random, n: int, letters: str, lengths: tuple[int, int]) -> dict[str, int]:
    out = {}
    while len(out) < n:
        w = "".join(rnd.choice(letters) for _ in range(rnd.randint(*lengths)))
        for _ in range(rnd.randint(1, 4)):
            out[w] = rnd.choice([1, 2, 3, 20, 50, 300, 5000])
            k = rnd.randrange(len(w))
            w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1 :]]) or "a"
    return out


@pytest.mark.parametrize(("seed", "letters", "lengths", "block", "largest"), [(1, "ab", (1, 9), 64, 8192), (2, "abcé日\U0001f600", (1, 12), 2048, 8192), (3, "ab", (5, 12), 64, 4), (4, "abcd\x00", (30, 60), 10, 3)])
def test_against_brute_force(spark, seed, letters, lengths, block, largest):
    counts = some_words(random.Random(seed), 400, letters, lengths)
    out = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), ratio=10, block=block, largest=largest)
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert {tuple(r) for r in out.collect()} == brute(counts, 10) and out.count() == len(counts)


def test_pairs_are_found_once_whatever_the_part():
    """Each part finds the pairs whose first difference it has; together these are all, each once in each direction."""
    words = [w for w in some_words(random.Random(5), 300, "ab", (6, 7)) if len(w) in (6, 7)]
    total = sum(spelling.near_words(words, 6, b, e)[0] for b, e in ((0, 2), (2, 4), (4, 6)))
    want = [sum(near(w, v) and min(len(w), len(v)) == 6 for v in words) for w in words]
    assert total.tolist() == want


def test_nulls_repeats_and_empty(spark):
    rows = [("alphabet", 3), ("alphabet", 40), ("alphabt", 2), (None, 5), ("", 6), ("a" * 3000, 1), ("a" * 3001, 10)]
    out = spelling.variants(spark.createDataFrame(rows, "word string, n long").withColumn("root", F.lit(1)))
    assert {r["word"][:9]: (r["n"], r["n_near"], (r["form"] or "")[:9], len(r["root"])) for r in out.collect() if len(r["word"]) < 3001} == {"alphabet": (40, 1, "", 8), "alphabt": (2, 1, "alphabet", 8), "aaaaaaaaa": (1, 1, "aaaaaaaaa", 3001)}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def plain_counts(rows) -> dict[str, int]:
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_query(spark, tmp_path, monkeypatch):
    rnd = random.Random(9)
    stems = ["".join(rnd.choice("abcÉé") for _ in range(rnd.randint(6, 10))) for _ in range(60)]
    rows = [(rnd.choice([None, k]), " ".join(rnd.choice(["", "X-", "1", "É"]) + rnd.choice(stems) for _ in range(300)), "en", "a", 1) for k in range(60)] + [(70, None, None, None, None), (71, "", "en", "a", 0), (72, "b" * 5000 + " " + "b" * 5000, "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_spelling_variants(spark, str(tmp_path)).collect()]
    want = [(w, f, root, n, k, fn) for w, n, k, f, fn, root in brute(plain_counts(rows), 10)]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[1] for r in got)


def test_windows_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "WINDOW", 5)
    letter, run = re.compile("[a-z]"), re.compile("[a-z]{3,}")
    for text in ("", "abc", "ab abcdefgh  abcd e", "abcdefghijklmnop", "    abcde     fgh"):
        assert list(spelling.runs(text, letter, run)) == run.findall(text)


def test_vocabulary_of_odd_tables(docs, clash, empty, rows):
    want = Counter()
    for _, text, *_ in rows:
        want.update(w for w in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if len(w) >= 5)
    want = {w: n for w, n in want.items() if n >= 2}
    for d in (docs, clash):
        assert dict(map(tuple, spelling.vocabulary(d, shortest=5).collect())) == want
    assert spelling.vocabulary(empty).count() == 0
