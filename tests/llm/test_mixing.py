from __future__ import annotations

import re
from collections import defaultdict

from docengine.llm import mixing


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Cut and share anew until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, free, total = {}, set(names), share * sum(sizes.values())
    while free:
        rest, all_w = total - sum(done.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / all_w >= most * sizes[s]]
        if not over:
            return done | {s: rest * w[s] / all_w for s in free}
        for s in over:
            done[s] = most * sizes[s]
            free.discard(s)
    return done


def test_targets_and_sizes(docs, rows):
    out = mixing.mix(docs, (5, 2, 1), 1.5, 2).collect()
    assert len(out) == len(rows)
    size, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    want = targets(size)
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
    for s, t in want.items():
        # source b is one document of 30000 words and little else: no whole documents come near
        assert abs(taken[s] - t) <= (longest[s] if s == "b" else 0.05 * t + 10), (s, taken[s], t)
        assert s != "b" or taken[s] > size[s]


def test_reruns_agree_and_columns_stay(docs, clash):
    a = {(r["doc_id"], r["text"], r["copies"]) for r in mixing.mix(docs, (5, 2, 1), 1.5, 2).collect()}
    out = mixing.mix(clash.repartition(7), (5, 2, 1), 1.5, 2)
    assert out.columns[: len(clash.columns)] == clash.columns
    copies = out.columns[len(clash.columns) + 3]
    assert a == {(r["doc_id"], r["text"], r[copies]) for r in out.collect()}


def test_importance_and_repeat(docs):
    from pyspark.sql import functions as F

    d = docs.where("source = 'hot'").withColumn("w", F.when(F.col("doc_id") < 127, 1.0).otherwise(0.0))
    out = mixing.mix(d, (1,), 1.0, 2, importance_col="w")
    got = {r["doc_id"]: r["copies"] for r in out.collect()}
    assert all(n == 0 for k, n in got.items() if k >= 127) and sum(got.values()) >= 12
    assert mixing.repeat(out, d.columns).count() == sum(got.values())


def test_empty(empty):
    assert mixing.mix(empty, (5, 2, 1), 1.5).count() == 0


def test_gaps_are_filled(spark):
    # each source is many small documents and one with a fourth of its words
    from pyspark.sql import functions as F

    d = spark.range(40 * 101).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 101).cast("string").alias("source"), F.when(F.col("id") % 101 == 100, 1000).otherwise(11 + F.col("id") * 7 % 37).cast("int").alias("n"))
    out = mixing.mix(d.select("doc_id", "source", F.repeat(F.lit("w "), F.col("n")).alias("text")), (1,), 1.5, 2).collect()
    gap = {r["source"]: r["target"] for r in out}
    for r in out:
        gap[r["source"]] -= r["taken"]
    for r in out:
        # whole copies are one each: those without a second one are too long for what is left
        assert 0 <= gap[r["source"]] <= 0.02 * r["target"] and r["copies"] in (1, 2)
        assert r["copies"] == 2 or r["size"] > gap[r["source"]], (r["source"], gap[r["source"]])


def test_rows_that_tie_are_charged(spark):
    # each source is small documents, and one that comes twelve times with its id
    from pyspark.sql import functions as F

    one = F.when(F.col("id") % 112 >= 100, 100).otherwise(F.col("id") % 112)
    d = spark.range(40 * 112).select((F.floor(F.col("id") / 112) * 112 + one).alias("doc_id"), F.floor(F.col("id") / 112).cast("string").alias("source"), F.when(one == 100, 60).otherwise(60 + one * 7 % 37).cast("int").alias("n"))
    out = mixing.mix(d.select("doc_id", "source", F.repeat(F.lit("w "), F.col("n")).alias("text")), (1,), 1.5, 2).collect()
    gap, tied = {r["source"]: r["target"] for r in out}, defaultdict(list)
    for r in out:
        gap[r["source"]] -= r["taken"]
        tied[r["doc_id"]].append(r)
    assert all(0 <= g < 60 for g in gap.values()), gap
    for group in tied.values():
        assert len({r["copies"] for r in group}) == 1
        assert group[0]["copies"] == 2 or sum(r["size"] for r in group) > gap[group[0]["source"]]
    assert {r["copies"] for g in tied.values() if len(g) == 12 for r in g} == {1, 2}


def test_selection_against_a_plain_version(docs, rows):
    """Which documents are drawn: in order of random odds by inclusion odds, each that still fits, until none does."""
    from pyspark.sql import functions as F

    tie = F.xxhash64(F.lit(2), "doc_id", "text")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(1), tie), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    groups = defaultdict(lambda: [0, 0, 0.0])
    size = defaultdict(int)
    for r in docs.select("source", "text", tie.alias("tie"), u.alias("u")).collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        g = groups[(r["source"], r["tie"], n)]
        g[0] += 1
        g[1] += n
        g[2] = r["u"]
        size[r["source"]] += n
    want = {}
    for s, target in targets(size).items():
        rate = min(target / size[s], 2.0) if size[s] else 0.0
        whole, pi = int(rate), rate - int(rate)
        own = [(k, *g) for k, g in groups.items() if k[0] == s]
        gap = target - sum(whole * g[2] for g in own)
        want |= {g[0]: whole for g in own}
        order = []
        for k, _, all_, x in own:
            if pi > 0 and k[2] > 0:
                odds = (x / (1 - x)) / (pi / (1 - pi))
                order.append((odds / (1 + odds), k[1], k, all_))
        for _, _, k, all_ in sorted(order):
            if all_ <= gap:
                gap -= all_
                want[k] += 1
    out = mixing.mix(docs, (5, 2, 1), 1.5, 2).withColumn("tie", tie).collect()
    assert len(out) == len(rows) and all(r["copies"] == want[(r["source"], r["tie"], r["size"])] for r in out)


def test_null_ids_are_drawn_one_by_one(spark):
    data = [(None, f"word {k} of many", "a") for k in range(400)]
    out = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), (1,), 0.5, 2).collect()
    assert sum(r["copies"] for r in out) == 200


def test_repeat_takes_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 7, 2), (2, 8, 0)], "id long, _copy long, copies long")
    assert [tuple(r) for r in mixing.repeat(df, ["id", "_copy"]).collect()] == [(1, 7), (1, 7)]
