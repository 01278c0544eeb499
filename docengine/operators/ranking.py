"""Ranking: rules, fusion of ranked lists, diversity, metrics."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import cmp_to_key
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a match of each quality is worth, and the order of qualities
BASE_SCORES = {"exact": 100, "prefix": 80, "contains": 60, "match": 50, "substring": 30, "fuzzy": 20, "body": 10, "relaxed": 9, "relaxed-or": 7, "relaxed-token": 5}
QUALITIES = tuple(BASE_SCORES)
# Kinds that are symbols
SYMBOL_KINDS = (
    "symbol", "class", "cl", "structure", "struct", "structp", "protocol", "enum", "enumeration", "econst", "case", "union", "property wrapper", "property", "instp", "var", "type alias",
    "typealias", "tdef", "function", "func", "method", "instm", "clm", "init", "op", "macro",
)
# Sources that are preferred, in order
SOURCE_WEIGHTS = {"apple-docc": 1.3, "hig": 1.2, "sample-code": 1.12, "guidelines": 1.05}


def _map(column: Column, values: dict[str, float], default: float) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(column == k, F.lit(float(v))) if out is None else out.when(column == k, F.lit(float(v)))
    return out.otherwise(F.lit(float(default)))


def rule_score(query: str, intent: str) -> Column:
    """The score of a hit (match_quality, path, title, kind, source_type, url_depth, is_release_notes): a base times its rules' factors, left to right."""
    q = query.lower()
    source, kind, title = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("source_type", "kind", "title"))
    path = F.coalesce(F.col("path"), F.lit(""))
    score = _map(F.col("match_quality"), BASE_SCORES, 50)

    def times(test: Column, factor: float | Column) -> None:
        nonlocal score
        score = score * F.when(test, factor if isinstance(factor, Column) else F.lit(factor)).otherwise(F.lit(1.0))

    same = (F.lower(F.substring_index(path, "/", -1)) == q) | (title == q)
    times(same, 3.0)
    times(same & (F.col("title") == query), 1.1)
    if intent == "symbol":
        times(kind.isin(*SYMBOL_KINDS), 1.5)
    if intent == "howto":
        times(source.isin("hig", "guidelines") | (kind == "article"), 1.3)
    times(F.coalesce(F.col("is_release_notes"), F.lit(False)) | path.contains("release-notes"), 0.4)
    times(source == "apple-archive", 0.6)
    if intent == "howto" or "example" in q or "sample" in q:
        times(source == "sample-code", 1.2)
    times(source == "packages", 0.45)
    times((source == "packages") & (F.lit("package" in q or "library" in q) | (title == q)), 1.5)
    score = score * _map(source, SOURCE_WEIGHTS, 1.0)
    depth = F.coalesce(F.col("url_depth"), F.lit(0))
    times(depth > 0, F.greatest(F.lit(0.3), 1.0 - depth * 0.05))
    if intent == "error":
        times((kind == "article") | title.contains("error") | title.contains("troubleshoot"), 1.2)
    if intent == "concept":
        times((kind == "article") | source.isin("hig", "swift-book"), 1.2)
    if intent == "wwdc":
        times(source == "wwdc", 1.4)
    return score


def rerank_rows(rows: Sequence[dict[str, Any]]) -> list[dict[str, Any]]:
    """Orders a page's rows by score; within 0.001 by quality, then source, else as they were. On the driver, for a few hundred rows."""
    quality = {q: i for i, q in enumerate(QUALITIES)}
    source = {s: i for i, s in enumerate(SOURCE_WEIGHTS)}

    def compare(a: dict[str, Any], b: dict[str, Any]) -> float:
        if abs(d := b["score"] - a["score"]) > 0.001:
            return d
        if d := quality.get(a.get("match_quality"), 9) - quality.get(b.get("match_quality"), 9):
            return d
        return source.get((a.get("source_type") or "").lower(), 99) - source.get((b.get("source_type") or "").lower(), 99)

    return sorted(rows, key=cmp_to_key(compare))


def normalize_scores(rows: DataFrame, by: str = "list", score: str = "score") -> DataFrame:
    """Adds norm: scores of a list from 0 to 1; all 0 if they are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("norm", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.0))


def weighted_rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows (list, key, rank from 1, weight): (key, fused)."""
    return lists.groupBy("key").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("fused"))


def hybrid_fusion(lists: DataFrame, k: int = 60, beta: float = 0.5) -> DataFrame:
    """The same, plus beta times the weighted normalised score; rows have a score too."""
    return normalize_scores(lists).groupBy("key").agg(F.sum(F.col("weight") / (k + F.col("rank")) + beta * F.col("weight") * F.col("norm")).alias("fused"))


def hoist_exact(rows: DataFrame, window: int, most: int = 5) -> DataFrame:
    """The first `window` rows with their position: exact hits first, in lexical order, if there are 1 to `most` of them; then by fused score.

    Rows are cut to the window before they are numbered.
    """
    exact = F.coalesce(F.col("match_quality") == "exact", F.lit(False))
    n = rows.where(exact).limit(most + 1).count()
    first = exact & F.lit(1 <= n <= most)
    order = (first.desc(), F.when(first, F.col("lexical_rank")).asc_nulls_last(), F.col("fused").desc(), F.col("key"))
    return rows.orderBy(*order).limit(window).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def mmr(ranked: Sequence[Any], vector_of: Callable[[Any], Any], similarity: Callable[[Any, Any], float], lam: float = 0.7, limit: int | None = None) -> list[Any]:
    """Maximal marginal relevance over a window of a page, on the driver: relevance by place, less what is alike already.

    Items without a vector are like none. One or two items stay as they are.
    """
    n = len(ranked)
    if n <= 2:
        return list(ranked)
    vectors = [vector_of(r) for r in ranked]
    alike = [0.0] * n
    left, chosen = list(range(1, n)), [0]
    while left and len(chosen) < min(limit or n, n):
        last = vectors[chosen[-1]]
        for i in left:
            if last is not None and vectors[i] is not None:
                alike[i] = max(alike[i], similarity(vectors[i], last))
        best = max(left, key=lambda i: (lam * (n - i) / n - (1 - lam) * alike[i], -i))
        left.remove(best)
        chosen.append(best)
    return [ranked[i] for i in chosen + left]


def hamming_similarity(a: Sequence[int], b: Sequence[int]) -> float:
    return 1 - sum(((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip(a, b, strict=True)) / (64 * len(a))


def confidence(quality: Column) -> Column:
    """What a surface shows of a match's quality."""
    return F.when(quality == "exact", "exact").when(quality.isin("prefix", "contains", "match"), "partial").otherwise("approximate")


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """recall, ndcg and mrr at k of each query, from (query, key, rank) and the judgments (query, key)."""
    n = relevant.groupBy("query").agg(F.count("*").alias("relevant"))
    hits = ranked.join(relevant, ["query", "key"], "left_semi").groupBy("query").agg(
        F.sum((F.col("rank") <= k).cast("int")).alias("found"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min("rank").alias("first")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return n.join(hits, "query", "left").select(
        "query", (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr")
    )


def metric_means(metrics: DataFrame, by: Sequence[str] = ("config", "kind")) -> DataFrame:
    """Means of recall, ndcg and mrr for each configuration and kind of query, with the number of queries."""
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in ("recall", "ndcg", "mrr")])


def nearest_rank(values: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Percentiles by nearest rank: the smallest value with the share of values at or below it; counts of values are combined, none is sorted whole."""
    at = [F.expr(f"percentile_disc({s}) within group (order by `{column}`)") for s in shares]
    return values.where(F.col(column).isNotNull()).groupBy(*by).agg(*[x.alias(f"p{round(s * 100)}") for x, s in zip(at, shares, strict=True)])


# Upper bounds of the latency buckets, in milliseconds
LATENCY_BUCKETS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500)


def histogram(values: DataFrame, column: str, bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts (le, n) of values from 0 on; the last bound is infinite."""
    ok = values.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) >= 0))
    counts = ok.agg(*[F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("b_all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(math.inf).alias("le"), F.col("b_all").alias("n")))
    return counts.select(F.inline(rows))
