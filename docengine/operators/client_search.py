"""Title search as a browser does it over the exported index: inverted and prefix postings, then scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = 4


def terms_of(text: F.Column) -> F.Column:
    spaced = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2"))
    return F.filter(F.split(spaced, r"[\s._/\\]+"), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    return [t for t in re.split(r"[\s._/\\]+", re.sub("([a-z])([A-Z])", r"\1 \2", query).lower()) if t]


def build(index: DataFrame) -> DataFrame:
    """Postings (term, key) of titles and keys."""
    return index.select("key", F.explode(F.array_distinct(F.concat(terms_of(F.col("title")), terms_of(F.col("key"))))).alias("term"))


def search(index: DataFrame, postings: DataFrame, query: str, aliases: dict[str, str] | None = None, limit: int = 50) -> DataFrame:
    """(key, title, score): exact title 100, its beginning 80, the key's end 75, all terms 60, some 30 by their share; less half a point for each slash.

    A term's candidates are the titles that have it, else those that have a word with its first four
    letters. Candidates have all terms if every term has some, else any. Without any, aliases are tried.
    """
    terms = list(dict.fromkeys(query_terms(query)))
    if not terms:
        return index.select("key", "title", F.lit(0.0).alias("score")).limit(0)
    q = query.lower()

    def found(words: list[str]) -> DataFrame:
        tests = F.array(*[F.struct(F.lit(w).alias("w"), (F.col("term") == w).alias("exact"), (F.startswith("term", F.lit(w[:PREFIX])) & F.lit(len(w) >= 2)).alias("near")) for w in words])
        hits = postings.select("key", F.explode(F.filter(tests, lambda t: t["exact"] | t["near"])).alias("t")).select("key", "t.w", "t.exact", "t.near").distinct()
        has = hits.groupBy("w").agg(F.max("exact").alias("any_exact"))
        return hits.join(F.broadcast(has), "w").where(F.col("exact") | ~F.col("any_exact")).select("key", "w").distinct()

    hits = found(terms).persist()
    n = hits.select("w").distinct().count()
    if n == 0 and aliases and (other := [aliases[t] for t in terms if t in aliases]):
        candidates = found(other).select("key").distinct()
    else:
        counts = hits.groupBy("key").agg(F.count("*").alias("n"))
        candidates = (counts.where(F.col("n") == len(terms)) if n == len(terms) else counts).select("key")
    title, key = F.lower("title"), F.lower("key")
    all_in, some = None, F.lit(0)
    for t in terms:
        all_in = title.contains(t) if all_in is None else all_in & title.contains(t)
        some = some + (title.contains(t) | key.contains(t)).cast("int")
    score = F.when(title == q, 100.0).when(title.startswith(q), 80.0).when(key.endswith(f"/{q}") | (key == q), 75.0).when(all_in, 60.0).otherwise(30 * (some / len(terms)))
    alias = [x for t in terms if aliases and t in aliases for x in (t, aliases[t])]
    if alias and "framework" in index.columns:
        score = F.when((score == 0) & F.col("framework").isin(*alias), 20.0).otherwise(score)
    rows = index.join(candidates, "key", "left_semi").withColumn("score", score).where("score > 0")
    rows = rows.withColumn("score", F.col("score") - (F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))) * 0.5)
    return rows.orderBy(F.col("score").desc(), F.length("title"), "key").limit(limit).select("key", "title", "score")
