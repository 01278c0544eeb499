"""Quality rules by hashed n-gram log-likelihood ratios, in DataFrame operations only.

Words and pairs of words are hashed into a fixed number of buckets and counted over all documents (the raw
corpus) and over the trusted ones (the target). A document's score is the mean, over its n-grams, of the
log ratio of the two smoothed multinomials; every document is kept or not by a fixed threshold on it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, bit_map, durable, fresh, mark_in_bit_map

#: Buckets of hashed n-grams; the model is one number for each.
BUCKETS = 10_000
#: Mean log-likelihood ratio (natural log) that a document must reach.
THRESHOLD = -0.1
#: Pseudo-count of each bucket.
SMOOTH = 1.0
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Words of the whole text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES, -1))


def ngram_buckets(words_: str) -> str:
    """SQL for the buckets of all words and of all pairs of neighbours, of an array column."""
    return (
        f"concat(transform({words_}, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int)), "
        f"transform({words_}, (x, i) -> if(i = 0, -1, cast(pmod(xxhash64(get({words_}, i - 1), x), {BUCKETS}) as int))))"
    )


def bucket_counts(docs: DataFrame, weight: Column, text_col: str = "text") -> DataFrame:
    """(bucket, raw, target): n-grams over all rows, and over those with the weight 1."""
    w = docs.select(words(F.col(text_col)).alias("w"), weight.cast("long").alias("t")).where(F.size("w") > 0)
    each = w.select("t", F.explode(F.expr(ngram_buckets("w"))).alias("bucket")).where("bucket >= 0")
    return each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))


def log_ratios(counts: DataFrame) -> list[float]:
    """log(target / raw) of each bucket; 0 for all if the target is empty. The model: BUCKETS numbers, collected."""
    got = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}
    raw, target = (sum(x[i] for x in got.values()) + SMOOTH * BUCKETS for i in (0, 1))
    if not any(x[1] for x in got.values()):
        return [0.0] * BUCKETS
    return [math.log(((t + SMOOTH) / target) / ((n + SMOOTH) / raw)) for n, t in (got.get(b, (0, 0)) for b in range(BUCKETS))]


def base_counts(w: str = "w", text: str = "t") -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words over columns of words and text."""
    windows = f"if(size({w}) >= 5, transform(sequence(1, size({w}) - 4), i -> xxhash64(slice({w}, i, 5))), array())"
    sorted_ = "array_sort(transform(_h, (x, j) -> named_struct('h', x, 'i', j)))"
    # of the sorted windows, those equal to a neighbour; their places in order; five words each, overlaps once
    repeats = f"""
        case when size(array_distinct(_h)) = size(_h) then 0L else aggregate(
          array_sort(element_at(transform(array({sorted_}), s -> transform(filter(transform(s,
            (e, k) -> if(coalesce(get(s, k - 1).h = e.h, false) or coalesce(get(s, k + 1).h = e.h, false), e.i, -1)), i -> i >= 0), i -> i)), 1)),
          named_struct('p', -5, 'n', 0L), (a, i) -> named_struct('p', i, 'n', a.n + least(5, i - a.p)), a -> a.n) end"""
    return {
        "n_words": F.expr(f"cast(size({w}) as bigint)"),
        "word_chars": F.expr(f"cast(length(concat_ws('', {w})) as bigint)"),
        "n_symbols": F.expr(f"cast(regexp_count({text}, '[{SYMBOLS}]') as bigint)"),
        "n_dup_lines": F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)"),
        "n_repeat_words": F.expr(repeats),
        "_h": F.expr(windows),
        "_l": F.expr(f"filter(split({text}, '\\n', -1), l -> rlike(l, '[^\\\\x20\\\\x09-\\\\x0D]'))"),
    }


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    trusted: the ids of the target's documents, each once. n_words counts words; n_dup_lines lines with a word that equal
    an earlier one; n_repeat_words words in five-word windows found twice or more in the text. base_failed:
    fewer than min_words words, or more than most_repeated per cent of them repeated. score is the mean log
    ratio of the text's n-grams (0 for none); kept needs a score of threshold or more and no base_failed.
    Null texts have no words; null ids are never trusted; rows that repeat an id count each. Long texts are judged whole. The columns
    get underscores in front where docs has such names. Empty input: empty result.
    """
    new = fresh(docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    ids = trusted.toDF("__id").where("__id is not null").withColumn("__t", F.lit(1))
    # a map of fixed size is broadcast; only rows that it lets through are joined to the ids with their texts
    rows = mark_in_bit_map(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")), F.xxhash64(F.col("__id").cast("long")), bit_map(ids, F.xxhash64(F.col("__id").cast("long"))), "__may")
    sure = rows.where(~F.col("__may")).select("text", F.lit(0).alias("__t"))
    unsure = rows.where("__may").join(ids, "__id", "left").select("text", F.coalesce("__t", F.lit(0)).alias("__t"))
    model = log_ratios(bucket_counts(sure.unionByName(unsure), F.col("__t")))
    table = f"cast(split('{','.join(map(repr, model))}', ',') as array<double>)"

    numbered = [f"__{i}" for i in range(len(docs.columns))]
    text = F.coalesce(F.col(numbered[docs.columns.index(text_col)]), F.lit(""))
    counts = base_counts()
    out = docs.toDF(*numbered).withColumn("t", text).withColumn("w", words(F.col("t")))
    out = out.withColumns({k: counts[k] for k in ("_h", "_l")}).withColumns({k: counts[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")})
    out = out.withColumn("_g", F.expr(ngram_buckets("w")))
    total = F.expr(f"aggregate(_g, 0D, (s, b) -> if(b < 0, s, s + get({table}, b)))")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = out.withColumn("score", F.when(F.col("n_words") == 0, 0.0).otherwise(total / F.greatest(2 * F.col("n_words") - 1, F.lit(1)))).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(numbered, docs.columns, strict=True)],
        *[F.col(k).alias(n) for k, n in zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"), new, strict=True)],
    )
