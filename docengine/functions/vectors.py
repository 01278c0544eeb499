"""Vectors: sign codes, 8-bit codes, distances, pooling. All in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_code(vector: Column, dims: int = 64) -> Column:
    """The signs of a vector as 64-bit words, the first dimension lowest: bit 1 for 0 or more."""
    words = [
        F.aggregate(
            F.transform(F.sequence(F.lit(64 * w), F.lit(min(dims, 64 * w + 64) - 1)), lambda i: F.when(F.get(vector, i) >= 0, i % 64).otherwise(-1)),
            F.lit(0).cast("long"),
            lambda acc, i: F.when(i >= 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(acc),
        )
        for w in range((dims + 63) // 64)
    ]
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / (F.size(a) * 64)


def quantize_i8(vector: Column) -> Column:
    """(codes, scale): scale is the largest magnitude / 127 (1 for a zero vector), codes are rounded half away from zero."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    codes = F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int"))))
    return F.struct(codes.alias("codes"), scale.alias("scale"))


def dot_i8(query: Column, codes: Column, scale: Column) -> Column:
    """scale times the dot product, in double precision."""
    return scale * F.aggregate(F.zip_with(query, codes, lambda q, c: q.cast("double") * c), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(vector: Column) -> Column:
    """Zero vectors stay as they are."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def truncate(vector: Column, dims: int) -> Column:
    """The first dimensions, normalised anew."""
    return l2_normalize(F.slice(vector, 1, dims))


def mean_pool(vectors: Column, mask: Column, dims: int) -> Column:
    """Mean of the masked rows of a list of vectors; zeros if none is."""
    used = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m.cast("int") > 0, v)), lambda v: v.isNotNull())
    total = F.aggregate(used, F.array_repeat(F.lit(0.0), dims), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(used), F.lit(1)))


def last_token_pool(vectors: Column, mask: Column) -> Column:
    """The last row that the mask has; the first one if it has none."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m.cast("int") > 0, i)))
    return F.get(vectors, F.coalesce(last, F.lit(0)))
