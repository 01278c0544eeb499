"""Vector search: sign codes for a shortlist, 8-bit codes to score it, the best chunk for each document."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, dot_i8, hamming, quantize_i8, sign_code
from ..session import shared_dir

SHORTLIST, TOP = 200, 50


def build_chunk_index(chunks: DataFrame, dims: int = 64) -> DataFrame:
    """(chunk_id, document_id, ord, code, codes, scale) from chunks with a vector; those of another width are left out."""
    ok = chunks.where(F.size("vector") == dims)
    return ok.select("chunk_id", "document_id", "ord", sign_code(F.col("vector"), dims).alias("code"), quantize_i8(F.col("vector")).alias("q")).select("chunk_id", "document_id", "ord", "code", "q.codes", "q.scale")


def _code(query: Sequence[float]) -> list[int]:
    words = [sum(1 << i for i, x in enumerate(query[a : a + 64]) if x >= 0) for a in range(0, len(query), 64)]
    return [w - (1 << 64) if w >= 1 << 63 else w for w in words]


def _longs(values: Sequence[int]) -> F.Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def shortlist(index: DataFrame, query: Sequence[float], n: int = SHORTLIST) -> DataFrame:
    """The n chunks of the smallest Hamming distance; ties by chunk. n is held between 16 and 5000."""
    rows = index.withColumn("distance", hamming(F.col("code"), _longs(_code(query))))
    return rows.orderBy("distance", "chunk_id").limit(min(max(n, 16), 5000))


#: Bits of a sub-code, and of its leading half, by which the table of sub-codes is laid out in folders.
SUB, HIGH = 16, 8
#: Radii that a search tries in turn.
RADII = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16)


def _sub(code: F.Column, part: int, bits: int = SUB) -> F.Column:
    """A part of a code, the lowest bits first."""
    per = 64 // bits
    return F.shiftright(F.get(code, F.lit(part // per)), bits * (part % per)).bitwiseAND((1 << bits) - 1)


def store_subcodes(index: DataFrame, dims: int = 64) -> DataFrame:
    """The index as a table with a row for each 16-bit part of a code (part, high, sub), in folders by part and leading half of the sub-code.

    Files are cut by chunk too, so that no folder is one task's. A code has dims / 16 rows.
    """
    parts = -(-dims // SUB)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), _sub(F.col("code"), p).cast("int").alias("sub")) for p in range(parts)])).alias("p")
    rows = index.select("*", each).select(*index.columns, "p.part", F.shiftright("p.sub", SUB - HIGH).alias("high"), "p.sub")
    rows = rows.repartitionByRange("part", "high", "chunk_id").sortWithinPartitions("part", "high", "sub")
    path = f"{shared_dir(index.sparkSession)}/codes-{uuid.uuid4().hex}"
    rows.write.partitionBy("part", "high").parquet(path)
    return index.sparkSession.read.schema(rows.schema).parquet(path)


def within(table: DataFrame, query: Sequence[float], radius: int) -> DataFrame:
    """The codes of which some part is within the radius of the query's part: all those nearer than (radius + 1) times the number of parts.

    Only folders whose half of a sub-code is within the radius are read. A code that several parts find comes from the first of them.
    """
    code = _code(query)
    subs = [(code[p * SUB // 64] >> (SUB * (p % (64 // SUB)))) & ((1 << SUB) - 1) for p in range(-(-len(query) // SUB))]
    far = lambda p: F.bit_count(_sub(F.col("code"), p).bitwiseXOR(F.lit(subs[p]).cast("long")))
    tests = []
    for p, sub in enumerate(subs):
        folders = [h for h in range(1 << HIGH) if (h ^ (sub >> (SUB - HIGH))).bit_count() <= radius]
        test = (F.col("part") == p) & F.col("high").isin(*folders) & (F.bit_count(F.col("sub").bitwiseXOR(F.lit(sub))) <= radius)
        for q in range(p):
            test = test & (far(q) > radius)
        tests.append(test)
    return table.where(reduce(lambda a, b: a | b, tests)).withColumn("distance", hamming(F.col("code"), _longs(code))).drop("part", "high", "sub")


def nearest(table: DataFrame, query: Sequence[float], n: int = SHORTLIST) -> DataFrame:
    """The same as `shortlist`, from the table of sub-codes: exact, and in rounds of growing radius that read only what can be near.

    Codes within distance d have a part within d / parts; so once the n-th distance is below (radius + 1) times the parts, no code that
    has not been read can come before it.
    """
    n = min(max(n, 16), 5000)
    parts = -(-len(query) // SUB)
    for radius in RADII:
        rows = within(table, query, radius).orderBy("distance", "chunk_id").limit(n)
        found, last = rows.agg(F.count("*"), F.max("distance")).first()
        if (found == n and last < (radius + 1) * parts) or radius >= SUB:
            return rows
    raise AssertionError("the last radius finds all")


def rescore(rows: DataFrame, query: Sequence[float]) -> DataFrame:
    return rows.withColumn("score", dot_i8(F.array(*[F.lit(float(x)) for x in query]), F.col("codes"), F.col("scale")))


def max_pool(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The best chunk of each document; of equal ones the nearest, then the first."""
    best = rows.groupBy("document_id").agg(F.max(F.struct("score", (-F.col("distance")).alias("near"), (-F.col("chunk_id")).alias("first"), "code")).alias("b"))
    out = best.select("document_id", F.col("b.score").alias("score"), (-F.col("b.near")).alias("distance"), (-F.col("b.first")).alias("chunk_id"), F.col("b.code").alias("code"))
    return out.orderBy(F.col("score").desc(), "document_id").limit(top)


def search(index: DataFrame, query: Sequence[float], n: int = SHORTLIST, top: int = TOP) -> DataFrame:
    return max_pool(rescore(shortlist(index, query, n), query), top)


def search_whole(codes: DataFrame, query: Sequence[float], top: int = TOP) -> DataFrame:
    """Whole-document codes (document_id, code): score 1 - distance / bits."""
    rows = codes.withColumn("distance", hamming(F.col("code"), _longs(_code(query))))
    return rows.withColumn("score", 1 - F.col("distance") / (64 * F.size("code"))).orderBy("distance", "document_id").limit(top)


def exact_cosine(chunks: DataFrame, query: Sequence[float], top: int = TOP) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col("vector")
    return chunks.withColumn("cosine", dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))).orderBy(F.col("cosine").desc(), "chunk_id").limit(top)


def usable(meta: dict[str, object], dims: int, version: str) -> bool:
    """Whether an index may be searched: the same width and version; else a search stays lexical."""
    return meta.get("dims") == dims and meta.get("version") == version
