"""Exact deduplication by progressive refinement: by length, then by a prefix hash, then by a full hash.

Texts are equal if they are identical after each run of white space becomes one space. Lengths and prefix
hashes are counted over all rows, combined before each shuffle. Only (length, prefix) groups with several
members survive; a bit map of fixed size tells a second scan which rows may belong to one, and only
their texts are hashed in full. No text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, attach, bit_map, durable, fresh, mark_in_bit_map

#: Code points of the normalised text in the prefix hash.
PREFIX = 256
#: Bits of the map of surviving (length, prefix) groups: 8 MB.
MAP_BITS = 1 << 26


def normalised(text: Column) -> Column:
    """The text that is compared; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept and the carried columns.

    keep_id is the smallest id among the rows with an equal text, null ids left out (null if all are
    null). Kept are the rows whose id is keep_id; of rows that repeat it, or if all ids are null, exactly
    one. Null and empty texts equal each other. carry: columns by name, expressions over `_norm` (the
    normalised text), computed in the second scan and returned with each row. An empty input gives an
    empty result; other columns of docs play no part, whatever their names.
    """
    carried = [c.alias(k) for k, c in (carry or {}).items()]
    norm = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    keyed = norm.select("_id", "_norm", F.xxhash64(F.length("_norm"), F.xxhash64(F.substring("_norm", 1, PREFIX))).alias("_group"), F.length("_norm").alias("_len"))

    counts = keyed.groupBy("_len", "_group").count()
    lengths = counts.groupBy("_len").agg(F.sum("count").alias("n")).where("n > 1").select("_len")
    several = durable(counts.where("count > 1").join(lengths, "_len", "left_semi").select("_group"))

    marked = mark_in_bit_map(keyed, F.col("_group"), bit_map(several, F.col("_group"), MAP_BITS), "_maybe", MAP_BITS)
    # a false hit of the map only costs a hash; a row without one is alone with its text
    full = durable(marked.select("_id", *carried, F.when(F.col("_maybe"), F.unhex(F.sha2("_norm", 256))).alias("_sha"), F.monotonically_increasing_id().alias("_row")))
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = full.where("_sha is not null").groupBy("_sha").agg(first.alias("_first"), F.count("*").alias("_size"))
    names = [*(carry or {})]
    rest = [F.col(k) for k in names]
    out = attach(full.where("_sha is not null"), groups, "_sha", "_size").select(
        F.col("_id").alias(id_col), F.col("_first.id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_row") == F.col("_first.row")).alias("kept"), *rest
    )
    alone = full.where("_sha is null").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *rest)
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each text: the kept one of exact_groups. Of rows that repeat an id and text any one stays.

    Columns of docs may have any names. Empty input: empty result.
    """
    id_, tie, may, gone = fresh(docs.columns, "_id", "_tie", "_may", "_gone")
    found = exact_groups(docs, id_col, text_col, carry={"_t": F.xxhash64("_norm")})
    # of an id and text all rows go, or one stays
    state = found.groupBy(F.col(id_col).alias(id_), F.col("_t").alias(tie)).agg(F.first(~F.col(id_col).eqNullSafe(F.col("keep_id"))).alias(gone), F.count("*").alias("_n"))
    state = durable(state.where(F.col(gone) | (F.col("_n") > 1)).drop("_n"))
    # only rows that may go are shuffled with their texts
    rows = docs.withColumns({id_: F.col(id_col), tie: F.xxhash64(normalised(F.col(text_col)))})
    rows = mark_in_bit_map(rows, F.xxhash64(id_, tie), bit_map(state, F.xxhash64(id_, tie), MAP_BITS), may, MAP_BITS)
    unsure, there = rows.where(may), state.select(F.col(id_).alias(f"{id_}2"), F.col(tie).alias(f"{tie}2"), gone)
    unsure = unsure.join(there, F.col(id_).eqNullSafe(F.col(f"{id_}2")) & (F.col(tie) == F.col(f"{tie}2")), "left")
    alone = unsure.where(F.col(gone).isNull()).select(*docs.columns)
    one = unsure.where(~F.col(gone)).dropDuplicates([id_, tie]).select(*docs.columns)
    return rows.where(~F.col(may)).select(*docs.columns).unionByName(alone).unionByName(one)
