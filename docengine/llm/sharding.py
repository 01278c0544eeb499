"""Sharding by fixed virtual slots, in DataFrame operations only.

A record's id and text hash to one of thousands of slots, for good; where both repeat, so does the number of the copy, in
blocks of fixed size, so that no number of copies fills a slot. Bytes are summed by slot, and a versioned
table maps slots to shards. Rebalancing edits that map: slots stay where they are while their shard is
below its quota, and move as whole slots otherwise; records never change their slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_map, durable, fresh, mark_in_bit_map

#: Slots; a map has one row for each.
SLOTS = 8192
#: Copies of an id and text that share a slot.
COPIES = 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def virtual_slot(id_: Column, tie: Column, slots: int = SLOTS, block: Column | None = None) -> Column:
    """The slot of a record, from its id, the hash of its text and, for copies, their block: null and repeated ids are spread too."""
    first = F.xxhash64(id_, tie)
    return F.pmod(first if block is None else F.when(block == 0, first).otherwise(F.xxhash64(id_, tie, block)), F.lit(slots)).cast("int")


def with_slots(rows: DataFrame, id_col: str, tie_col: str, slots: int = SLOTS, copies: int = COPIES) -> DataFrame:
    """rows with __vslot. Ids and texts that repeat more than `copies` times are numbered, and each `copies` of them hash anew.

    Copies are numbered within the tasks that have them, and where a task begins comes from the tasks' counts, so that no
    task gets all copies of a text. Rows that don't repeat aren't shuffled; a fixed bit map tells them from the others.
    """
    id_, tie = F.col(id_col), F.col(tie_col)
    same = F.xxhash64(id_, tie)
    often = durable(rows.select(same.alias("same")).groupBy("same").count().where(F.col("count") > copies))
    if often.isEmpty():
        return rows.withColumn("__vslot", virtual_slot(id_, tie, slots))
    marked = mark_in_bit_map(rows.withColumn("__same", same), F.col("__same"), bit_map(often, F.col("same")), "__often")
    # written, so that all that is made of them sees the same numbers
    many = durable(marked.where("__often").drop("__often").withColumn("__task", F.spark_partition_id()))
    before = many.groupBy("__same", "__task").agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.partitionBy("__same").orderBy("__task")) - F.col("__n")).drop("__n")
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__same", "__task").orderBy("__same")) - 1
    numbered = many.join(before, ["__same", "__task"]).withColumn("__block", F.floor(number / copies))
    once = marked.where("NOT __often").withColumn("__vslot", virtual_slot(id_, tie, slots))
    return once.select(*rows.columns, "__vslot").unionByName(numbered.withColumn("__vslot", virtual_slot(id_, tie, slots, F.col("__block"))).select(*rows.columns, "__vslot"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, n) of every slot, empty ones too, from rows (vslot, size)."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").select(F.col("vslot").alias("slot"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def assign(sizes: DataFrame, shards: int, version: int, old: DataFrame | None = None, slack: float = 0.01) -> DataFrame:
    """The slot map of a version: rows (version, slot, shard, bytes, n).

    Slots in falling order of bytes stay with their old shard while it has room (its even share and
    `slack` of that more), else go to the shard with the fewest bytes so far. Without an old map all
    slots are dealt that way. The map has a fixed number of rows, and is made in one task.
    """
    s = sizes.withColumn("old", F.lit(-1)) if old is None else sizes.join(old.select("slot", F.col("shard").alias("old")), "slot", "left").fillna(-1, ["old"])
    quota = F.sum("bytes").over(Window.partitionBy()) * F.lit((1 + slack) / shards)
    one = s.withColumn("sum_quota", quota).groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "slot", "old", "n"))).alias("slots"), F.max("sum_quota").alias("quota"))
    step = f"""
        aggregate(slots,
          named_struct('load', array_repeat(cast(0 as bigint), {shards}), 'out', cast(array() as array<int>)),
          (a, x) -> element_at(transform(
            array(if(x.old >= 0 and x.old < {shards} and coalesce(get(a.load, x.old), 0) - x.neg <= quota, x.old, cast(array_position(a.load, array_min(a.load)) - 1 as int))),
            t -> named_struct('load', transform(a.load, (b, i) -> if(i = t, b - x.neg, b)), 'out', array_append(a.out, t))), 1),
          a -> a.out)
    """
    made = one.select(F.explode(F.arrays_zip("slots", F.expr(step).alias("shard"))).alias("x"))
    return made.select(F.lit(version).alias("version"), F.col("x.slots.slot").alias("slot"), F.col("x.shard").alias("shard"), (-F.col("x.slots.neg")).alias("bytes"), F.col("x.slots.n").alias("n"))


def store(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the stored maps; a version that is there already is replaced."""
    slot_map.coalesce(1).write.mode("overwrite").partitionBy("version").option("partitionOverwriteMode", "dynamic").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the last by default."""
    maps = spark.read.parquet(path)
    return maps.where(F.col("version") == (F.lit(version) if version is not None else maps.agg(F.max("version")).first()[0]))


def shard(docs: DataFrame, shards: int, slot_map: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """docs with the columns size, vslot, shard and place (the row's number in its shard, from 0).

    Without a slot map, one is made from the rows' sizes. Null texts have size 1. Null ids are ids like others; copies of
    an id and a text share a slot 16 at a time, in any order. size and tie (a hash of the text) are computed from the
    text where they aren't given; with both, rows without their texts can be sharded. Very long texts count with all their bytes.
    The columns get underscores in front where docs has such names. Empty input: empty result. Rows are
    numbered within slots; where a slot begins in its shard comes from the map.
    """
    names = fresh(docs.columns, "size", "vslot", "shard", "place")
    tie = F.xxhash64(text_col) if tie is None else tie
    rows = with_slots(docs.withColumns({"__size": size_of(F.col(text_col)) if size is None else size, "__tie": tie}), id_col, "__tie", slots)
    sizes = slot_sizes(rows.select(F.col("__vslot").alias("vslot"), F.col("__size").alias("size")), slots)
    slot_map = durable(assign(sizes, shards, 1)) if slot_map is None else slot_map.drop("bytes", "n").join(sizes, "slot")
    begin = F.sum("n").over(Window.partitionBy("shard").orderBy("slot")) - F.col("n")
    at = slot_map.select(F.col("slot").alias("__vslot"), F.col("shard").alias("__shard"), begin.alias("__begin"))
    place = F.col("__begin") + F.row_number().over(Window.partitionBy("__vslot").orderBy(F.col(id_col), "__tie")) - 1
    out = rows.join(F.broadcast(at), "__vslot").withColumn("__place", place)
    return out.select(*docs.columns, *[F.col(f"__{k}").alias(n) for k, n in zip(("size", "vslot", "shard", "place"), names, strict=True)])


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard") -> None:
    """Writes each shard as a folder of its own; slots of a shard may be written by several tasks."""
    sharded.write.mode("overwrite").partitionBy(shard_col).parquet(path)
