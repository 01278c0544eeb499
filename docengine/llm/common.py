"""Shared building blocks: written tables, skew-safe lookups, bit maps, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import delete_folder, discard, durable, shared_dir

__all__ = ["attach", "bit_map", "components", "delete_folder", "discard", "durable", "fresh", "mark_in_bit_map", "release", "shared_dir", "ship", "table"]

#: The white space that the operators know: space and the characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
#: A run of white space, and a word, as regular expressions.
SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
#: Bits in one row of a bit map: what bitmap_construct_agg fills.
CHUNK_BITS = 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are long, and both sides of the pipe hold a batch.
BATCH_ROWS = 1000


def release() -> None:
    """Gives the memory that a Python worker has freed back to the system, at the end of a task: workers live on."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, and makes Arrow batches small where nobody has set their size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    session.ship(spark)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """names, with underscores put before those that are taken (names don't differ by case alone)."""
    have, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, hot: int = 1000, salts: int = 64) -> DataFrame:
    """Inner join of many rows to one row per group on `key`, safe when few groups hold most rows.

    The `hot` heaviest groups are broadcast (that many at most, whatever the input), and only tell how
    the rows of those groups are dealt over `salts` shuffle keys; any other group has at most 1/hot of
    all rows. The join itself is one shuffle join and exact.
    """
    salt, many = fresh([*rows.columns, *groups.columns], "_salt", "_many")
    top = groups.orderBy(F.col(weight).desc(), key).limit(hot).select(key, F.lit(salts).alias(many))
    dealt = (
        rows.join(F.broadcast(top), key, "left")
        .withColumn(salt, F.when(F.col(many).isNotNull(), F.floor(F.rand(7) * salts).cast("int")).otherwise(0))
        .drop(many)
    )
    copies = (
        groups.join(F.broadcast(top), key, "left")
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(many), F.lit(1)) - 1)))
        .drop(many)
    )
    return dealt.join(copies, [key, salt]).drop(salt)


def bit_map(keys: DataFrame, hashed: Column, bits: int = 1 << 26) -> DataFrame:
    """A bit map of the 64-bit hashes: rows (chunk, bitmap), bits / 8 bytes in all, whatever the input."""
    at = F.pmod(hashed, F.lit(bits))
    return (
        keys.select(F.floor(at / CHUNK_BITS).cast("long").alias("chunk"), F.pmod(at, F.lit(CHUNK_BITS)).cast("long").alias("bit"))
        .groupBy("chunk")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def mark_in_bit_map(df: DataFrame, hashed: Column, bitmap: DataFrame, name: str, bits: int = 1 << 26, spread: bool = False) -> DataFrame:
    """df with a boolean column: whether the hash may be in the bit map; true for all that are in it.

    The map is broadcast: it has bits / 8 bytes at most. With `spread`, df is shuffled to the map's chunks instead.
    """
    at, chunk, map_ = fresh(df.columns, "_at", "_chunk", "_bitmap")
    byte = f"cast(conv(hex(substring({map_}, cast(floor(pmod({at}, {CHUNK_BITS}) / 8) as int) + 1, 1)), 16, 10) as int)"
    return (
        df.withColumn(at, F.pmod(hashed, F.lit(bits)))
        .withColumn(chunk, F.floor(F.col(at) / CHUNK_BITS).cast("long"))
        .join(bitmap.toDF(chunk, map_) if spread else F.broadcast(bitmap.toDF(chunk, map_)), chunk, "left")
        .withColumn(name, F.expr(f"coalesce((shiftright({byte}, cast(pmod({at}, 8) as int)) & 1) = 1, false)"))
        .drop(at, chunk, map_)
    )


#: Edges that a task joins at a time.
EDGES = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: each vertex that isn't the smallest of its component, and that smallest one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(ids)))
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i < j:
            up[j] = i
        else:
            up[i] = j
    root = np.array(up, np.int64)
    while not np.array_equal(root, root[root]):
        root = root[root]
    below = np.flatnonzero(root != np.arange(len(root)))
    return ids[below], ids[root[below]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (id, root) of all vertices but the smallest of each component, their root.

    Each task makes stars of its edges. These are dealt by vertex and made stars again, until each vertex has one
    smaller vertex that it points to (a vertex never brings more edges than tasks had it); then pointers are
    followed, twice as far in each round. Each round is one table in the shared folder.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        before = None  # the vertex of the last edge made a star

        def out() -> pa.RecordBatch:
            nonlocal before
            a, b = (np.concatenate([h.column(k).to_numpy(zero_copy_only=False) for h in held]) for k in (0, 1))
            pairs = np.unique(np.stack([a, b], 1), axis=0)
            vertex, root = contract(pairs[:, 0], pairs[:, 1])
            several = pairs[0, 0] == before or bool((np.diff(pairs[:, 0]) == 0).any())
            before = pairs[-1, 0]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(vertex, pa.int64()), pa.array(root, pa.int64()), pa.array(np.full(len(vertex), several))], names=["a", "b", "several"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(h.num_rows for h in held) >= EDGES:
                yield out()
        if held:
            yield out()

    schema, written = "a long, b long, several boolean", None
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(stars, schema)

    def go_on(df: DataFrame, flag: str) -> bool:
        """Writes df in the place of the table before it; tells whether the flag is set anywhere."""
        nonlocal e, written
        told = Observation()
        e = durable(df.observe(told, F.max(flag).alias("any")))
        if written is not None:
            discard(written)
        written = e
        return bool(told.get["any"])

    while go_on(e.select("a", "b").repartition("a").sortWithinPartitions("a", "b").mapInArrow(stars, schema), "several"):
        pass
    above = lambda: e.select(F.col("a").alias("b"), F.col("b").alias("above"))
    while go_on(e.join(above(), "b", "left").select("a", F.coalesce("above", "b").alias("b"), F.col("above").isNotNull().alias("moved")), "moved"):
        pass
    return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
