"""The best k of a search from the few blocks of postings that can hold them.

A block has documents of like length, and is the same for all terms: those whose ids fall into one bucket (`store_blocks`, from
postings), or those that are read together (`store`, from documents). It keeps the highest score
that its term can bring to any of them. A document's score is no higher than what its block's terms add up to; so once k documents
are known, blocks that can't reach the last of them aren't read. The result equals the one from all postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable, ship
from .search import K1, Query, any_of, combine, counted, listed_tokens, observed, share, tests_of, token_pieces

#: Documents in a block, about.
BLOCK = 128
#: Blocks that the first round reads.
FIRST = 64
#: Half of a rounded score's last digit, and what sums of doubles may differ by.
SLACK = 6e-7

#: Places of blocks are written as differences, as those of postings.
PLACED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#places.list.element.list.element": "false"}


@dataclass
class Best:
    """The rows (id, score), best first; how many blocks the query has, and how many of them could hold such rows."""

    rows: DataFrame
    blocks: int
    read: int


def _class_of(length: Column) -> Column:
    """Four classes for each doubling of the length."""
    return F.floor(4 * F.log2(length.cast("double") + 1)).cast("long")


def store(docs: DataFrame, fields: dict[str, float], size: int = BLOCK) -> tuple[DataFrame, tuple[int, float]]:
    """Blocks (term, block, n, bound, ids, tfs, lengths, places) of documents' terms as a table sorted by term and block; and (n, mean length).

    Blocks are made where documents are read: those of a piece are put in order of length and cut. So there is one shuffle, of
    blocks and not of postings, and the table serves in the place of one of postings, too (`postings`).
    """
    ship(docs.sparkSession)
    weights = np.array([float(w) for w in fields.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch, lengths in token_pieces(batches, len(weights)):
            order = np.argsort(sum(lengths), kind="stable")
            batch, lengths = batch.take(pa.array(order)), [n[order] for n in lengths]
            length = sum(lengths)
            terms, code, row, tf, places = counted(batch, lengths, weights)
            # a block's number: the class of its shortest length, the task, a number in the task
            numbers = np.floor(4 * np.log2(length[::size] + 1.0)).astype(np.int64) << 48 | part << 26 | made + np.arange(-(-len(length) // size))
            made += len(numbers)
            block = row // size
            begin = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])]))
            cut = np.append(begin, len(code))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), x) for x in (batch.column(0).take(pa.array(row)), pa.array(tf), pa.array(length[row]), places)]
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(code[begin])), pa.array(numbers[block[begin]]), pa.array(np.diff(cut)), *lists], names=["term", "block", "n", "ids", "tfs", "lengths", "places"])

    listed, told = observed(listed_tokens(docs, fields), fields)
    kind = listed.schema["id"].dataType.simpleString()
    rows = durable(listed.mapInArrow(run, f"term string, block long, n long, ids array<{kind}>, tfs array<double>, lengths array<bigint>, places array<array<bigint>>"), **PLACED)
    stats = told.get["n"], told.get["mean"] or 1.0
    bound = F.array_max(F.zip_with("tfs", "lengths", lambda tf, length: share(tf, length, stats[1])))
    cut = rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    table = durable(cut.select("term", "block", "n", bound.alias("bound"), "ids", "tfs", "lengths", "places"), **PLACED)
    discard(rows)
    return table, stats


def postings(blocks: DataFrame) -> DataFrame:
    """The postings (term, id, tf, length, places) of blocks with places; blocks of other terms and columns that aren't used aren't read."""
    rows = blocks.select("*", F.posexplode("ids").alias("_at", "id"))
    at = lambda c: F.get(c, F.col("_at"))
    return rows.select("term", "id", at("tfs").alias("tf"), at("lengths").alias("length"), at("places").alias("places"))


def store_blocks(postings: DataFrame, stats: tuple[int, float], size: int = BLOCK) -> DataFrame:
    """Blocks (term, block, n, bound, ids, tfs, lengths) of an index of terms, as a table sorted by term and block.

    A bucket is a hash of the id. How many a class of lengths has comes from an estimate of its documents: an estimate that is off
    makes blocks larger or smaller, and loses nothing. The driver gathers one number for each class (252 at most).
    """
    classes = postings.select("id", _class_of(F.col("length")).alias("c")).groupBy("c").agg(F.approx_count_distinct("id").alias("n")).collect()
    if not classes:
        buckets = F.lit(1).cast("long")
    else:
        buckets = F.create_map(*[F.lit(x).cast("long") for r in classes for x in (r["c"], -(-max(r["n"], 1) // size))])[_class_of(F.col("length"))]
    block = F.shiftleft(_class_of(F.col("length")), 48) + F.pmod(F.xxhash64("id"), buckets)
    one = F.struct(F.col("id").alias("id"), F.col("tf").alias("tf"), F.col("length").alias("length"))
    rows = postings.select("term", block.alias("block"), share(F.col("tf"), F.col("length"), stats[1]).alias("s"), one.alias("p"))
    rows = rows.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("s").alias("bound"), F.sort_array(F.collect_list("p")).alias("p"))
    rows = rows.select("term", "block", "n", "bound", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"))
    return durable(rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block"))


def _groups(blocks: DataFrame, query: Query) -> DataFrame:
    """The blocks of a query's terms, each with the number g of the group it is of."""
    tests = [tests_of(group) for group in query.groups]
    rows = blocks.where(any_of([x for t in tests for x in t]))
    return rows.withColumn("g", F.explode(F.array_compact(F.array(*[F.when(any_of(t), F.lit(g)) for g, t in enumerate(tests)]))))


def _may(query: Query) -> Column:
    """Whether a block that has some of the groups may have a document that fits."""

    def holds(tree: int | tuple) -> Column:
        if isinstance(tree, int):
            return F.array_contains("groups", tree)
        kind, left, right = tree
        return holds(left) if kind == "NOT" else holds(left) & holds(right) if kind == "AND" else holds(left) | holds(right)

    if query.tree is not None:
        return holds(query.tree)
    return F.size("groups") >= (1 if query.any else len(query.groups))


def best(blocks: DataFrame, stats: tuple[int, float], query: Query, k: int, among: DataFrame | None = None) -> Best:
    """The k best documents as `match` scores them, by score and id; `among` are the ids (id) that count, all without it.

    Two rounds as a rule: the blocks of the highest bounds give k documents, whose last score says which others can matter. A round
    that gives less than k is followed by one of eight times as many blocks. What isn't scored are documents of blocks that aren't
    read. Queries with phrases, NEAR or named fields need places, which blocks don't have: ValueError.
    """
    if any(g.placed for g in query.groups):
        raise ValueError("places aren't in blocks")
    nothing = blocks.select(F.explode("ids").alias("id"), F.lit(0.0).alias("score")).limit(0)
    if not query.groups or k < 1:
        return Best(nothing, 0, 0)
    n, mean = stats
    own = _groups(blocks, query)
    single = {g for g, group in enumerate(query.groups) if not group.prefixes and len(group.exact) == 1}
    # documents of several terms of a group are counted once: their ids are together, as blocks are the same for all terms
    ids = F.when(~F.col("g").isin(*single), F.col("ids")) if single else F.col("ids")
    heads = own.select("g", "block", "n", "bound", ids.alias("ids")).groupBy("g", "block").agg(
        F.when(F.first("g").isin(*single) if single else F.lit(False), F.sum("n")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("ids"))))).alias("n"),
        F.least(F.sum("bound"), F.lit(K1 + 1)).alias("bound"),
    )
    heads = durable(heads)
    df = {r["g"]: r["n"] for r in heads.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    most = heads.groupBy("block").agg(F.sum(_idf(n, df) * F.col("bound")).alias("most"), F.collect_set("g").alias("groups")).where(_may(query)).select("block", "most")
    tops = durable(most)
    discard(heads)
    count, size, floor = tops.count(), max(FIRST, k // 16), None
    while floor is None:
        limit = tops.orderBy(F.col("most").desc(), "block").limit(size).agg(F.min("most")).first()[0] if size < count else None
        found = _scored(own, tops if limit is None else tops.where(F.col("most") >= limit), stats, query, df, among)
        if limit is None:
            return Best(found.orderBy(F.col("score").desc(), "id").limit(k), count, count)
        held = found.orderBy(F.col("score").desc(), "id").limit(k).agg(F.count("*").alias("n"), F.min("score").alias("last")).first()
        floor = held["last"] if held["n"] == k else None
        size *= 8
    chosen = tops.where(F.col("most") >= floor - SLACK)
    return Best(_scored(own, chosen, stats, query, df, among).orderBy(F.col("score").desc(), "id").limit(k), count, chosen.count())


def _idf(n: int, df: dict[int, int]) -> Column:
    """A group's weight, by its number."""
    if not df:
        return F.lit(0.0)
    of = F.create_map(*[x for g, c in df.items() for x in (F.lit(g), F.lit(c).cast("long"))])[F.col("g")]
    return F.greatest(F.log((F.lit(float(n)) - of + 0.5) / (of + 0.5)), F.lit(1e-6))


def _scored(own: DataFrame, chosen: DataFrame, stats: tuple[int, float], query: Query, df: dict[int, int], among: DataFrame | None) -> DataFrame:
    """(id, score) of the documents of the chosen blocks that fit."""
    edge = chosen.agg(F.min("block"), F.max("block")).first()
    if edge[0] is not None:  # blocks of the highest bounds have documents of like lengths: the others' pages are skipped
        own = own.where(F.col("block").between(edge[0], edge[1]))
    rows = own.join(chosen.select("block"), "block", "left_semi").select("g", F.inline(F.arrays_zip("ids", "tfs", "lengths")))
    per = rows.groupBy("g", F.col("ids").alias("id"), F.col("lengths").alias("length")).agg(F.sum("tfs").alias("tf"))
    if among is not None:
        per = per.join(among.select("id").distinct(), "id", "left_semi")
    return combine(per.withColumn("idf", _idf(stats[0], df)), stats[1], query)
