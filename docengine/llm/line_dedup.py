"""Line deduplication with two Bloom filters, for hashes seen in one document and in two.

Filters are dealt by hash range: each task sends the 8-byte hashes of its documents' lines, each at most twice for
some million of them, to the task of their range, which sets them in a filter, and those already set there in a second one.
Only lines in the second filter, the suspected repeats, are shuffled for exact confirmation: as digests, with counts
combined first, to tell how many documents have them and where each comes first. Lines that two
documents share are never missed; a false hit of the filter only costs a digest.

The second filter is broadcast up to a fixed size. Beyond that it stays dealt out, and the lines' digests, combined
in each task, go to its ranges to be looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BITS, SPACE, durable, fresh, mark_in_bit_map, release, ship

#: Repeated lines up to this number are sent to every task (32 bytes each and overhead); more are joined.
BROADCAST_LINES = 400_000
#: Bits of the second filter up to which it is broadcast (128 MB).
BROADCAST_BITS = 1 << 30
#: Bits of a range's filters at least, and ranges at most (larger filters have larger ranges).
RANGE_BITS, RANGES = 1 << 22, 1 << 15
#: Hashes that a task combines at a time.
HASHES = 1 << 20
_WORDS = CHUNK_BITS // 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def lines_of(text: Column) -> Column:
    """Lines of the whole text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What makes lines equal: no white space at the ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


def filter_bits(docs: DataFrame) -> int:
    """Bits of the filters in all: some 16 for each line that the input's size suggests, 2^23 at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << max(23, (size // 4).bit_length())


def put(target: np.ndarray, at: np.ndarray) -> None:
    """Sets bits (sorted positions) in a filter of 64-bit words."""
    if len(at):
        word, first = np.unique(at >> 6, return_index=True)
        target[word] |= np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)


def seen_twice(hashes: DataFrame, bits: int) -> DataFrame:
    """The second filter, as rows (chunk, bitmap), from rows of arrays of distinct 64-bit hashes."""
    span = max(RANGE_BITS, bits // RANGES)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held) & np.int64(bits - 1), return_counts=True)
            held.clear()
            range_ = at // span
            begin = np.flatnonzero(np.r_[True, range_[1:] != range_[:-1]])
            rows = [(int(range_[a]), at[a:b].tobytes(), np.packbits(n[a:b] > 1).tobytes()) for a, b in zip(begin, [*begin[1:], len(at)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["range", "at", "twice"])

        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(flat):
                held.append(flat)
            if sum(map(len, held)) >= HASHES:
                yield out()
        if held:
            yield out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range; one range's filters are held at a time."""
        range_, once, twice = None, np.zeros(span // 64, np.uint64), np.zeros(span // 64, np.uint64)

        def out() -> pa.RecordBatch:
            used = np.flatnonzero(twice.reshape(-1, _WORDS).any(1))
            maps = [twice[k * _WORDS : (k + 1) * _WORDS].tobytes() for k in used]
            return pa.RecordBatch.from_arrays([pa.array(used + range_ * (span // CHUNK_BITS), pa.int64()), pa.array(maps, pa.binary())], names=["chunk", "bitmap"])

        for batch in batches:
            for r, at, two in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if r != range_:
                    if range_ is not None:
                        yield out()
                    range_ = r
                    once[:] = 0
                    twice[:] = 0
                at = np.frombuffer(at, np.int64) - r * span
                two = np.unpackbits(np.frombuffer(two, np.uint8), count=len(at)).astype(bool)
                was = (once[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                put(twice, at[was | two])
                put(once, at)
        if range_ is not None:
            yield out()

    parts = hashes.mapInArrow(local, "range long, at binary, twice binary")
    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(merged, "chunk long, bitmap binary")


def repeated_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 2, min_chars: int = 1, bits: int | None = None, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """Rows (digest, n_docs, first_id, first_tie) of the line keys in min_docs (2 at least) documents or more.

    Each row of docs is a document. The first one that has a line is that of the smallest id (null ids
    first), then of the smallest hash of its text. Null and empty texts have no key. Texts are split whole. Empty input: no rows.
    """
    ship(docs.sparkSession)
    bits = bits or filter_bits(docs)
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.length(k) >= min_chars))
    hashes = docs.select(F.transform(keys, lambda k: F.xxhash64(k)).alias("hashes"))
    twice = durable(seen_twice(hashes, bits))
    each = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.explode(keys).alias("key"))
    first, digest = F.min(F.struct("id", "tie")).alias("first"), F.unhex(F.sha2("key", 256)).alias("digest")
    if bits <= broadcast_bits:
        suspects = mark_in_bit_map(each, F.xxhash64("key"), twice, "_twice", bits).where("_twice")
        found = suspects.groupBy(digest).agg(F.count("*").alias("n_docs"), first)
    else:
        counted = each.groupBy(digest, F.xxhash64("key").alias("hash")).agg(F.count("*").alias("n_docs"), first)
        found = mark_in_bit_map(counted, F.col("hash"), twice, "_twice", bits, spread=True).where("_twice")
    return found.where(F.col("n_docs") >= min_docs).select("digest", "n_docs", F.col("first.id").alias("first_id"), F.col("first.tie").alias("first_tie"))


def dedup_lines(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 2, min_chars: int = 1, keep_first: bool = False, bits: int | None = None, broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """docs with repeated lines taken out of their texts, and the columns n_lines (before) and n_dropped.

    A line whose key has min_chars code points or more and is in min_docs documents or more goes from
    all of them; with keep_first, its first occurrence stays. Other lines stay as they are, in order,
    joined by line ends. Null texts are empty. The two columns get underscores in front where docs has
    such names. Rows that repeat an id and text are documents of their own, and with keep_first all of
    them keep the line. Texts are split whole, however long. Empty input: empty result.
    """
    repeated = durable(repeated_lines(docs, text_col, id_col, min_docs, min_chars, bits))
    n_lines, n_dropped, tie, own, id2, tie2 = fresh(docs.columns, "n_lines", "n_dropped", "_tie", "_own", "_id2", "_tie2")
    rows = docs.withColumn(tie, F.xxhash64(text_col)) if keep_first else docs
    few = repeated.limit(broadcast_lines + 1).count() <= broadcast_lines
    if few:
        found = repeated.select("digest", *(("first_id", "first_tie") if keep_first else ()))
        known = rows.sparkSession.sparkContext.broadcast({bytes(r[0]): tuple(r[1:]) for r in found.toLocalIterator()})
    else:
        # the digests of each document's own repeated lines, joined to it by id and hash of its text
        keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.length(k) >= min_chars))
        each = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.explode(keys).alias("key")).select("id", "tie", F.unhex(F.sha2("key", 256)).alias("digest"))
        owned = each.join(repeated, "digest").groupBy(F.col("id").alias(id2), F.col("tie").alias(tie2)).agg(F.collect_set(F.struct("digest", "first_id", "first_tie")).alias(own))
        rows = docs.withColumn(tie, F.xxhash64(text_col))
        rows = rows.join(owned, F.col(id_col).eqNullSafe(F.col(id2)) & (F.col(tie) == F.col(tie2)), "left").drop(id2, tie2)
        known = None
    space, at, id_at = SPACE.encode(), rows.columns.index(text_col), rows.columns.index(id_col)
    tie_at = rows.columns.index(tie) if tie in rows.columns else None
    kept = [i for i, c in enumerate(rows.columns) if c in docs.columns]
    schema = T.StructType([*[f if f.name != text_col else T.StructField(text_col, T.StringType()) for f in docs.schema.fields], T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    own_at = rows.columns.index(own) if known is None else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = known.value if known is not None else {}
        for batch in batches:
            texts, lines, gone = [], [], []
            ids = batch.column(id_at).to_pylist() if keep_first else None
            ties = batch.column(tie_at).to_pylist() if keep_first else None
            owns = batch.column(own_at).to_pylist() if own_at is not None else None
            for i, text in enumerate(batch.column(at).cast(pa.large_binary()).to_pylist()):
                parts = (text or b"").split(b"\n")
                table = everywhere if owns is None else {x["digest"]: (x["first_id"], x["first_tie"]) for x in owns[i] or ()}
                stays, seen = [], set()
                for part in parts if table else ():
                    key = part.strip(space).translate(_LOWERED)
                    first = None
                    # continuation bytes don't count as code points
                    if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        first = table.get(digest := hashlib.sha256(key).digest())
                    if first is not None and keep_first and (ids[i], ties[i]) == first and digest not in seen:
                        seen.add(digest)
                        first = None
                    if first is None:
                        stays.append(part)
                if not table:
                    stays = parts
                texts.append(b"\n".join(stays))
                lines.append(len(parts))
                gone.append(len(parts) - len(stays))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == at else batch.column(k) for k in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)
        release()

    return rows.mapInArrow(apply, schema)
