"""Self-join of documents on the Jaccard similarity of their word n-grams, by chosen paths.

Equal texts are brought down to one first. A text is a set of hashed n-grams, embedded as a vector of
minhashes, so that two sets agree in each position with a probability of their similarity (Christiani, Pagh
and Sivertsen's CPSJoin). A run samples positions at the root; sets that share the minhash there go down the
same path into a bucket. Buckets of few sets are brute-forced. In a larger one, a leader links all sets that
may be near it to itself, so that they are one part; then the bucket is split again on positions sampled by the
path. Sets of one part needn't meet again, so that buckets with one part alone are done: a group of near copies, however
large, costs a comparison with its leader for each set. As many runs are made as the target recall needs.

What buckets give are links between minhash vectors that may be near; only as many as connect them are
kept, never all pairs. Sets that these links connect are compared exactly, all with all, in blocks of bounded
size; each n-gram set goes to one block. Where sets have several blocks, candidate links between them are checked
exactly, the strongest of each set first, and the rest as far as their ends are still apart. Only sets that are then
still apart from the largest part of theirs, which are few where many are near each other, meet all its blocks.

The result is the join in the form of pairs of representatives and membership: a representative stands for the
rows of one text; pairs are exact links that connect all linked texts of a class as a tree. Every link is counted with the rows it stands for:
blocks of a class all meet for it. A link is only lost if no run finds it and no other links connect its ends.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bit_map, components, discard, durable, fresh, mark_in_bit_map, release, ship

#: Positions of the minhash vector (a byte each: other minhashes agree in one of 256), and those that each node of a path samples.
LANES, SAMPLED = 256, 2
#: Sets in a bucket that is brute-forced, and levels of splitting.
BUCKET, LEVELS = 2048, 4
#: Sets in a block of the exact comparison, and n-grams in it.
BLOCK, BLOCK_GRAMS = 2048, 1 << 21
#: N-grams that fewer sets of a block have are counted pair by pair, others by products of matrices.
THIN = 64
#: Similarity, as a fraction, that a link needs.
NUMERATOR, DENOMINATOR = 4, 5
#: Agreeing positions that make a set a candidate: five standard deviations below 0.8 of them.
CANDIDATE = int(LANES * 0.8 - 5 * math.sqrt(LANES * 0.8 * 0.2))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(0, 1 << 31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, LANES, dtype=np.uint32)
_BASE, _BASE_INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def runs_for(recall: float, similarity: float = NUMERATOR / DENOMINATOR, levels: int = LEVELS) -> int:
    """Runs that find a pair of the similarity with the probability: a run keeps it through all levels."""
    each = (1 - (1 - similarity) ** SAMPLED) ** levels
    return math.ceil(math.log(1 - recall) / math.log(1 - each))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a buffer that ends in white space, and where they begin."""
    space = _SPACE[data]
    edge = np.diff(np.r_[True, space].astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    # a polynomial of each byte's own random number, taken out of running sums modulo 2^64
    power = np.full(len(data), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.concatenate([[np.uint64(0)], np.add.accumulate(_BYTE[data] * power)])
    inverse = np.full(len(data), _BASE_INV, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    return mixed((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64)), begin


def words_of(data: np.ndarray, segment: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The same of a buffer of any length, segment by segment, each cut after white space, so that little memory is held."""
    hashes, begins, at = [], [], 0
    while at < len(data):
        end = min(at + segment, len(data))
        while end < len(data) and not _SPACE[data[end - 1]]:
            gap = np.flatnonzero(_SPACE[data[end : end + segment]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + segment, len(data))
        h, b = word_hashes(data[at:end])
        hashes.append(h)
        begins.append(b + at)
        at = end
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*begins, np.zeros(0, np.int64)])


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words, repeats too, with the bounds of each text's, and the word hashes with theirs.

    A text of fewer than n words has one n-gram, of all its words; one without words has none.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    words, at = words_of(data)
    lengths = np.array([len(t) + 1 for t in texts])
    first = np.searchsorted(at, np.cumsum(lengths) - lengths)
    count = np.diff(np.r_[first, len(words)])
    grams = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    bounds = np.r_[0, np.cumsum(grams)]
    # each n-gram's first word
    start = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first, grams)
    h = np.zeros(len(start), np.uint64)
    size = np.repeat(np.minimum(count, n), grams)
    for k in range(n):
        w = words[np.minimum(start + k, len(words) - 1)] if len(words) else h
        h = np.where(k < size, mixed(h * np.uint64(3) + w + np.uint64(k + 1)), h)
    return h, bounds, words, np.r_[first, len(words)]


def _texts(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with the texts' bytes: so many at a time, or one text that is longer."""
    for batch in batches:
        texts, k = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()], 0
        while k < len(texts):
            j, size = k, 0
            while j < len(texts) and (j == k or size + len(texts[j]) <= most):
                size += len(texts[j])
                j += 1
            yield batch.slice(k, j - k), texts[k:j]
            k = j


def _digest(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, runs: int) -> DataFrame:
    """(id, tie, text, size, keys, lanes): a hash of the text as it is, the digest of its words, its n-grams with repeats, the roots'
    keys of all runs, and the minhash vector (8 bits each).

    Texts without words have null keys and lanes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, 1):
            h, bounds, words, at = shingles(texts, n)
            some = np.flatnonzero(np.diff(bounds))
            small = (h >> np.uint64(16)).astype(np.uint32)
            least = np.zeros((LANES, len(some)), np.uint32)
            # pieces that stay in the cache; a text over several pieces takes the least of them
            for a in range(0, len(some), 64):
                part = some[a : a + 64]
                lo, hi = bounds[part[0]], bounds[part[-1] + 1]
                for b in range(lo, hi, 1 << 15) if len(part) == 1 else (lo,):
                    piece = small[b : min(hi, b + (1 << 15))] if len(part) == 1 else small[lo:hi]
                    starts = bounds[part] - lo if len(part) > 1 else np.array([0])
                    for lane in range(LANES):
                        x = np.minimum.reduceat((piece ^ _B[lane]) * _A[lane], starts)
                        least[lane, a : a + len(part)] = x if b == lo else np.minimum(least[lane, a : a + len(part)], x)
            keys: list = [None] * len(texts)
            lanes: list = [None] * len(texts)
            root = least[: runs * SAMPLED].astype(np.uint64)
            # a root's key: run and position, and the minhash found there
            root = mixed((np.arange(len(root), dtype=np.uint64)[:, None] << np.uint64(32)) | root).astype(np.int64).T
            # a byte of a hash of each minhash: its own upper bits are 0 in all long texts
            code = np.ascontiguousarray(((least * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).T)
            for i, k in enumerate(some):
                keys[k], lanes[k] = root[i], code[i].tobytes()
            ids = [_digest(words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(np.diff(bounds), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(lanes, pa.binary())], names=["id", "tie", "text", "size", "keys", "lanes"])
        release()

    if runs * SAMPLED > LANES:
        raise ValueError("more runs than the minhash vector has positions for")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie")).mapInArrow(run, "id long, tie long, text binary, size long, keys array<long>, lanes binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows of sorted batches, group by group of equal values in the first `keys` columns."""
    held: list[list] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


class Forest:
    """Union-find over positions, smallest root first."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _brute(buckets: DataFrame) -> DataFrame:
    """Candidate links (a, b, agree) that connect, within buckets of (key, cid, part, lanes); each bucket fits in memory.

    Sets of a part are connected already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int, int]] = []

        def out() -> pa.RecordBatch:
            columns = zip(*links, strict=True) if links else ([], [], [])
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["a", "b", "agree"])
            links.clear()
            return batch

        for group in _groups(batches, 1):
            cids = [r[1] for r in group]
            lanes = np.frombuffer(b"".join([r[3] for r in group]), np.uint8).reshape(len(group), LANES)
            part = np.unique([r[2] for r in group], return_inverse=True)[1]  # what is connected so far
            for i in range(len(group) - 1):
                rest = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
                if not len(rest):
                    continue
                agree = np.add.reduce((lanes[rest] == lanes[i]).view(np.uint8), 1, dtype=np.uint16)
                near = np.flatnonzero(agree >= CANDIDATE)
                near = near[np.argsort(-agree[near].astype(int), kind="stable")]
                while len(near := near[part[rest[near]] != part[i]]):
                    j = rest[near[0]]
                    links.append((cids[j], cids[i], int(agree[near[0]])))
                    part[part == part[j]] = part[i]
            if len(links) > 10_000:
                yield out()
        yield out()

    return buckets.select("key", "cid", "part", "lanes").repartition("key").sortWithinPartitions("key", "cid").mapInArrow(run, "a long, b long, agree int")


def _agree(x: str, y: str) -> F.Column:
    """In how many positions two vectors agree."""
    lane = lambda v: f"substring({v}, i + 1, 1)"
    return F.expr(f"size(filter(sequence(0, {LANES - 1}), i -> {lane(x)} = {lane(y)}))")


def candidate_links(classes: DataFrame, levels: int = LEVELS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b, agree) between classes (cid, keys, lanes) that connect all that may be near, as a written table.

    A part is a set's own number, or that of a leader that it is connected to.
    """
    nodes = classes.where("keys is not null").select("cid", F.col("cid").alias("part"), F.explode("keys").alias("key"))
    lanes = classes.select("cid", "lanes")
    links, used = [], []
    for level in range(levels + 1):
        sizes = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.min(F.struct("cid", "part")).alias("led"))
        sizes = durable(sizes.where("lo <> hi").select("key", "n", "led"))
        used.append(sizes)
        # paths are joined to their buckets' sizes, and only those with company carry their vectors; maps of fixed size keep most
        # others out of the shuffles
        small = sizes.where(F.col("n") <= bucket).select("key")
        met = mark_in_bit_map(nodes, F.xxhash64("key"), bit_map(small, F.xxhash64("key")), "_may").where("_may").drop("_may").join(small, "key")
        met = durable(met)
        used.append(met)
        some = mark_in_bit_map(lanes, F.xxhash64("cid"), bit_map(met, F.xxhash64("cid")), "_may").where("_may").drop("_may")
        links.append(_brute(met.join(some, "cid")))
        hot = sizes.where(F.col("n") > bucket)
        if hot.isEmpty():
            break
        if level == levels:
            links.append(_brute(_by_blocks(nodes, hot, bucket).join(lanes, "cid")))
            break
        leaders = hot.select("key", "led", F.col("led.cid").alias("cid")).join(lanes.withColumnRenamed("lanes", "leader_lanes"), "cid").drop("cid")
        large = nodes.join(leaders, "key").join(lanes, "cid")
        # the positions that a path samples next depend on the path alone
        at = [F.pmod(F.xxhash64("key", F.lit(f"{level} {k}")), F.lit(LANES)).cast("int") for k in range(SAMPLED)]
        child = [F.xxhash64("key", p, F.substring("lanes", p + 1, F.lit(1))) for p in at]
        large = large.select("cid", "part", "led", _agree("lanes", "leader_lanes").alias("agree"), F.array_distinct(F.array(*child)).alias("child"))
        large = durable(large)
        used.append(large)
        near = F.col("agree") >= CANDIDATE
        links.append(large.where(near & (F.col("cid") != F.col("led.cid"))).select(F.col("cid").alias("a"), F.col("led.cid").alias("b"), "agree"))
        nodes = large.select("cid", F.when(near, F.col("led.part")).otherwise(F.col("part")).alias("part"), F.explode("child").alias("key"))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    every = durable(every)
    discard(*used)
    return every


def _by_blocks(nodes: DataFrame, hot: DataFrame, bucket: int) -> DataFrame:
    """What is left in large buckets, as buckets of bounded size (key, cid, part): sets outside a bucket's largest part, block by block, with all of it."""
    counts = nodes.join(hot.select("key"), "key").groupBy("key", "part").count().groupBy("key").agg(F.max(F.struct("count", "part")).alias("m"), F.sum("count").alias("n"))
    half = bucket // 2
    blocks = lambda n: F.greatest(F.ceil(n / half), F.lit(1)).cast("int")
    rows = nodes.join(counts.select("key", F.col("m.part").alias("main"), blocks(F.col("n") - F.col("m.count")).alias("ours"), blocks(F.col("n")).alias("theirs")), "key")
    place = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    own = rows.where("part <> main").select("cid", "part", "key", place("ours").alias("i"), F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)).alias("j"))
    all_ = rows.select("cid", "part", "key", F.explode(F.sequence(F.lit(0), F.col("ours") - 1)).alias("i"), place("theirs").alias("j"))
    return own.union(all_).select("cid", "part", F.xxhash64("key", "i", "j").alias("key")).distinct()


def _sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, text, grams): the digest of the text, and its distinct n-grams, sorted. Of rows that repeat an id and text, a task gives one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch, texts in _texts(batches, 1):
            h, bounds, words, at = shingles(texts, n)
            ids = [_digest(words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            rows = []
            for k, row in enumerate(zip(batch.column(0).to_pylist(), ids, strict=True)):
                if row not in seen:
                    seen.add(row)
                    rows.append((*row, np.unique(h[bounds[k] : bounds[k + 1]]).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["id", "text", "grams"])
            if len(seen) > 100_000:
                seen.clear()
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, text binary, grams binary")


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of left and right (positions) are similar enough, exactly.

    Common n-grams are counted pair by pair where few sets have one, else by products of incidence matrices.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, n_of = owner[order], n[column[order]]
    where = np.full((2, len(sets)), -1)
    where[0, left], where[1, right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.int64)
    for d in np.unique(n[(n > 1) & (n < THIN)]):
        together = owner[n_of == d].reshape(-1, d)
        step = max(1, (1 << 20) // int(d * d))
        for k in range(0, len(together), step):
            part = together[k : k + step]
            i, j = where[0][part][:, :, None], where[1][part][:, None, :]
            at = (i * len(right) + j)[(i >= 0) & (j >= 0)]
            if len(at) * 8 > common.size:
                common += np.bincount(at, minlength=common.size).reshape(common.shape)
            else:
                np.add.at(common.reshape(-1), at, 1)
    owner, n_thick = owner[n_of >= THIN], n[n >= THIN]
    column = np.repeat(np.arange(len(n_thick)), n_thick)
    for a in range(0, len(n_thick), 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        o, c = owner[lo:hi], column[lo:hi] - a
        x, y = (np.zeros((len(side), min(4096, len(n_thick) - a)), np.float32) for side in (left, right))
        for m, w in ((x, where[0]), (y, where[1])):
            ok = w[o] >= 0
            m[w[o[ok]], c[ok]] = 1
        common += (x @ y.T).astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None] - common
    return np.nonzero(DENOMINATOR * common >= NUMERATOR * union)


def tree(links: list[tuple[int, int]]) -> Iterator[tuple[int, int | None, list[int]]]:
    """Links of a forest as (position, the one above it or None, all of its tree): each tree hangs from its smallest position."""
    near: dict[int, list[int]] = {}
    for x, y in links:
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
    above: dict[int, int | None] = {}
    for top in sorted(near):
        if top not in above:
            above[top] = None
            own = [top]
            for x in own:
                for y in near[x]:
                    if y not in above:
                        above[y] = x
                        own.append(y)
            for x in own:
                yield x, above[x], own


#: What is known of a text's row of the smallest id: whether the id is null, the id, and the hash of its text.
_FIRST = "none boolean, id long, tie long"


def verify(members: DataFrame) -> DataFrame:
    """(cid, above, near_id, root, linked, rep) of sets that are linked exactly to others of their group, from (comp, i, j, cid, first, side, grams, copies).

    In a group (comp, i, j), sets of side 0 are compared with each other, or with those of side 1 where there are any. The links
    of a group are a forest that connects all its linked sets: `above` is the set that one hangs from (null for a tree's root),
    near_id that set's smallest id, root the tree's smallest cid, rep the smallest `first` in the tree. linked counts all links of the set
    in the group, not only those of the tree: the copies of all sets that it is linked to.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    names = ["cid", "above", "near_id", "root", "linked", "none", "id", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)
            rows.clear()
            return batch

        for group in _groups(batches, 3):
            own = {(r[3], r[5]): r for r in group}  # rows that repeat an id and a text are one class
            at = sorted(own)
            sets = [np.frombuffer(own[c][6], np.uint64) for c in at]
            side = np.array([c[1] for c in at])
            copies, linked = np.array([own[c][7] for c in at]), np.zeros(len(at), np.int64)
            links = []
            if len(at) == 2 and not side.any():
                common = len(np.intersect1d(*sets, assume_unique=True))
                links = [(0, 1)] if DENOMINATOR * common >= NUMERATOR * (len(sets[0]) + len(sets[1]) - common) else []
                linked += copies[::-1] * len(links)
            elif len(at) > 1:
                # a set that is on both sides is one vertex: its first place
                place = {c: k for k, (c, _) in reversed(list(enumerate(at)))}
                vertex = np.array([place[c] for c, _ in at])
                forest, left = Forest(len(at)), np.flatnonzero(side == 0)
                right = np.flatnonzero(side == 1) if side.any() else left
                a, b = exact_links(sets, left, right)
                a, b = vertex[left[a]], vertex[right[b]]
                a, b = a[a != b], b[a != b]
                linked += np.bincount(a, copies[b], len(at)).astype(np.int64)
                if side.any():  # else each link is there in both directions
                    linked += np.bincount(b, copies[a], len(at)).astype(np.int64)
                links = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, y)]
            first = lambda k: own[at[k]][4]
            last, rep = None, ()
            for x, y, all_ in tree(links):
                if all_ is not last:
                    last, rep = all_, min(((f["none"], f["id"] or 0, f["tie"]), f["id"]) for f in map(first, all_))
                rows.append((at[x][0], None if y is None else at[y][0], None if y is None else first(y)["id"], at[all_[0]][0], int(linked[x]), rep[0][0], rep[1], rep[0][2]))
            if len(rows) > 10_000:
                yield out()
        yield out()
        release()

    slim = members.select("comp", "i", "j", "cid", "first", "side", "grams", "copies").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    found = slim.mapInArrow(run, f"cid long, above long, near_id long, root long, linked long, {_FIRST}")
    return found.select("cid", "above", "near_id", "root", "linked", F.struct("none", "id", "tie").alias("rep"))


def check_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets (cid, first, grams) are similar enough, as (a, b, near_id).

    A set that many pairs have is the skew join's to split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["a", "b", "near_id"]).filter(pa.array(near, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("first.id").alias("near_id"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "near_id", "x", "y").mapInArrow(run, "a long, b long, near_id long")


def _across(found: DataFrame, sets: DataFrame, stock: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """What connects linked sets (comp, blocks, block, cid, first, grams, copies) of several blocks: exact links (a, b, near_id), and (cid, root) of all sets.

    found: the trees within blocks; stock: candidate links (a, b, agree) that connect each comp.
    """
    slim = sets.select("comp", "cid")
    within = found.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    stock = durable(stock.join(slim.select(F.col("cid").alias("a")), "a", "left_semi").groupBy("a", "b").agg(F.max("agree").alias("agree")))
    extra = tested = None

    def parts() -> DataFrame:
        joined = components(within if extra is None else within.union(extra.select("a", "b")))
        return durable(slim.join(joined.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))

    for rest in (False, True):
        part, live = parts(), stock
        for end in ("a", "b"):
            live = live.join(part.select(F.col("cid").alias(end), F.col("root").alias(f"p{end}")), end)
        live = live.where("pa <> pb")
        if rest:
            live = live.join(tested, ["a", "b"], "left_anti").select("a", "b")
        else:
            both = live.select("a", "b", "agree", F.col("a").alias("own")).union(live.select("a", "b", "agree", F.col("b").alias("own")))
            live = both.groupBy("own").agg(F.max(F.struct("agree", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
        tested = durable(live)
        if tested.isEmpty():
            break
        more = check_pairs(tested, sets)
        extra = durable(more if extra is None else extra.unionByName(more))
    # whatever is outside the largest part of its comp, block by block against all of the comp
    part = parts()
    largest = part.groupBy("comp", "root").count().groupBy("comp").agg(F.max(F.struct("count", "root")).alias("m"), F.sum("count").alias("all"))
    largest = largest.where(F.col("all") > F.col("m.count")).select("comp", F.col("m.root").alias("main"), F.ceil((F.col("all") - F.col("m.count")) / block).cast("int").alias("rows"))
    largest = durable(largest)
    none = sets.sparkSession.createDataFrame([], "a long, b long, near_id long")
    if not largest.isEmpty():
        apart = sets.join(part.select("cid", "root"), "cid").join(largest, "comp").withColumn("own", F.pmod(F.xxhash64("cid", F.lit("apart")), F.col("rows")).cast("int"))
        one = apart.where("root <> main").select("comp", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "cid", "first", F.lit(0).alias("side"), "grams", "copies")
        all_ = apart.select("comp", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("block").alias("j"), "cid", "first", F.lit(1).alias("side"), "grams", "copies")
        more = verify(one.unionByName(all_)).where("above is not null").select(F.col("cid").alias("a"), F.col("above").alias("b"), "near_id").distinct()
        extra = durable((none if extra is None else extra).unionByName(more))
        part = parts()
    return none if extra is None else extra, part.select("cid", "root")


def _links_across(sets: DataFrame) -> DataFrame:
    """(cid, across): the copies of all sets of other blocks that a set (comp, blocks, block, cid, first, grams, copies) is linked to.

    Each block meets each other one of its comp once, as a group of bounded size: the work is that of all pairs within a comp.
    """
    own = sets.select("comp", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks"))).alias("j"), "blocks", "cid", "first", F.lit(0).alias("side"), "grams", "copies").where("j < blocks")
    other = sets.where("block > 0").select("comp", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), "blocks", "cid", "first", F.lit(1).alias("side"), "grams", "copies")
    return verify(own.unionByName(other)).groupBy("cid").agg(F.sum("linked").alias("across"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, recall: float = 0.99999, detail: bool = False, bucket: int = BUCKET, block: int = BLOCK, counted: bool = True) -> DataFrame:
    """One row per row of docs: id, class_id, copy_id, copies, near_ids and links.

    Words are runs without white space; texts of equal words are copies. copy_id is the smallest id of the
    text's copies, their representative, and copies their number. class_id is the smallest id in the connected component
    of links, a link being a Jaccard similarity of 0.8 or more between the n-grams of two texts. near_ids are the
    representatives of texts that the text is linked to: pairs (copy_id, near_id) that connect all linked texts
    of a class as a tree (with a few more where a class has several blocks). links is the number of all other rows that the row is
    linked to, its copies and each row of every text with a link to its own: the exact count of pairs, which aren't expanded; without
    `counted` there is no such column, and blocks of a class meet only as far as connecting it needs. Texts of fewer than n words have one n-gram, of all words; texts
    without words (null, empty) are similar to none and each row is a class of its own. Null ids count as
    rows, and are an id only where a text or class has no other. Repeated rows are copies of each other. Very long texts are
    hashed piece by piece. With detail, the columns tie (the hash of the text), class_key (a number of the class, null for
    texts without words) and rep (id is null, id and tie of the class's row of the smallest id) follow. Other columns of docs
    play no part. Empty input: empty result.
    """
    ship(docs.sparkSession)
    signed = durable(signatures(docs, id_col, text_col, n, runs_for(recall)))
    worded = signed.where("lanes is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("first")
    classes = worded.groupBy("text").agg(first, F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("size", "keys", "lanes")])
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()))
    # vectors are kept once for each text; rows go on without them
    rows = durable(signed.select("id", "tie", "text", F.col("lanes").isNotNull().alias("worded")))
    discard(signed)

    links = candidate_links(classes.select("cid", "keys", "lanes"), bucket=bucket)
    comps = components(links).select(F.col("id").alias("cid"), F.col("root").alias("comp"))
    comps = comps.union(comps.select("comp", "comp").distinct())
    inside = durable(classes.select("cid", "text", "first", "size", "copies").join(comps, "cid"))
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("size") / F.lit(BLOCK_GRAMS))).cast("int").alias("blocks")
    blocks = durable(inside.groupBy("comp").agg(blocks).where("blocks > 1"))
    several = not blocks.isEmpty()
    # the texts of those classes alone are read again; the map lets few others through
    ids = bit_map(inside, F.xxhash64("first.id"))
    again = mark_in_bit_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), F.xxhash64("id"), ids, "_may").where("_may").select("id", "text")
    sets = _sets(again, "id", "text", n).withColumnRenamed("text", "digest")
    members = sets.join(inside, (sets.digest == inside.text) & sets.id.eqNullSafe(F.col("first.id"))).select("comp", "cid", "first", "grams", "copies")
    if several:
        members = members.join(blocks, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        members = durable(members.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    else:
        members = members.withColumn("block", F.lit(0))
    found = durable(verify(members.withColumns({"i": F.col("block"), "j": F.col("block"), "side": F.lit(0)})))

    no_ids = F.array().cast("array<bigint>")
    info = classes.select("cid", "text", "first", "copies").join(found.select("cid", "root", "rep", "near_id", "linked"), "cid", "left")
    info = info.select("cid", "text", "first", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("root", "cid").alias("root"), F.coalesce("rep", "first").alias("rep"), F.array_compact(F.array("near_id")).alias("near_ids"))
    if several:
        sets = members.where("blocks > 1").dropDuplicates(["cid"])
        extra, parts = _across(found, sets, links, block)
        if counted:
            info = info.join(_links_across(sets), "cid", "left").withColumn("links", F.col("links") + F.coalesce("across", F.lit(0))).drop("across")
        more = extra.groupBy(F.col("a").alias("cid")).agg(F.collect_set("near_id").alias("more"))
        info = info.join(parts.withColumnRenamed("root", "part"), "cid", "left").join(more, "cid", "left")
        info = info.withColumn("near_ids", F.array_union("near_ids", F.coalesce("more", no_ids))).withColumn("root", F.coalesce("part", "root")).drop("part", "more", "rep")
        info = info.join(info.groupBy("root").agg(F.min("first").alias("rep")), "root")
    info = durable(info.select("text", F.col("root").alias("class_key"), "rep", F.col("first.id").alias("copy_id"), "copies", F.array_sort("near_ids").alias("near_ids"), "links"))
    discard(links, inside)
    out = attach(rows.where("worded").select("id", "tie", "text"), info, "text", "copies").withColumn("class_id", F.col("rep.id"))
    none = rows.where(~F.col("worded")).select(
        "id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(1).cast("long").alias("copies"), no_ids.alias("near_ids"), F.lit(0).cast("long").alias("links"),
        "tie", F.lit(None).cast("long").alias("class_key"), F.struct(F.col("id").isNull().alias("none"), "id", "tie").alias("rep"),
    )
    more = (*(("links",) if counted else ()), *(("tie", "class_key", "rep") if detail else ()))
    return out.select(*none.columns).unionByName(none).select("id", "class_id", "copy_id", "copies", "near_ids", *more).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near duplicates: that of the smallest id (null last), then of the smallest hash of its text.

    Rows without words (null and empty texts) all stay. Of repeated rows of that id and text any one stays. Only rows that
    may go are shuffled with their texts. Columns of docs may have any names. Empty input: empty result.
    """
    id_, tie, may, gone = fresh(docs.columns, "_id", "_tie", "_may", "_gone")
    found = near_duplicates(docs.select(id_col, text_col), id_col, text_col, detail=True, counted=False).where("class_key is not null")
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "tie")
    # rows of an id and text that all go, or of which one stays
    state = found.groupBy(F.col(id_col).alias(id_), F.col("tie").alias("_t")).agg(F.first(own != F.col("rep")).alias(gone), F.count("*").alias("_n"))
    state = durable(state.where(F.col(gone) | (F.col("_n") > 1)).select(F.col(id_), F.col("_t").alias(tie), gone))
    rows = docs.withColumns({id_: F.col(id_col).cast("long"), tie: F.xxhash64(text_col)})
    rows = mark_in_bit_map(rows, F.xxhash64(id_, tie), bit_map(state, F.xxhash64(id_, tie)), may)
    unsure, there = rows.where(may), state.select(F.col(id_).alias(f"{id_}2"), F.col(tie).alias(f"{tie}2"), gone)
    unsure = unsure.join(there, F.col(id_).eqNullSafe(F.col(f"{id_}2")) & (F.col(tie) == F.col(f"{tie}2")), "left")
    alone = unsure.where(F.col(gone).isNull()).select(*docs.columns)
    one = unsure.where(~F.col(gone)).dropDuplicates([id_, tie]).select(*docs.columns)
    return rows.where(~F.col(may)).select(*docs.columns).unionByName(alone).unionByName(one)
