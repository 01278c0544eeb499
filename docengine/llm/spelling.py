"""Spelling variants by a bit-sliced position index.

Words that differ by one code point share two thirds of the shorter word in place: whatever third the difference is in,
the rest before it and the rest after it are equal. So each word goes, by a hash of that rest, to the words it may be near
to, for each third and for both lengths the shorter word may have. The third of the first difference is the only
one in which a pair counts, so that no pair is found twice.

There, words are compared 64 at a time. A block of words, the most frequent first, has one bit set for each letter at
each position. All words of the block run over these sets together: the set of words without error so far, and
the sets with one error (a letter replaced, one more, one less), which go on at the same position, one later or one earlier. The
count of bits left is the number of near words, the first bit the most frequent of them.

A group above a fixed size isn't compared: its words are dealt again by smaller parts of the third, down to single
positions, where the alphabet bounds a group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, durable, release, ship

#: Distinct words that a task counts before it sends them on, and characters that it reads at a time.
HELD, WINDOW = 200_000, 1 << 20
#: Words of a block, words of a group that is still compared, and parts that a larger group's third is cut into.
BLOCK, LARGEST, PARTS = 2048, 8192, 16
#: Letters of a block that are compared at a time, and words of it that run over the sets together.
CELLS, ROWS = 1 << 22, 4096
#: Stands for the end of a word in the index.
_END = 0x110000
_LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LETTER = "[A-Za-zÀ-ÿ]"


def runs(text: str, letter: re.Pattern, run: re.Pattern) -> Iterator[str]:
    """Maximal runs of letters, window by window."""
    at = 0
    while at < len(text):
        to = min(len(text), at + WINDOW)
        while to < len(text) and letter.match(text, to - 1) and letter.match(text, to):
            to += 1
        yield from run.findall(text, at, to)
        at = to


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shortest: int = 7, min_count: int = 2, drop_one_in: int | None = None) -> DataFrame:
    """Words (word, n) of whole texts: maximal runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased, of `shortest` code points or more and `min_count` occurrences or more.

    With drop_one_in, misspellings are planted: where it divides h, the crc32 of `<id>:<lower-cased run>` (null id: empty),
    the run loses its code point h % length before it is counted. Null and empty texts have no words. Long texts are read in
    windows. Rows that repeat count as often as they are there. Other columns don't matter. Empty input: no rows.
    Each task counts its words before they are shuffled.
    """
    ship(docs.sparkSession)
    letter, run = re.compile(_LETTER), re.compile(_LETTER + "{%d,}" % shortest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return done

        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                low = text.lower() if text.isascii() else text.encode().translate(_LOWERED).decode()
                if not drop_one_in:
                    counts.update(runs(low, letter, run))
                else:
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for word, n in Counter(runs(low, letter, run)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % drop_one_in == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                            if len(word) < shortest:
                                continue
                        counts[word] += n
                if len(counts) >= HELD:
                    yield out()
        if counts:
            yield out()
        release()

    found = docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rest_of(word: Column, short: Column, begin: Column, end: Column) -> Column:
    """Hash of what surrounds [begin, end) of a word of length `short`, and of what would surround it in a word longer by one."""
    tail = short - end
    return F.xxhash64(short, begin, end, F.substring(word, F.lit(1), begin), F.substring(word, F.length(word) - tail + 1, tail))


def dealt(words: DataFrame, parts: Column) -> DataFrame:
    """One row for each part (short, begin, end) of a word (word, n), with the hash of what surrounds it."""
    rows = words.select("word", "n", F.explode(parts).alias("part")).select("word", "n", "part.*").where("begin < `end`")
    rows = rows.withColumn("key", rest_of(F.col("word"), F.col("short"), F.col("begin"), F.col("end")))
    return rows.repartition("key").sortWithinPartitions("short", "begin", "end", "key")


def thirds(word: Column) -> Column:
    """The thirds of a word, as the shorter one of a pair and as the longer one."""
    size = F.length(word)
    part = lambda short: lambda k: F.struct(short.alias("short"), F.floor(short * k / 3).cast("int").alias("begin"), F.floor(short * (k + 1) / 3).cast("int").alias("end"))
    return F.flatten(F.transform(F.array(size - 1, size), lambda short: F.transform(F.sequence(F.lit(0), F.lit(2)), part(short))))


def smaller(begin: Column, end: Column, short: Column) -> Column:
    """A part cut into PARTS, or into single positions."""
    n = F.least(end - begin, F.lit(PARTS))
    cut = lambda k: (begin + F.floor((end - begin) * k / n)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(short.alias("short"), cut(k).alias("begin"), cut(k + 1).alias("end")))


def near_words(words: list[str], short: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the words (lengths `short` and one more): how many of them differ from it by one code point, first in [begin, end), and the first of these.

    Where the shorter word is the beginning of the longer one, the difference counts as at its last position.
    """
    m = len(words)
    is_short = np.array([len(w) == short for w in words])
    letters = np.full((m, short + 1), _END, np.uint32)
    for rows, width in ((is_short, short), (~is_short, short + 1)):
        text = "".join([w for w, r in zip(words, rows, strict=True) if r])
        letters[np.flatnonzero(rows), :width] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, width)
    alphabet, letters = np.unique(letters, return_inverse=True)
    letters = letters.reshape(m, short + 1)
    width, column = -(-m // 64), np.arange(m)

    def sliced(hot: np.ndarray) -> np.ndarray:
        return np.packbits(hot, axis=-1, bitorder="little").view(np.uint64)

    def index(i: int) -> np.ndarray:
        """The words that have each letter at position i, as bits."""
        hot = np.zeros((len(alphabet), width * 64), bool)
        if i <= short:
            hot[letters[:, i], column] = True
        return sliced(hot)

    shorter = np.zeros(width * 64, bool)
    shorter[:m] = is_short
    shorter = sliced(shorter)
    count, first = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for kind in (True, False):
        own = np.flatnonzero(is_short == kind)
        for at in range(0, len(own), ROWS):
            rows = own[at : at + ROWS]
            same = np.full((len(rows), width), ~np.uint64(0))  # no error yet
            replaced, shifted = np.zeros_like(same), np.zeros_like(same)  # one error: letter replaced; one more (or less) in the other word
            before, here, after = None, index(0), index(1)
            for i in range(short + (not kind)):
                q = letters[rows, i]
                hit = here[q]
                wrong = same & ~hit if begin <= min(i, short - 1) < end else np.uint64(0)
                if kind:
                    replaced = (replaced & hit) | wrong
                    shifted = (shifted | wrong) & after[q]
                else:
                    shifted = (shifted & before[q] if before is not None else shifted) | wrong
                same &= hit
                before, here, after = here, after, index(i + 2)
            if kind and end == short:
                shifted |= same
            bits = (replaced & shorter) | (shifted & ~shorter) if kind else shifted & shorter
            count[rows] = np.bitwise_count(bits).sum(1)
            word = (bits != 0).argmax(1)
            held = bits[np.arange(len(rows)), word]
            first[rows] = word * 64 + np.bitwise_count((held & -held) - np.uint64(1))
    return count, first


def compared(rows: DataFrame, block: int, largest: int) -> DataFrame:
    """Near words of each row of `dealt`; words of groups above `largest` come back with their part instead."""
    names = ["word", "n", "n_near", "form_n", "form", "short", "begin", "end"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        counts: list[int] = []
        part = (0, 0, 0)

        def flush() -> Iterator[pa.RecordBatch]:
            if words:
                order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
                by = [words[i] for i in order]
                n = np.array(counts, np.int64)[order]
                near, first = near_words(by, *part)
                some = np.flatnonzero(near)
                if len(some):
                    own, best = some.tolist(), first[some]
                    columns = [[by[i] for i in own], n[some], near[some], n[best], [by[i] for i in best.tolist()], *[[None] * len(own)] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
                words.clear()
                counts.clear()

        def again(some: list[str], n: list[int], at: tuple) -> pa.RecordBatch:
            size = len(some)
            columns = [some, n, *[[None] * size] * 3, *([x] * size for x in at[:3])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def group(some: list[str], n: list[int], at: tuple) -> Iterator[pa.RecordBatch]:
            """A whole group joins the block."""
            nonlocal part
            if len(some) < 2:
                return
            if at[:3] != part or len(words) + len(some) > block or (len(words) + len(some)) * at[0] > CELLS:
                yield from flush()
                part = at[:3]
            words.extend(some)
            counts.extend(n)

        held: tuple[list[str], list[int], tuple] = ([], [], ())  # the group that may go on
        large = None  # a group that is dealt again
        for batch in batches:
            if not batch.num_rows:
                continue
            w, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2, 6)], 1)
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(w)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = tuple(ids[a].tolist())
                if at == large:
                    yield again(w[a:b], n[a:b], at)
                    continue
                if at != held[2]:
                    yield from group(*held)
                    held = ([], [], at)
                held[0].extend(w[a:b])
                held[1].extend(n[a:b])
                if len(held[0]) > largest and at[2] - at[1] > 1:
                    yield again(*held)
                    large, held = at, ([], [], ())
        yield from group(*held)
        yield from flush()
        release()

    return rows.select("word", "n", "short", "begin", "end", "key").mapInArrow(run, "word string, n long, n_near long, form_n long, form string, short int, begin int, end int")


def variants(words: DataFrame, ratio: int = 10, block: int = BLOCK, largest: int = LARGEST) -> DataFrame:
    """Words (word, n) with n_near, form, form_n and root.

    Two words are near if one code point is inserted, deleted or replaced between them. A word's form is its near word of
    the largest n (ties: the smallest in code-point order) if that is at least `ratio` (more than 1) times its own n; its root is what
    forms lead to in the end, the word itself where there is none. Words that are given twice count as one, with the larger n; null and
    empty words are left out. Words may be long. Other columns are dropped. Empty input: no rows.
    """
    ship(words.sparkSession)
    given = durable(words.select("word", F.col("n").cast("long").alias("n")).where("word <> ''").groupBy("word").agg(F.max("n").alias("n")))
    tables = [durable(compared(dealt(given, thirds(F.col("word"))), block, largest))]
    while True:
        pending = tables[-1].where("n_near IS NULL")
        if pending.isEmpty():
            break
        tables.append(durable(compared(dealt(pending, smaller(F.col("begin"), F.col("end"), F.col("short"))), block, largest)))
    rows = given.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    for t in tables:
        rows = rows.unionByName(t.where("n_near IS NOT NULL").drop("short", "begin", "end"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))).alias("best")
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    is_form = -F.col("best.n") >= ratio * F.col("n")
    found = found.select("word", "n", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    found = durable(found.withColumn("root", F.coalesce("form", "word")))
    discard(given, *tables)

    # roots of roots: twice as far in each round; n grows with each form, so chains are short
    linked, last = found.where("form IS NOT NULL"), None
    while True:
        told = Observation()
        further = linked.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = linked.join(further, "root", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        done = durable(joined.observe(told, F.max("moved").alias("any")))
        if last is not None:
            discard(last)
        linked = last = done
        if not told.get["any"]:
            break
        linked = linked.drop("moved")
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    return found.where("form IS NULL").select(*columns).unionByName(linked.select(*columns))
