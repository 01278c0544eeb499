"""Phrase collocations by Rabin-Karp fingerprints.

Texts are read three times, and only frequent phrases ever become strings:
  1. Words are counted by language. Frequent ones go into a bit map of fixed size; other words part the text from then on.
  2. numpy's prefix sums of word hashes times powers of a base give the fingerprint of every phrase of two words or more in
     a few array operations. Their leading bits, counted and sorted in the task, are shuffled as differences to
     ranges of counters of fixed size; what may be frequent goes into a second bit map.
  3. Phrases whose fingerprint is in that map are grouped by their whole fingerprint in the task, every occurrence is compared with
     the words at the group's first occurrence (a collision makes a group of its own), and the group goes, with the
     words that its pointer leads to, to an exact count, packed by ranges of fingerprints.
The maps and counters can only let too much through, never too little, so that counts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CHUNK_BITS, attach, bit_map, discard, durable, release, ship

#: Words that a task reads before it sends on what it has counted, and distinct words that it counts.
CHUNK, HELD = 1 << 21, 200_000
#: Bytes of a text that are split at a time.
SLICE = 1 << 22
#: Bits of the map of frequent words, and bits of the map of frequent phrases at most (64 MB).
WORD_BITS, PHRASE_BITS = 1 << 26, 1 << 29
#: Counters of a range at least, ranges at most, and counters at most.
SPAN, RANGES, COUNTERS = 1 << 22, 1 << 15, 1 << 40
#: Frequent phrases of a range, about, as long as there may be more ranges.
PHRASES = 1 << 14
#: Parts of a language whose first phrases are chosen before those of the language.
SALTS = 64
#: What parts pieces of a text: `[.,;:!?\x0a-\x0d]`.
_PARTING = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _PARTING, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_PARTING))
_BASE = 0x9E3779B97F4A7C15 | 1
_SEEDS = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64)


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text, A-Z lower-cased, with a line end where a piece ends and an empty word between two spaces; slice by slice."""
    text = (text or b"").translate(_TABLE)
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= SLICE else text.find(b" ", at + SLICE) % (len(text) + 1)
        yield text[at:to].replace(b"\n", b" \n ").split(b" ")
        at = to


class Numbers(dict):
    """Numbers of the words of one language, from 0; -1 for what parts phrases, -2 for no word."""

    def __init__(self, lang: bytes, reader: "Reader") -> None:
        super().__init__({b"\n": -1, b"": -2})
        self.seed, self.lang, self.reader = xxhash.xxh64_intdigest(lang, 42), lang, reader

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        r = self.reader
        at = h & (WORD_BITS - 1)
        if not r.known[at >> 3] >> (at & 7) & 1:
            n = -1
        else:
            n = len(r.words)
            r.words.append((self.lang, word))
            r.hashes.append(h)
        self[word] = n
        return n


class Reader:
    """Reads batches (text, lang) into chunks of word numbers; words that may not be frequent part phrases."""

    def __init__(self, known: np.ndarray, longest: int, chunk: int) -> None:
        self.known, self.longest, self.chunk = known, longest, chunk
        self.clear()

    def clear(self) -> None:
        self.words: list[tuple[bytes, bytes]] = []
        self.hashes: list[int] = []
        self.numbers: dict[bytes, Numbers] = {}

    def of(self, lang: bytes) -> Numbers:
        if lang not in self.numbers:
            self.numbers[lang] = Numbers(lang, self)
        return self.numbers[lang]

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        """(numbers, how many phrases' beginnings count): the last few words are read again with the next chunk."""
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts, langs = (batch.column(k).cast(pa.large_binary()).to_pylist() for k in (0, 1))
            for text, lang in zip(texts, langs, strict=True):
                for tokens in pieces(text):
                    x = np.array(list(map(self.of(lang).__getitem__, tokens)), np.int32)
                    held.append(x[x != -2])
                    size += len(held[-1])
                    if size >= self.chunk:
                        x = np.concatenate(held)
                        keep = self.longest - 1
                        yield x, len(x) - keep
                        last = [self.words[n] if n >= 0 else None for n in x[len(x) - keep :].tolist()] if keep else []
                        self.clear()
                        held = [np.array([-1 if w is None else self.of(w[0])[w[1]] for w in last], np.int32)]
                        size = len(last)
                held.append(np.array([-1], np.int32))
                size += 1
        if size:
            x = np.concatenate(held)
            yield x, len(x)
            self.clear()

    def fingerprints(self, x: np.ndarray, count: int, powers: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, beginnings, fingerprints) of the phrases of n words, for n from 2 up."""
        up, down = powers
        m = len(x)
        h = np.array([*self.hashes, 0], np.uint64)[x]  # -1 takes the last one
        prefix = np.zeros(m + 1, np.uint64)
        np.cumsum(h * down[:m], out=prefix[1:])
        place = np.arange(m)
        parts = np.where(x < 0, place, m)
        run = np.minimum.accumulate(parts[::-1])[::-1] - place
        run[count:] = 0
        for n in range(2, self.longest + 1):
            at = np.flatnonzero(run >= n)
            yield n, at, mixed((prefix[at + n] - prefix[at]) * up[at] + _SEEDS[n % 64] * np.uint64(n))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads what differs over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def powers_of_base(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(size, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Powers:
    """The powers, made longer where a chunk needs it."""

    def __init__(self) -> None:
        self.held = powers_of_base(1 << 16)

    def __call__(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < size:
            self.held = powers_of_base(size + size // 4)
        return self.held


def gathered(spark: SparkSession, maps: DataFrame, bits: int):
    """A bit map of a fixed size, sent to the Python workers."""
    out = np.zeros(bits // 8, np.uint8)
    for chunk, bitmap in maps.toLocalIterator():
        out[chunk * CHUNK_BITS // 8 :][: CHUNK_BITS // 8] = np.frombuffer(bitmap, np.uint8)
    return spark.sparkContext.broadcast(out)


def count_words(texts: DataFrame, held: int = HELD) -> DataFrame:
    """Rows (lang, word, n); a null word has the number of all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter[bytes]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in counts.items():
                words.pop(b"", None)
                words.pop(b"\n", None)
                words[None] = sum(words.values())
                columns = [pa.array([lang] * len(words), pa.binary()).cast(pa.string()), pa.array(words.keys(), pa.binary()).cast(pa.string()), pa.array(words.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for text, lang in zip(*(batch.column(k).cast(pa.large_binary()).to_pylist() for k in (0, 1)), strict=True):
                words = counts.setdefault(lang, Counter())
                for tokens in pieces(text):
                    words.update(tokens)
            if sum(map(len, counts.values())) >= held:
                yield from out()
        yield from out()
        release()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def counters_of(texts: DataFrame) -> int:
    """Counters in all: some for each phrase that the input's size suggests."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << min(max((size * 8).bit_length(), 24), COUNTERS.bit_length() - 1)


def likely_phrases(texts: DataFrame, known, longest: int, min_count: int, counters: int, chunk: int) -> DataFrame:
    """Leading bits of fingerprints whose counter comes to min_count, as rows (lead)."""
    span = max(SPAN, counters // RANGES)
    span_bits, lead_bits = span.bit_length() - 1, counters.bit_length() - 1
    count_type = np.dtype("u1") if min_count < 256 else np.dtype("<u4")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, powers = Reader(known.value, longest, chunk), Powers()
        for x, count in reader.chunks(batches):
            leads = [f >> np.uint64(64 - lead_bits) for _, _, f in reader.fingerprints(x, count, powers(len(x)))]
            if not leads or not sum(map(len, leads)):
                continue
            lead, n = np.unique(np.concatenate(leads), return_counts=True)
            del leads
            n = np.minimum(n, min_count).astype(count_type)
            range_ = (lead >> np.uint64(span_bits)).astype(np.int64)
            lead = (lead & np.uint64(span - 1)).astype(np.int64)
            edges = np.flatnonzero(np.r_[True, range_[1:] != range_[:-1], True])
            ranges, ats, ns = [], [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                step = np.diff(lead[a:b], prepend=0)
                small = step.max() < 1 << 16
                ranges.append(int(range_[a]))
                ats.append((b"2" if small else b"4") + step.astype("<u2" if small else "<u4").tobytes())
                ns.append(b"" if (n[a:b] == 1).all() else n[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(ats, pa.binary()), pa.array(ns, pa.binary())], names=["range", "at", "n"])
        release()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, sums = None, np.zeros(span, np.uint32)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums >= min_count) + range_ * span, pa.int64())], names=["lead"])

        for batch in batches:
            for r, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != range_:
                    if range_ is not None:
                        yield out()
                    range_ = r
                    sums[:] = 0
                at = np.cumsum(np.frombuffer(at, "<u2" if at[:1] == b"2" else "<u4", offset=1), dtype=np.int64)
                # a full counter stays full
                sums[at] = np.minimum(sums[at] + (np.frombuffer(n, count_type) if n else np.uint32(1)), min_count)
        if range_ is not None:
            yield out()
        release()

    parts = texts.mapInArrow(local, "range long, at binary, n binary")
    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(merged, "lead long")


def count_phrases(texts: DataFrame, known, likely, longest: int, counters: int, bits: int, chunk: int, min_count: int, ranges: int, held: int = 2 * HELD) -> DataFrame:
    """Rows (lang, size, phrase, n), n >= min_count, of the phrases whose fingerprint may be frequent.

    Each task sends what it has counted packed by range of fingerprints; one range is held at a time where they are summed.
    """
    lead_bits, range_bits = counters.bit_length() - 1, ranges.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, powers, table = Reader(known.value, longest, chunk), Powers(), likely.value
        counts: dict[tuple[int, bytes, bytes], int] = {}

        def out() -> pa.RecordBatch:
            rows: dict[int, tuple[list, list, list]] = {}
            for (f, lang, phrase), n in counts.items():
                row = rows.setdefault(f >> (64 - range_bits), ([], [], []))
                row[0].append(lang)
                row[1].append(phrase)
                row[2].append(n)
            counts.clear()
            kinds = (pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.int64()), *(pa.array([r[k] for r in rows.values()], kind) for k, kind in enumerate(kinds))], names=["range", "lang", "phrase", "n"])

        for x, count in reader.chunks(batches):
            for size, at, f in reader.fingerprints(x, count, powers(len(x))):
                lead = (f >> np.uint64(64 - lead_bits)) & np.uint64(bits - 1)
                some = (table[lead >> np.uint64(3)] >> (lead & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at, f = at[some], f[some]
                while len(at):
                    order = np.argsort(f, kind="stable")
                    at, f = at[order], f[order]
                    begin = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
                    first = np.repeat(begin, np.diff(np.r_[begin, len(f)]))
                    same = np.ones(len(at), bool)
                    for k in range(size):
                        same &= x[at + k] == x[at[first] + k]
                    n = np.add.reduceat(same.astype(np.int64), begin).tolist()
                    # what the group's pointer, its first occurrence, says
                    rows = x[at[begin][:, None] + np.arange(size)].tolist()
                    for fingerprint, row, more in zip(f[begin].tolist(), rows, n, strict=True):
                        words = [reader.words[j] for j in row]
                        key = (fingerprint, words[0][0], b" ".join([w for _, w in words]))
                        counts[key] = counts.get(key, 0) + more
                    at, f = at[~same], f[~same]
            if len(counts) >= held:
                yield out()
        if counts:
            yield out()
        release()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, sums = None, {}

        def out() -> pa.RecordBatch:
            found = [(lang, phrase.count(b" ") + 1, phrase, n) for (lang, phrase), n in sums.items() if n >= min_count]
            sums.clear()
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64())
            lang, size, phrase, n = (pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds))
            return pa.RecordBatch.from_arrays([lang.cast(pa.string()), size, phrase.cast(pa.string()), n], names=["lang", "size", "phrase", "n"])

        for batch in batches:
            for r, langs, phrases, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != range_:
                    if range_ is not None:
                        yield out()
                    range_ = r
                for key, n in zip(zip(langs, phrases, strict=True), ns, strict=True):
                    sums[key] = sums.get(key, 0) + n
        if range_ is not None:
            yield out()
        release()

    parts = texts.mapInArrow(run, "range long, lang array<binary>, phrase array<binary>, n array<long>")
    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(merged, "lang string, size int, phrase string, n long")


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100, counters: int | None = None, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, size, phrase, n) of 1 to `longest` words with n >= min_count, and languages (lang, n) with the number of their words.

    Whole texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`; overlapping
    occurrences within a piece all count. Null texts are empty, a null language is `und`. Rows that repeat count as
    often as they are there. Other columns don't matter. Long texts are read slice by slice. Both are written tables.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words = durable(count_words(texts).where((F.col("n") >= min_count) | F.col("word").isNull()))
    langs = words.where("word IS NULL").select("lang", "n")
    words = words.where("word IS NOT NULL")
    known = gathered(spark, bit_map(words, F.xxhash64("lang", "word"), WORD_BITS), WORD_BITS)
    counters = counters or counters_of(texts)
    leads = durable(likely_phrases(texts, known, longest, min_count, counters, chunk))
    n = leads.count()
    bits = min(counters, PHRASE_BITS, 1 << max(23, (n * 32).bit_length()))
    ranges = 1 << min(max((n // PHRASES).bit_length(), 6), RANGES.bit_length() - 1)
    likely = gathered(spark, bit_map(leads, F.col("lead"), bits), bits)
    phrases = count_phrases(texts, known, likely, longest, counters, bits, chunk, min_count, ranges)
    grams = durable(phrases.select("lang", "size", "phrase", "n").unionByName(words.select("lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), "n")))
    discard(leads)
    return grams, langs


def key_of(lang: Column, phrase: Column) -> Column:
    """Language and phrase as one key: phrases have no line ends."""
    return F.concat(lang, F.lit("\n"), phrase)


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100, top: int = 2000, share: int = 100, counters: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """The first `top` collocations of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Candidates are the phrases of 2 to `longest` words that occur a >= min_count times. Cut after its first k words, a candidate has
    l and r, how often its two parts occur, and the score floor(1000 * a * n / (l * r)), n being the language's words; the
    lowest-scoring cut counts (ties: the smallest k). Candidates within a longer candidate that occurs at least `share`
    per cent as often are left out. Order: score, a (descending), phrase (by bytes). Products are exact up to 38 digits.
    What texts, nulls, repeated rows and other columns mean is said at `frequent_phrases`. Empty input: no rows.
    """
    grams, langs = frequent_phrases(docs, text_col, lang_col, longest, min_count, counters, chunk)
    grams = grams.withColumn("key", key_of(F.col("lang"), F.col("phrase")))
    words = F.split("phrase", " ", -1)
    candidates = grams.where("size >= 2").withColumn("words", words)
    joined = lambda begin, n: key_of(F.col("lang"), F.array_join(F.slice("words", begin, n), " "))
    cut = lambda k: F.array(F.struct(k.alias("k"), F.lit("l").alias("side"), joined(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit("r").alias("side"), joined(k + 1, F.col("size") - k).alias("part")))
    cuts = candidates.select("key", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut))).alias("cut")).select("key", "cut.*")
    found = attach(cuts, grams.where(F.col("size") < longest).select(F.col("key").alias("part"), "n"), "part", "n")
    inner = lambda size: F.transform(F.sequence(F.lit(1), F.col("size") - size + 1), lambda begin: joined(begin, size))
    within = candidates.where("size >= 3").select(F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), inner))).alias("key"), F.col("n").alias("longer"))
    columns = [f"{side}{k}" for k in range(1, longest) for side in "lr"]
    none = F.lit(None).cast("long")
    rows = candidates.select("key", F.col("n").alias("a"), none.alias("longer"), *[none.alias(c) for c in columns])
    rows = rows.unionByName(within.groupBy("key").agg(F.max("longer").alias("longer")), allowMissingColumns=True)
    rows = rows.unionByName(found.select("key", *[F.when((F.col("k") == int(c[1:])) & (F.col("side") == c[0]), F.col("n")).alias(c) for c in columns]), allowMissingColumns=True)
    one = rows.groupBy("key").agg(*[F.max(c).alias(c) for c in ("a", "longer", *columns)])
    one = one.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    phrase = F.substring_index("key", "\n", -1)
    one = one.select(F.substring("key", F.lit(1), F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "a", *columns)
    one = attach(one, langs, "lang", "n")
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    scores = [f"if(l{k} IS NULL OR r{k} IS NULL, NULL, struct({wide(1000)} * {wide('a')} * {wide('n')} div ({wide(f'l{k}')} * {wide(f'r{k}')}) AS score, {k} AS k, l{k} AS l, r{k} AS r))" for k in range(1, longest)]
    scored = one.withColumn("best", F.expr(f"array_min(array({', '.join(scores)}))")).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").cast("long").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
