"""Language identification by prediction by partial matching (PPM).

Each language has byte contexts of orders 0 to 3 with frozen counts. A byte's code length comes from
the longest known context that has seen the byte; each known context that has not costs an escape (method C:
its distinct bytes against all its bytes), and below order 0 all 256 bytes are as likely. A text's language
is the one whose model gives the whole text the shortest code.

The models are fitted on a bounded sample of labelled rows. As the counts are frozen, a byte's cost is a
function of it and the three bytes before it; the costs of all such windows of the sample are laid out
in one table for all languages, and other windows are worked out once per batch. Costs are whole numbers
of 1/1024 bit, so that sums don't depend on how texts are cut into pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, durable, fresh, release, ship

ORDER = 3
#: Bounds of what the models are fitted on: rows of each language (those with the smallest hashes), bytes of each
#: language, bytes of a text that is learned from, and languages.
SAMPLE_ROWS, SAMPLE_BYTES, TEXT_BYTES, LANGUAGES = 800, 4 << 20, 1 << 20, 250
#: Bytes of all languages' samples together, at most: what the driver gathers.
TOTAL_BYTES = 128 << 20
#: Cost unit: parts of a bit.
UNIT = 1024
#: What stands before a text.
PAD = b"\n" * ORDER
_PIECE, _SLOTS = 1 << 18, 22


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def windows(data: np.ndarray) -> np.ndarray:
    """Four-byte windows as numbers, the first byte highest; the first ends at the fourth byte."""
    d = data.astype(np.uint32)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


class Model:
    """Frozen context trees of several languages."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.langs = sorted(texts)
        self.trees = [self._tree(texts[lang]) for lang in self.langs]
        seen = [np.unique(t[ORDER][0]) for t in self.trees]
        self.known = np.unique(np.concatenate(seen)).astype(np.uint32) if seen else np.zeros(0, np.uint32)
        self.costs = [self._costs(t, self.known) for t in self.trees]
        # a direct table; of windows that share a slot one is in it, the others are searched for
        self.table = np.zeros(1 << _SLOTS, np.int32)
        self.table[self._slot(self.known)] = np.arange(len(self.known), dtype=np.int32)

    @staticmethod
    def _slot(w: np.ndarray) -> np.ndarray:
        return (w * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)

    @staticmethod
    def _tree(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: context-and-byte codes and their costs, contexts and their escape costs."""
        data = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8)
        w = windows(data)
        ends = np.cumsum([len(t) + ORDER for t in texts])
        real = np.ones(len(data), bool)
        for k in range(ORDER):
            real[np.r_[0, ends[:-1]] + k] = False
        w = w[real[ORDER:]]
        out = []
        for d in range(ORDER + 1):
            code, n = np.unique(w & np.uint32((1 << (8 * (d + 1))) - 1), return_counts=True)
            context, start = np.unique(code >> 8, return_index=True)
            total, distinct = np.add.reduceat(n, start), np.diff(np.r_[start, len(code)])
            bits = -np.log2(n / np.repeat(total + distinct, distinct))
            escape = -np.log2(distinct / (total + distinct))
            out.append((code, np.rint(bits * UNIT).astype(np.int64), context, np.rint(escape * UNIT).astype(np.int64)))
        return out

    @staticmethod
    def _costs(tree: list, w: np.ndarray) -> np.ndarray:
        """The costs of windows in one language."""
        cost, open_ = np.zeros(len(w), np.int64), np.ones(len(w), bool)
        for d in range(ORDER, -1, -1):
            codes, bits, contexts, escapes = tree[d]
            code = w & np.uint32((1 << (8 * (d + 1))) - 1)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = open_ & (codes[at] == code)
            cost[hit] += bits[at[hit]]
            open_ &= ~hit
            at = np.minimum(np.searchsorted(contexts, code >> 8), len(contexts) - 1)
            missed = open_ & (contexts[at] == code >> 8)
            cost[missed] += escapes[at[missed]]
        cost[open_] += 8 * UNIT
        return cost.astype(np.int32)

    def add(self, data: np.ndarray, begins: np.ndarray, into: np.ndarray) -> None:
        """Adds the code lengths of pieces; piece i's windows start at begins[i] of windows(data), with PAD or what is before in front.

        into: a row per language; windows that reach over a piece's begin are counted out by the caller's layout.
        """
        w = windows(data)
        at = self.table[self._slot(w)]
        miss = np.flatnonzero(self.known[at] != w)
        if len(miss):
            new, back = np.unique(w[miss], return_inverse=True)
            found = np.minimum(np.searchsorted(self.known, new), len(self.known) - 1)
            lost = self.known[found] != new
            at[miss] = np.where(lost, len(self.known) + np.cumsum(lost) - 1, found)[back]
        for row, costs, tree in zip(into, self.costs, self.trees, strict=True):
            if len(miss) and lost.any():
                costs = np.concatenate([costs, self._costs(tree, new[lost])])
            row += np.add.reduceat(costs[at].astype(np.int64), begins)[::2]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in parts of a bit: a row per language, a column per text; of whole texts."""
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        i = 0
        while i < len(texts):
            if len(texts[i]) > _PIECE:  # in pieces, each with the bytes before it in front
                whole = PAD + texts[i]
                for k in range(0, len(texts[i]), _PIECE):
                    self.add(np.frombuffer(whole[k : k + _PIECE + ORDER], np.uint8), np.array([0]), out[:, i : i + 1])
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and size + len(texts[j]) <= _PIECE and texts[j]:
                size += len(texts[j]) + ORDER
                j += 1
            if j > i:
                data = np.frombuffer(b"".join(PAD + t for t in texts[i:j]), np.uint8)
                lengths = np.array([len(t) for t in texts[i:j]])
                begin = np.cumsum(lengths + ORDER) - lengths - ORDER
                # after each text come the windows that end in the next one's padding; every other sum is a text's
                pairs = np.stack([begin, begin + lengths], 1).ravel()[:-1]
                self.add(data, pairs, out[:, i:j])
            i = max(j, i + (not texts[i]))
        return out


def fit(
    docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, text_bytes: int = TEXT_BYTES, languages: int = LANGUAGES, total_bytes: int = TOTAL_BYTES
) -> Model:
    """Models of all languages that rows with `train` name; whole texts of sample_rows rows for each, at most.

    The sample is bounded whatever the input: sample_rows rows and sample_bytes bytes of each language (total_bytes shared evenly,
    where languages are many), of texts of text_bytes at most; more than `languages` languages are an error. Rows that repeat an id
    and text are one. Null languages and texts without a letter teach nothing. Rows are chosen by hashes: below a threshold for each
    language, which the number of its distinct usable rows (estimated within a few per cent) sets so that some four times the sample
    remain in all tasks together, then the smallest; only the texts chosen are gathered.
    """
    lang, text = F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(lang, text, F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    rows = rows.where((F.octet_length("text") <= text_bytes) & has_letter(F.col("text")))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("count")).limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    if not counts:
        return Model({})
    sample_bytes = min(sample_bytes, total_bytes // len(counts))
    most = (1 << 63) - 1
    limits = [(r["lang"], min(most, int((4 * sample_rows + 100) / r["count"] * 2 * most) - most)) for r in counts]
    limits = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, most long"))
    usable = rows.join(limits, "lang").where(F.col("h") <= F.col("most"))
    each = usable.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("bytes"))
    order = Window.partitionBy("lang").orderBy("h")
    each = each.withColumns({"k": F.row_number().over(order), "upto": F.sum("bytes").over(order)})
    chosen = durable(each.where((F.col("k") <= sample_rows) & (F.col("upto") <= sample_bytes)).select("lang", "h"))
    texts: dict[str, list[bytes]] = {}
    # a row for each hash, however often it repeats
    for r in usable.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    discard(chosen)
    return Model(texts)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with the columns lang_pred, score and code_bits (of the whole text, under the best model).

    lang_pred is `und`, with score 0, if the text is null or has no letter, or no language was learned.
    score is the share of code length that the best language saves against the next best (1 if there is
    only one): 0 to 1. Equal code lengths go to the first language in order of code points. The columns
    get underscores in front where docs has such names. Repeated rows are judged alike; texts of any length are scored
    whole, piece by piece. Empty input: empty result.
    """
    ship(docs.sparkSession)
    names = fresh(docs.columns, "lang_pred", "score", "code_bits")
    (letters,) = fresh([*docs.columns, *names], "_letters")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            usable = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            pred, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if m.langs:
                lengths = m.code_lengths([t if u else b"" for t, u in zip(texts, usable, strict=True)])
                best = lengths.argmin(0)
                least = lengths.min(0)
                second = np.partition(lengths, 1, axis=0)[1] if len(m.langs) > 1 else np.full(len(texts), np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(usable, np.where(np.isinf(second), 1.0, 1 - least / second), 0.0)
                bits = np.where(usable, least / UNIT, np.nan)
                pred = [m.langs[b] if u else "und" for b, u in zip(best, usable, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(bits, pa.float64(), from_pandas=True)], names=schema.names)
        release()

    return docs.withColumn(letters, has_letter(F.col(text_col))).mapInArrow(run, schema)
