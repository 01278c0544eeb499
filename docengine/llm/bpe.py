"""BPE encoding and decoding with forced boundaries.

A pair of bytes that occurs inside no vocabulary token can never be joined by a merge, so a text may
be cut between them for certain: white space is in no token at all, letters meet punctuation in none, and
within words some pairs never meet either. Texts are cut at the tokenizer's own word pattern, words
at the pairs that no token has, pieces are encoded independently and their ids concatenated. Each distinct
word is encoded once and kept in a table of bounded size. Only the last piece of a word carries the
word-end mark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, release, ship

#: Distinct words that a worker keeps, in two generations, and the characters of the longest of them.
CACHED, CACHED_CHARS = 80_000, 64
#: Texts of these characters alone are normalised here: all are composed already, no mark can join them, and
#: lower case depends on no neighbour. (Space and 9 to 13, then printable ASCII and Latin up to U+02AF.)
_PLAIN = re.compile("[\\t-\\r -~\u00a1-\u00ac\u00ae-\u02af]*")
_KEPT: dict[str, "ForcedBoundaryBpe"] = {}


def byte_characters() -> list[str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for characters from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encodes as the tokenizers library does with a word-level BPE file, without special tokens added."""

    def __init__(self, config: str) -> None:
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(config)
        spec["truncation"] = spec["padding"] = None
        self.tok = Tokenizer.from_str(json.dumps(spec))
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        inner = json.loads(json.dumps(spec))
        inner["model"]["end_of_word_suffix"] = None
        self.within, self.last = Tokenizer.from_str(json.dumps(inner)).model, self.tok.model
        self.normalizer, self.pre_tokenizer = self.tok.normalizer, self.tok.pre_tokenizer
        # the plain way holds for this kind of file alone; others go through the library's own steps
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) else None
        self.alphabet = byte_characters()
        self.tokens = {i: b" " + t.encode() for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.pairs = set()
        for token in spec["model"]["vocab"]:
            word = token.removesuffix(self.end) if self.end else token
            self.pairs.update(map("".join, zip(word, word[1:], strict=False)))
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def pieces(self, word: str) -> list[str]:
        """A word (in the byte-level alphabet), cut at pairs that no token has."""
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def word(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a word in the byte-level alphabet as 32-bit numbers, and its tokens, each with a space before it."""
        *first, last = self.pieces(word)
        ids = [t.id for piece in first for t in self.within.tokenize(piece)] + [t.id for t in self.last.tokenize(last)]
        return b"".join([i.to_bytes(4, "little") for i in ids]), b"".join([self.tokens[i] for i in ids])

    def missing(self, plain: str) -> tuple[bytes, bytes]:
        """A word that is not in the young generation of the table."""
        out = self.old.get(plain)
        if out is None:
            out = self.word("".join([self.alphabet[b] for b in plain.encode()]))
        if len(plain) <= CACHED_CHARS:
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            self.young[plain] = out
        return out

    def segment(self, text: str) -> list[tuple[bytes, bytes]]:
        """Text without special tokens, word by word."""
        if self.words and _PLAIN.fullmatch(text):
            get, missing = self.young.get, self.missing
            known = self.young
            out = []
            for w in self.words(text.lower()):
                out.append(get(w) or missing(w))
                if known is not self.young:
                    known, get = self.young, self.young.get
            return out
        normal = self.normalizer.normalize_str(text) if self.normalizer else text
        return [self.word(w) for w, _ in self.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids and decoded text (the tokens, joined by spaces) of a whole text."""
        parts, begin = [], 0
        if "<|" in text or not self.words:
            for m in self.specials.finditer(text):
                parts += self.segment(text[begin : m.start()])
                i = self.special[m[0]]
                parts.append((i.to_bytes(4, "little"), self.tokens[i]))
                begin = m.end()
        parts += self.segment(text[begin:] if begin else text)
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])[1:]


def shared_bpe(config: str) -> ForcedBoundaryBpe:
    """One encoder for each worker process, so that later tasks find its table filled."""
    if config not in _KEPT:
        _KEPT.clear()
        _KEPT[config] = ForcedBoundaryBpe(config)
    return _KEPT[config]


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """docs with the columns n_tokens, ids (32-bit little-endian numbers) and, with decode, decoded.

    Null and empty texts have no tokens. The vocabulary file is read on the driver and sent to the
    workers (a few MB, as the tokenizer has). The columns get underscores in front where docs has such
    names. Empty input: empty result.
    """
    ship(docs.sparkSession)
    names = fresh(docs.columns, "n_tokens", "ids", "decoded")[: 2 + decode]
    with open(tokenizer_path, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = (T.LongType(), T.BinaryType(), T.StringType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=False)]])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(config.value)
        for batch in batches:
            column = batch.column(at)
            step = max(1, min(len(column), 500))
            for k in range(0, len(column), step):
                done = [bpe.encode(t or "") for t in column[k : k + step].to_pylist()]
                new = [pa.array([len(i) // 4 for i, _ in done], pa.int64()), pa.array([i for i, _ in done], pa.binary())]
                if decode:
                    new.append(pa.array([d for _, d in done], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(k, step).columns, *new], names=schema.names)
        release()

    return docs.mapInArrow(run, schema)
