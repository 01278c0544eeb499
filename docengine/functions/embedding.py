"""Tokens and embeddings: a BERT-style normaliser, greedy WordPiece, and embedders that are passed in."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship


def normalize(text: str) -> str:
    """Control characters out, white space to spaces, spaces around CJK, lower case without accents."""
    out = []
    for c in text:
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind == "Zs":
            out.append(" ")
        elif c in "\0�" or kind in ("Cc", "Cf"):
            continue
        elif 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0x20000 <= ord(c) <= 0x2CEAF or 0xF900 <= ord(c) <= 0xFAFF:
            out.append(f" {c} ")
        else:
            out.append(c)
    return "".join(c for c in unicodedata.normalize("NFD", "".join(out)) if unicodedata.category(c) != "Mn").lower()


def pre_tokenize(text: str) -> list[str]:
    """Words, and each punctuation mark by itself."""
    marks = {c for c in set(text) if unicodedata.category(c).startswith("P") or (c.isascii() and c.isprintable() and not c.isalnum() and c != " ")}
    return "".join(f" {c} " if c in marks else c for c in text).split()


def word_pieces(word: str, vocabulary: Mapping[str, int], unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """The longest piece first, then longest pieces with ## in front; a word that can't be covered is unknown."""
    if len(word) > longest:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            return [unknown]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def tokenize(text: str, vocabulary: Mapping[str, int]) -> list[int]:
    """Ids without special tokens; unknown pieces are left out if the vocabulary has no [UNK]."""
    pieces = (p for w in pre_tokenize(normalize(text)) for p in word_pieces(w, vocabulary))
    return [vocabulary[p] for p in pieces if p in vocabulary]


class StaticEmbedder:
    """Rows of a matrix for a text's tokens, their mean, normalised; texts without tokens get the padding row."""

    def __init__(self, vocabulary: Mapping[str, int], rows: np.ndarray, padding: str = "[PAD]") -> None:
        self.vocabulary, self.rows, self.padding = dict(vocabulary), np.asarray(rows, np.float32), padding

    def __call__(self, text: str) -> list[float]:
        ids = tokenize(text, self.vocabulary) or [self.vocabulary[self.padding]]
        mean = self.rows[ids].mean(0)
        norm = float(np.linalg.norm(mean))
        return (mean / norm if norm else mean).tolist()


def hashing_embedder(dims: int = 64) -> Callable[[str], list[float]]:
    """A deterministic embedder without a model: each word's hash gives signs, which are summed and normalised."""

    def embed(text: str) -> list[float]:
        total = np.zeros(dims, np.float32)
        for w in pre_tokenize(normalize(text)):
            bits = np.unpackbits(np.frombuffer(hashlib.blake2b(w.encode(), digest_size=dims // 8).digest(), np.uint8))
            total += bits.astype(np.float32) * 2 - 1
        norm = float(np.linalg.norm(total))
        return (total / norm if norm else total).tolist()

    return embed


#: Embedders by name; others are added here.
EMBEDDERS: dict[str, Callable[[], Callable[[str], Sequence[float]]]] = {"hashing": hashing_embedder}


def embed(text: Column, embedder: Callable[[str], Sequence[float]], session=None) -> Column:
    """Vectors of a text column, in Arrow batches."""
    if session is not None:
        ship(session)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(embedder(t or "")))

    return run(text)
