from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "alpha", "beta", "gamma", "delta", "house", "river", "stone", "light", "cloud", "green", "seven", "north", "water", "fire", "wind", "earth", "moon", "star"]


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Documents with nulls in every column, empty and long texts, copies, near copies, repeated rows and shared lines."""
    rnd = random.Random(3)
    out = []
    for i in range(80):
        text = "\n".join(sentence(rnd, rnd.randint(3, 30)) for _ in range(rnd.randint(1, 4)))
        out.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None]), len(text)))
    base = sentence(rnd, 200)
    out += [(100 + k, base.replace(" of ", " ", k), "en", "a", 1) for k in range(4)]  # near copies
    out += [(110 + k, out[3][1], "en", "b", None) for k in range(5)]  # copies
    out += [(120 + k, f"Shared LINE here\t\n{sentence(rnd, 8)}\n  shared line HERE", None, "hot", 5) for k in range(14)]  # a line in many
    out += [(140, None, "en", "a", None), (141, "", "en", "a", 0), (142, " \t\n ", None, None, 4), (143, "1234 !!", "en", "c", 7), (144, "one", "en", "c", 3)]
    out += [(None, "a row without an id and some words", "en", "a", 9), (None, None, None, None, None)]
    out += [(150, sentence(rnd, 30000), "en", "b", 0)]  # long
    out += [out[5], out[5], out[100]]  # repeated rows
    out += [(160, "café naïve 日本語 \U0001f600 <|im_end|> it's DON'T́", "fr", "d", 30)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash(docs):
    """The same with columns that have the operators' own names."""
    from pyspark.sql import functions as F

    names = "size SOURCE_SIZE target copies taken kept group_size shard place vslot n_lines N_dropped lang_pred score code_bits n_tokens ids decoded host path rule verdict mined n_words base_failed w t tie id text2 _tie p cid root".split()
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
