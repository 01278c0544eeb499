"""The corpus pipeline: stages over documents, each written and read again as Parquet.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bpe, language_id, line_dedup, mixing, ngram_join
from docengine.llm.common import delete_folder, shared_dir
from docengine.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: those without a letter (null and empty texts too), and none else.

    Rows whose lang is null are judged, but teach nothing; if no row has one, all go. Repeated rows are judged alike. Columns of docs
    may have any names. Empty input: empty result.
    """
    model = language_id.fit(docs, F.lit(True))
    out = language_id.identify(docs, model)
    return out.where(F.col(out.columns[len(docs.columns)]) != "und").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that ten documents or more have out of all of them, and counts n_chars anew.

    No row goes; a document of such lines alone is left with an empty text, and null texts become empty. Repeated rows are documents
    of their own. Texts are split whole, however long. Empty input: empty result.
    """
    out = line_dedup.dedup_lines(docs, min_docs=10)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest id (null last), then of the smallest hash of its text.

    Documents without words (empty after the stage before) are near to none and stay. Of repeated rows one stays. Empty input:
    empty result.
    """
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their weights; documents that the mix takes twice come twice, those that it doesn't take go.

    A null source is a source of its own; texts without words are never taken; repeated rows are taken together. Empty input:
    empty result.
    """
    mixed = mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2)
    return mixing.repeat(mixed, docs.columns, mixed.columns[len(docs.columns) + 3])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (32-bit little-endian numbers) of each row of the mix, and the hash of the text decoded from them.

    Null and empty texts have no tokens; texts are encoded whole. Rows that come twice are encoded twice. Empty input: empty result.
    """
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", tokenize),
]

#: SQL can't express the stages' models and samples; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents on. Each stage's table is deleted once the next one has been written."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return docs
