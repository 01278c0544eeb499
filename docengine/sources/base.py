"""Source adapters: files of a kind to canonical bundles of document, sections and relationships."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BUNDLE, SOURCE_TYPES

MODES = ("crawl", "flat", "snapshot")


class SourceAdapter(ABC):
    """A pluggable source. All methods take and give DataFrames; nothing is fetched from a network.

    discover gives keys; read the raw payloads (key, payload, etag); check compares stored rows with read ones;
    normalize turns payloads into bundles; references gives the keys that payloads point to.
    """

    source_type: str
    display_name: str
    mode: str = "flat"

    def discover(self, spark: SparkSession, path: str) -> DataFrame:
        return self.read(spark, path).select("key")

    @abstractmethod
    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """(key, payload, etag)"""

    @abstractmethod
    def normalize(self, raw: DataFrame) -> DataFrame:
        """(document, sections, relationships)"""

    def check(self, stored: DataFrame, raw: DataFrame) -> DataFrame:
        """(key, status): unchanged, modified, deleted or new, by etag."""
        a, b = stored.select("key", F.col("etag").alias("_a"), F.lit(True).alias("_s")), raw.select("key", F.col("etag").alias("_b"), F.lit(True).alias("_r"))
        status = F.when(F.col("_r").isNull(), "deleted").when(F.col("_s").isNull(), "new").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified")
        return a.join(b, "key", "full_outer").select("key", status.alias("status"))

    def references(self, raw: DataFrame) -> DataFrame:
        return self.normalize(raw).select(F.explode("relationships").alias("r")).select("r.from_key", "r.to_key").distinct()


_REGISTRY: dict[str, SourceAdapter] = {}


def register(adapter: SourceAdapter) -> SourceAdapter:
    if not isinstance(adapter, SourceAdapter):
        raise TypeError("an adapter is an instance of SourceAdapter")
    if adapter.source_type not in SOURCE_TYPES or adapter.mode not in MODES:
        raise ValueError(f"unknown source type or mode: {adapter.source_type}, {adapter.mode}")
    _REGISTRY[adapter.source_type] = adapter
    return adapter


def adapter(source_type: str) -> SourceAdapter:
    return _REGISTRY[source_type]


def adapters() -> dict[str, SourceAdapter]:
    return dict(_REGISTRY)


def validate(bundles: DataFrame) -> DataFrame:
    """Bundles with a string key; others are left out."""
    if [f.name for f in bundles.schema.fields] != BUNDLE.names:
        raise ValueError(f"bundles have the columns {BUNDLE.names}")
    return bundles.where(F.col("document.key").isNotNull() & (F.col("document.key") != ""))


def whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(key, payload, etag) of files below a folder: keys are paths without the ending, etags hashes of what is in them."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.input_file_name().alias("_f"), F.col("value").alias("payload"))
    root = F.lit(path.rstrip("/").split("/")[-1] + "/")
    key = F.regexp_replace(F.substr("_f", F.call_function("instr", F.col("_f"), root) + F.length(root)), r"\.[A-Za-z0-9]+$", "")
    return rows.select(F.try_url_decode(key).alias("key"), "payload", F.sha2("payload", 256).alias("etag"))
