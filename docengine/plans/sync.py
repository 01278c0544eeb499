"""Ingest: adapters' bundles into the stored corpus, step by step; each step is a function of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DOCUMENT, RELATION, SECTION
from ..operators.chunks import render_plain
from ..operators.maintenance import replace_children, upsert
from ..session import durable
from ..sources.base import SourceAdapter, validate
from ..sources.versions import VersionedTables


@dataclass
class Stored:
    documents: DataFrame
    sections: DataFrame
    relationships: DataFrame


def empty(spark: SparkSession) -> Stored:
    sections = spark.createDataFrame([], "key string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SECTION))
    return Stored(spark.createDataFrame([], DOCUMENT).withColumn("content_hash", F.lit(None).cast("string")), sections, spark.createDataFrame([], RELATION))


def merge(stored: Stored, bundles: DataFrame) -> Stored:
    """Upserts documents and replaces their sections and edges; documents whose content is the same stay untouched.

    The bundles that change something are written to the shared folder, so that they are worked out once for all three tables and for
    the merges that follow; the tables are read lazily, so the folder is the cluster's to clear.
    """
    b = validate(bundles).withColumn("content_hash", F.sha2(F.to_json(F.struct("document", "sections", "relationships")), 256))
    known = stored.documents.select(F.col("key").alias("_k"), F.col("content_hash").alias("_h"))
    b = b.join(known, (b.document.key == F.col("_k")) & (b.content_hash == F.col("_h")), "left_anti")
    b = durable(b)
    docs = b.select("document.*", "content_hash")
    sections = b.select(F.col("document.key").alias("key"), F.explode("sections").alias("s")).select("key", "s.*")
    edges = b.select(F.explode("relationships").alias("r")).select("r.*")
    kept = stored.sections.join(docs.select("key"), "key", "left_anti")
    old = stored.relationships.join(docs.select(F.col("key").alias("from_key")), "from_key", "left_anti")
    return Stored(
        upsert(stored.documents, docs, "key"),
        kept.unionByName(replace_children(sections.limit(0), sections, "key", ("key", "section_kind", "sort_order"), "sort_order")),
        old.unionByName(replace_children(edges.limit(0), edges, "from_key", ("from_key", "to_key", "relation_type"), "sort_order").select(*old.columns)),
    )


def sync(spark: SparkSession, stored: Stored, adapters: dict[str, tuple[SourceAdapter, str]]) -> tuple[Stored, dict[str, str]]:
    """All adapters over their folders; one that fails is reported and leaves the others' work."""
    errors: dict[str, str] = {}
    for name, (adapter, path) in adapters.items():
        try:
            bundles = adapter.normalize(adapter.read(spark, path)).persist()
            bundles.count()
        except Exception as e:  # noqa: BLE001 - isolated and reported
            errors[name] = str(e).split("\n")[0]
            continue
        stored = merge(stored, bundles)
    return stored, errors


def load(store: VersionedTables, version: int | None = None) -> Stored:
    """The corpus as it was committed; an empty one before the first version."""
    found = [store.read(name, version) for name in ("documents", "sections", "relationships")]
    return empty(store.spark) if found[0] is None else Stored(*found)


def sync_committed(store: VersionedTables, adapters: dict[str, tuple[SourceAdapter, str]], run: str) -> dict[str, str]:
    """The same with a committed version after each adapter: documents, sections and edges change together or not at all.

    `run` names the run: begun again under its name after a failure, it leaves out the adapters that it has committed. Returns
    the errors of adapters that failed.
    """
    errors: dict[str, str] = {}
    for name, (adapter, path) in adapters.items():
        if store.done(name) == run:
            continue
        base = store.manifest()["version"]
        stored, failed = sync(store.spark, load(store, base), {name: (adapter, path)})
        errors |= failed
        if not failed:
            store.commit({"documents": stored.documents, "sections": stored.sections, "relationships": stored.relationships}, (name, run), base)
    return errors


def body_index(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, text) of what the body index holds."""
    d = documents.select(F.col("key").alias("id"), "title", F.col("abstract_text").alias("abstract"), F.col("declaration_text").alias("declaration"), "headings")
    return render_plain(d, sections.withColumnRenamed("key", "document_id"))
