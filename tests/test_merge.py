from __future__ import annotations

from pyspark.sql import functions as F

from docengine.model import BUNDLE
from docengine.plans import sync


def test_bundles_are_worked_out_once(spark):
    """Two merges, and what reads all their tables: each bundle is made once, not for each table and merge that needs it."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    def bundles(title):
        values = {"key": F.concat(F.lit("k"), F.col("id").cast("string")), "title": title, "source_type": F.lit("packages"), "kind": F.lit("article")}
        doc = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BUNDLE["document"].dataType])
        part = F.struct(F.lit("abstract").alias("section_kind"), F.lit(None).cast("string").alias("heading"), F.lit("x").alias("content_text"), F.lit(None).cast("string").alias("content_json"), F.lit(0).alias("sort_order"))
        rows = spark.range(40).mapInArrow(count, "id long")
        return rows.select(doc.alias("document"), F.array(part).cast(BUNDLE["sections"].dataType).alias("sections"), F.array().cast(BUNDLE["relationships"].dataType).alias("relationships"))

    stored = sync.merge(sync.empty(spark), bundles(F.lit("one")))
    stored = sync.merge(stored, bundles(F.when(F.col("id") % 2 == 0, "two").otherwise("one")))
    got = sorted((r["title"], r["n"]) for r in stored.documents.groupBy("title").agg(F.count("*").alias("n")).collect())
    assert got == [("one", 20), ("two", 20)] and stored.sections.count() == 40 and stored.relationships.count() == 0
    assert made.value == 80
