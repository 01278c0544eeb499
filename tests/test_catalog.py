from __future__ import annotations

from pyspark.sql import functions as F

from docengine.operators.catalog import scope_label


def test_guidelines_are_grouped_by_their_key(spark):
    """Only a guideline's key has its section; a title that begins with a number says nothing."""
    rows = [
        ("guidelines", "app-store-review/1.2", "4 Other", "1"), ("guidelines", "app-store-review/10", "x", "10"), ("guidelines", "app-store-review/3.1.1(a)", None, "3"),
        ("guidelines", "src1/en/7", "41 words of prose", None), ("guidelines", "app-store-review/about", "12. Title", None), ("hig", "design/menus", "1 x", "menus"),
    ]
    df = spark.createDataFrame(rows, "source_type string, key string, title string, want string").withColumn("meta", F.lit(None).cast("string"))
    got = df.select("key", "want", scope_label(F.col("source_type"), F.col("key"), F.col("meta")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_prose_that_begins_with_a_number(spark, tmp_path):
    """The query over documents whose first line begins with a number: its SQL has no label for them."""
    from docengine.queries import QUERIES

    kinds = 12
    text = F.lit("41 words of prose\nb\nc")
    spark.range(kinds).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["label"] for r in QUERIES["scope_label"](spark, str(tmp_path)).collect()}
    assert "41" not in got and "en" in got
