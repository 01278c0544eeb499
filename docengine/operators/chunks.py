"""Sections and chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of sections that aren't chunked, sizes in characters
SKIPPED_KINDS = ("declaration", "parameters", "parameter", "returnvalue", "return value", "attributes", "availability")
ANCHOR_CHARS, MOST_CHUNKS, WINDOW_CHARS, OVERLAP_CHARS = 1200, 8, 880, 160


def windows(text: Column, size: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS, most: int | None = None) -> Column:
    """Windows of a text, each beginning size - overlap after the one before; the last one ends the text. `most`: as many are made."""
    step = max(1, size - overlap)
    n = F.when(F.length(text) <= size, 1).otherwise(F.ceil((F.length(text) - size) / F.lit(step)).cast("int") + 1)
    n = n if most is None else F.least(n, F.lit(most))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def anchor(title: Column, abstract: Column, headings: Column) -> Column:
    some = F.filter(F.array(title, abstract, headings), lambda x: x.isNotNull() & (x != ""))
    return F.substring(F.concat_ws(". ", some), 1, ANCHOR_CHARS)


def chunk(docs: DataFrame, sections: DataFrame, most: int = MOST_CHUNKS, size: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(document_id, ord, text): the anchor, then windows of the sections in order, `most` chunks at most.

    Sections of skipped kinds, REST ones, empty ones and an abstract that the document has already are left out.
    """
    kind = F.lower(F.coalesce("section_kind", F.lit("")))
    s = sections.join(docs.select(F.col("id").alias("document_id"), F.coalesce("abstract", F.lit("")).alias("_abstract")), "document_id")
    s = s.where(~kind.isin(*SKIPPED_KINDS) & ~kind.startswith("rest") & ~((kind == "abstract") & (F.col("_abstract") != "")))
    body = F.trim(F.coalesce("content_text", F.lit("")))
    text = F.concat(F.when(F.col("heading") != "", F.concat("heading", F.lit(". "))).otherwise(""), body)
    pieces = s.where(body != "").select("document_id", "sort_order", F.posexplode(windows(text, size, overlap, most)).alias("at", "text"))
    w = Window.partitionBy("document_id").orderBy("sort_order", "at")
    rest = pieces.select("document_id", F.row_number().over(w).alias("ord"), "text").where(F.col("ord") < most)
    first = docs.select(F.col("id").alias("document_id"), F.lit(0).alias("ord"), anchor(F.col("title"), F.col("abstract"), F.col("headings")).alias("text"))
    return first.union(rest)


def split_sections(docs: DataFrame, text: str = "body", level: int = 2) -> DataFrame:
    """(id, sort_order, heading, content) of Markdown bodies at headings of a level; what is before the first has none."""
    mark = "#" * level
    parts = F.filter(F.split(F.col(text), f"(?m)^(?={mark} +\\S)"), lambda p: F.trim(p) != "")
    rows = docs.select("id", F.posexplode(parts).alias("sort_order", "part"))
    head = F.regexp_extract("part", f"^{mark} +([^\\n]+)", 1)
    return rows.select("id", "sort_order", F.when(head != "", F.trim(head)).alias("heading"), F.btrim(F.regexp_replace("part", f"^{mark} +[^\\n]+", ""), F.lit(" \t\n\r")).alias("content"))


def body_preview(docs: DataFrame, sections: DataFrame, chars: int = 500) -> DataFrame:
    """(id, key, letter, preview): the first characters of the sections' text in order, and the shard's letter.

    A section is only read up to the preview's length, so that long ones aren't gathered.
    """
    part = sections.where(F.col("content_text") != "").select("document_id", "sort_order", F.substring("content_text", 1, chars).alias("t"))
    w = Window.partitionBy("document_id").orderBy("sort_order").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_before", F.coalesce(F.sum(F.length("t") + 1).over(w), F.lit(0))).where(F.col("_before") <= chars + 1)
    text = part.groupBy("document_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "t"))), lambda x: x["t"])).alias("t"))
    letter = F.regexp_replace(F.lower(F.substring(F.coalesce("framework", F.lit("")), 1, 1)), "[^a-z]", "_")
    rows = docs.join(text, docs.id == text.document_id)
    return rows.select("id", "key", F.when(letter == "", "_").otherwise(letter).alias("letter"), F.substring(F.trim("t"), 1, chars).alias("preview")).where("preview <> ''")


def find_section(sections: DataFrame, wanted: str) -> DataFrame:
    """The section that a name means, one for each document: its heading, the end of one, its kind, else one whose text has it."""
    low = wanted.strip().lower()
    h, k = F.lower(F.trim(F.coalesce("heading", F.lit("")))), F.lower(F.coalesce("section_kind", F.lit("")))
    rank = F.when(h == low, 0).when(h.endswith(low) & (h != ""), 1).when(k == low, 2).when(F.lower(F.coalesce("content_text", F.lit(""))).contains(low), 3)
    w = Window.partitionBy("document_id").orderBy("_rank", "sort_order")
    return sections.withColumn("_rank", rank).where("_rank is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_rank")


def render_plain(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, text): what the body index holds of each document."""
    from ..functions.text import plain_text

    s = sections.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "heading", "content_text"))).alias("s"))
    rows = docs.join(s, docs.id == s.document_id, "left")
    return rows.select("id", plain_text(F.col("title"), F.col("abstract"), F.col("declaration"), F.col("headings"), F.coalesce("s", F.array().cast("array<struct<sort_order:int,heading:string,content_text:string>>"))).alias("text"))
