"""Counts and rollups over the corpus: taxonomy, facets, progress, freshness, links, storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAXONOMY_FIELDS = {"kind": "doc_kind", "role": "role", "docKind": "doc_kind", "roleHeading": "role_heading", "sourceType": "source_type"}
STALE_DAYS = 14
# Relations that are counted, by the name they are shown by
RELATION_NAMES = {"child": "children", "inherits_from": "inheritsFrom", "conforms_to": "conformsTo", "inherited_by": "inheritedBy", "see_also": "seeAlso"}


def taxonomy(docs: DataFrame, field: str | None = None, limit: int | None = 20) -> DataFrame:
    """(field, value, count) of values that aren't empty, most frequent first; all fields from one pass over the documents."""
    fields = {field: TAXONOMY_FIELDS[field]} if field else TAXONOMY_FIELDS
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("value")) for k, c in fields.items()])
    counts = docs.select(F.explode(pairs).alias("x")).select("x.*").where(F.col("value") != "").groupBy("field", "value").agg(F.count("*").alias("count"))
    if limit is None:
        return counts
    w = Window.partitionBy("field").orderBy(F.col("count").desc(), "value")
    return counts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")


def facet(docs: DataFrame, value: str, label: str | None = None) -> DataFrame:
    """Distinct values of a facet with their labels."""
    return docs.where(F.col(value).isNotNull()).select(F.col(label or value).alias("label"), F.col(value).alias("value")).distinct()


def live_page_counts(roots: DataFrame, pages: DataFrame) -> DataFrame:
    """Roots with active pages, and how many."""
    counts = pages.where("status = 'active'").groupBy("root_id").agg(F.count("*").alias("page_count"))
    return roots.join(counts, "root_id").where("page_count > 0")


def stamp_page_counts(roots: DataFrame, pages: DataFrame) -> DataFrame:
    """All roots with their page counts, 0 for none."""
    counts = pages.where("status = 'active'").groupBy("root_id").agg(F.count("*").alias("page_count"))
    return roots.drop("page_count").join(counts, "root_id", "left").fillna(0, ["page_count"])


def crawl_progress(crawl: DataFrame, by_root: bool = True) -> DataFrame:
    """processed, pending, failed, total and percent (0 for none)."""
    keys = ["root_slug"] if by_root else []
    out = crawl.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "pending", "failed")], F.count("*").alias("total"))
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(F.col("processed") / F.col("total") * 100)).otherwise(0.0).cast("int"))


def crawl_counts(crawl: DataFrame) -> DataFrame:
    return crawl.groupBy("status").agg(F.count("*").alias("count"))


def freshness(log: DataFrame, now: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """The last update of each root, whole days since, and whether that is stale."""
    last = log.where(F.col("root_slug").isNotNull()).groupBy("root_slug").agg(F.max("timestamp").alias("last_update"))
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_update").cast("timestamp"))) / F.lit(86_400_000_000))
    return last.withColumn("days_since", days).withColumn("stale", F.col("days_since") > stale_days)


def corpus_stats(roots: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (name, value): pages by state, roots, roots by kind."""
    p = pages.agg(F.count_if(F.col("status") == "active").alias("active_pages"), F.count_if(F.col("status") == "deleted").alias("deleted_pages"))
    rows = p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in p.columns])))
    kinds = roots.groupBy("kind").agg(F.count("*").alias("value")).select(F.concat(F.lit("roots:"), "kind").alias("name"), "value")
    return rows.union(roots.agg(F.count("*").alias("value")).select(F.lit("roots").alias("name"), "value")).union(kinds)


def year_histogram(docs: DataFrame, year: Column) -> DataFrame:
    return docs.select(year.alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("count"))


def storage_stats(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows (name, n, bytes) of tables with the columns whose bytes count."""
    out = None
    for name, (df, columns) in tables.items():
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")
        row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).select(F.lit(name).alias("name"), "n", "bytes")
        out = row if out is None else out.union(row)
    return out


def link_rollups(links: DataFrame) -> DataFrame:
    """(level, category, section, count) of classed links: by section, by category, by both."""
    pair = links.groupBy("category", "section").agg(F.count("*").alias("count"))
    null = F.lit(None).cast("string")
    by_section = pair.groupBy("section").agg(F.sum("count").alias("count")).select(F.lit("section").alias("level"), null.alias("category"), "section", "count")
    by_category = pair.groupBy("category").agg(F.sum("count").alias("count")).select(F.lit("category").alias("level"), "category", null.alias("section"), "count")
    return pair.select(F.lit("both").alias("level"), "category", "section", "count").union(by_section).union(by_category)


def top_links(links: DataFrame, category: str, value: str, source: str, top: int = 50, samples: int = 5) -> DataFrame:
    """The most frequent targets of a category with a few of the pages that have them (the first in order)."""
    rows = links.where(F.col("category") == category).groupBy(F.col(value).alias("value"), F.col(source).alias("source")).agg(F.count("*").alias("n"), F.lit(0).alias("_z"))
    w = Window.partitionBy("value").orderBy("source")
    few = rows.withColumn("_k", F.row_number().over(w))
    out = few.groupBy("value").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.when(F.col("_k") <= samples, F.col("source")))).alias("sources"))
    return out.orderBy(F.col("count").desc(), "value").limit(top)


def pages_of_root(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """Active pages with their root's slug and name."""
    return pages.where("status = 'active'").join(roots.select("root_id", "slug", "display_name"), "root_id")


def requested_pages(pages: DataFrame, roots: DataFrame, slugs: Sequence[str] | None = None, sources: Sequence[str] | None = None) -> DataFrame:
    """Pages, active or not, of the roots and of the source types that are asked for; None asks for all, an empty list for none.

    Pages have their root's slug and source type; pages without a root are of no slug and no source type.
    """
    rows = pages.join(roots.select("root_id", "slug", "source_type"), "root_id", "left")
    for column, wanted in (("slug", slugs), ("source_type", sources)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(*wanted)) if wanted else rows.where("false")
    return rows


def scope_groups(docs: DataFrame, label: Column) -> DataFrame:
    """Groups of a scope's listing: (label, count, first title), Other for no label."""
    return docs.groupBy(F.coalesce(label, F.lit("Other")).alias("label")).agg(F.count("*").alias("count"), F.min("title").alias("first_title"))


def index_bytes(chunks: DataFrame, codes: dict[str, int]) -> DataFrame:
    """One row: chunks, and the bytes of each payload column; codes gives the bytes of one element."""
    return chunks.agg(F.count("*").alias("chunks"), *[F.coalesce(F.sum(F.size(c) * size), F.lit(0)).cast("long").alias(f"{c}_bytes") for c, size in codes.items()])
