"""Lookup and browsing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import normalize_identifier
from ..operators.chunks import find_section
from ..operators.filters import resolve_root
from ..operators.graph import relation_counts
from ..operators.markdown import render
from ..operators.pagination import excerpts, paginate_document


def by_path(docs: DataFrame, path: str) -> DataFrame:
    """The document of a path as given, else as normalised."""
    norm = docs.sparkSession.range(1).select(normalize_identifier(F.lit(path))).first()[0]
    rank = F.when(F.col("key") == path, 0).when(F.col("key") == norm, 1)
    return docs.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "key").limit(1).drop("_rank")


def by_keys(docs: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """The documents of many keys at once; keys that aren't there are left out, those asked twice come once."""
    return docs.join(wanted.select(F.col(key).alias("key")).distinct(), "key", "left_semi")


def by_title(docs: DataFrame, title: str) -> DataFrame:
    """The document of a title: a symbol first, then the shortest key."""
    return docs.where(F.lower("title") == title.lower()).orderBy((F.col("role") != "symbol").cast("int"), F.length("key"), "key").limit(1)


def read(docs: DataFrame, sections: DataFrame, edges: DataFrame, path: str | None = None, title: str | None = None, section: str | None = None, query: str | None = None, budget: int = 20_000) -> dict[str, Any] | None:
    """A document with its Markdown, one of its sections, excerpts and pages, counts of relations."""
    row = (by_path(docs, path) if path else by_title(docs, title or "")).first()
    if row is None:
        return None
    own = sections.where(F.col("document_id") == row["id"])
    parts = [r.asDict() for r in (find_section(own, section) if section else own.orderBy("sort_order")).collect()]
    counts = relation_counts(edges.where(F.col("from_key") == row["key"])).first()
    text = render(row.asDict() | {"framework": row["framework"]}, parts)
    return {
        "key": row["key"], "title": row["title"], "markdown": text, "relations": counts.asDict() if counts else {}, "excerpts": excerpts(text, query) if query else [],
        "pages": paginate_document([{"heading": p["heading"], "content": p["content_text"]} for p in parts], budget),
    }


def browse(roots: DataFrame, pages: DataFrame, name: str, edges: DataFrame | None = None, path: str | None = None, year: int | None = None, limit: int | None = None) -> DataFrame:
    """A root's pages; a page's children; for sessions, years with counts, or a year's sessions."""
    if path is not None and edges is not None:
        return edges.where(F.col("from_key") == path).join(pages.select(F.col("path").alias("to_key"), "title"), "to_key", "left").orderBy("sort_order", "to_key").select(F.col("to_key").alias("path"), "title", "section")
    root = F.broadcast(resolve_root(roots, name).select("root_id", F.col("slug").alias("_slug")))
    own = pages.where("status = 'active'").join(root, "root_id")
    at = F.regexp_extract("path", r"^wwdc/wwdc(\d{4})-", 1)
    if year is not None:
        own = own.where(at == str(year))
    elif limit is None and not own.where("_slug = 'wwdc'").isEmpty():
        return own.where(at != "").groupBy(at.cast("int").alias("year")).agg(F.count("*").alias("count")).orderBy(F.col("year").desc())
    own = own.drop("_slug").orderBy("path")
    return own.limit(limit) if limit else own
