"""Relationships between documents, and the rows that dangle."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, durable
from .corpus_stats import RELATION_NAMES


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to, type): that of the smallest order, then section."""
    w = Window.partitionBy("from_key", "to_key", "relation_type").orderBy("sort_order", "section")
    return edges.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def relation_counts(edges: DataFrame) -> DataFrame:
    """(from_key, total and a column for each relation known)."""
    return edges.groupBy("from_key").agg(F.count("*").alias("total"), *[F.count_if(F.col("relation_type") == r).alias(n) for r, n in RELATION_NAMES.items()])


def children_with_titles(edges: DataFrame, docs: DataFrame, key: str = "key", title: str = "title") -> DataFrame:
    """Edges with their target's title; null where the target isn't there."""
    return edges.join(docs.select(F.col(key).alias("to_key"), F.col(title).alias("target_title")), "to_key", "left")


def framework_tree(edges: DataFrame, docs: DataFrame, key: str = "key") -> DataFrame:
    """Child edges between documents that are there."""
    return edges.where("relation_type = 'child'").join(docs.select(F.col(key).alias("to_key")), "to_key", "left_semi").join(docs.select(F.col(key).alias("from_key")), "from_key", "left_semi")


def orphan_edges(edges: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Edges of which an end is missing, with missing_from and missing_to."""
    a, b = keys.select(F.col(key).alias("from_key"), F.lit(True).alias("_a")).distinct(), keys.select(F.col(key).alias("to_key"), F.lit(True).alias("_b")).distinct()
    rows = edges.join(a, "from_key", "left").join(b, "to_key", "left")
    return rows.where("_a is null or _b is null").withColumn("missing_from", F.col("_a").isNull()).withColumn("missing_to", F.col("_b").isNull()).drop("_a", "_b")


def orphan_rows(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows without their parent; rows with a null key aren't orphans."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def extract_relationships(groups: DataFrame) -> DataFrame:
    """Topic, relationship and see-also groups (from_key, type, title, identifiers, place) to edges with a running order."""
    kind = (
        F.when(F.col("type") == "topics", "child").when(F.col("type") == "inheritsFrom", "inherits_from").when(F.col("type") == "conformsTo", "conforms_to").when(F.col("type") == "inheritedBy", "inherited_by")
        .when(F.col("type") == "seeAlso", "see_also")
    )
    rows = groups.withColumn("relation_type", kind).where("relation_type is not null").select("from_key", "relation_type", F.col("title").alias("section"), "place", F.posexplode("identifiers").alias("at", "to_key"))
    w = Window.partitionBy("from_key").orderBy("place", "at")
    return rows.select("from_key", "to_key", "relation_type", "section", (F.row_number().over(w) - 1).alias("sort_order"))


def breadcrumbs(docs: DataFrame, key: str = "key", title: str = "title") -> DataFrame:
    """(key, depth, crumb, label): the prefixes of a key, with the title of those that are documents."""
    parts = F.split(key, "/")
    rows = docs.select(F.col(key).alias("key"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("_p")).withColumn("crumb", F.concat_ws("/", F.expr("slice(_p, 1, depth)")))
    return rows.drop("_p").join(docs.select(F.col(key).alias("crumb"), F.col(title).alias("label")), "crumb", "left").select("key", "depth", "crumb", "label")


def parent_by_number(sections: DataFrame) -> DataFrame:
    """Numbered sections (number, path) with the path of their parent, found by the number."""
    from ..functions.text import parent_number

    rows = sections.withColumn("_parent", parent_number(F.col("number")))
    return rows.join(sections.select(F.col("number").alias("_parent"), F.col("path").alias("parent_path")), "_parent", "left").drop("_parent")


def crawl_frontier(references: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Breadth-first search along references (from_key, to_key) within a root: (key, depth) of all that seeds reach.

    Each round's keys are a table in the shared folder, so that plans stay short. With max_rounds, keys beyond are an error.
    """
    slug = lambda c: F.substring_index(c, "/", 1)
    inside = durable(references.where(slug("from_key") == slug("to_key")).select("from_key", "to_key").distinct())
    seen = front = durable(seeds.select(F.col("key"), F.lit(0).alias("depth")).distinct())
    spent: list[DataFrame] = []
    for depth in count(1):
        found = front.join(inside, front.key == inside.from_key).select(F.col("to_key").alias("key")).distinct().join(seen, "key", "left_anti")
        front = durable(found.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        if max_rounds is not None and depth > max_rounds:
            raise ValueError(f"references go on beyond {max_rounds} rounds")
        seen = seen.union(front)
        spent.append(front)
        if len(spent) == 10:  # one table again
            seen = durable(seen)
            discard(*spent[:-1])
            spent.clear()
    discard(inside)
    return seen


def category_labels(edges: DataFrame, docs: DataFrame, top: str) -> DataFrame:
    """(child, label, parent, place): the category that a page is listed under: its parent with the longest key, other than the top page.

    label is the parent's title, or its key; place its order below the top page, after all others if it isn't listed there.
    """
    child = edges.where("relation_type = 'child'")
    listed = child.where(F.col("from_key") == top).groupBy(F.col("to_key").alias("parent")).agg(F.min("sort_order").alias("place"))
    up = child.where(F.col("from_key") != top).select(F.col("to_key").alias("child"), F.col("from_key").alias("parent"))
    best = up.groupBy("child").agg(F.max_by("parent", F.struct(F.length("parent"), "parent")).alias("parent"))
    names = docs.select(F.col("key").alias("parent"), "title")
    rows = best.join(names, "parent", "left").join(listed, "parent", "left")
    return rows.select("child", F.coalesce("title", "parent").alias("label"), "parent", F.coalesce("place", F.lit(2_147_483_647)).alias("place"))
