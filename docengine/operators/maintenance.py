"""The write path as DataFrame transformations: upserts, differences, tombstones, pruning, eviction, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive misses after which a page is deleted.
MISSES = 3


def upsert(old: DataFrame, new: DataFrame, key: str, keep_unknown: Sequence[str] = ()) -> DataFrame:
    """Rows of both by key; each column is the new value where there is one, else the old. In keep_unknown columns, `unknown` is no new value."""
    cols = [c for c in old.columns if c != key]
    n = new.select(F.col(key), *[(F.when(F.col(c) != "unknown", F.col(c)) if c in keep_unknown else F.col(c)).alias(f"_new_{c}") if c in new.columns else F.lit(None).alias(f"_new_{c}") for c in cols], *[F.col(c).alias(f"_raw_{c}") for c in keep_unknown])
    both = old.join(n, key, "full_outer")
    return both.select(key, *[F.coalesce(f"_new_{c}", c, *([f"_raw_{c}"] if c in keep_unknown else [])).alias(c) for c in cols])


def replace_children(old: DataFrame, new: DataFrame, parent: str, unique: Sequence[str], order: str) -> DataFrame:
    """Children of the parents in `new` are replaced; of new rows that are equal in `unique` the last by `order` stays."""
    w = Window.partitionBy(*unique).orderBy(F.col(order).desc())
    last = new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(last)


def delete_documents(docs: DataFrame, sections: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, key) go with their sections and their edges in both directions."""
    out = docs.join(gone.select("key"), "key", "left_anti")
    ids = docs.join(gone.select("key"), "key", "left_semi").select(F.col("id").alias("document_id"))
    e = edges.join(gone.select(F.col("key").alias("from_key")), "from_key", "left_anti").join(gone.select(F.col("key").alias("to_key")), "to_key", "left_anti")
    return out, sections.join(ids, "document_id", "left_anti"), e


def key_diff(stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, change): stale keys are stored only, new ones found only."""
    stale = stored.select(key).distinct().join(found.select(key), key, "left_anti").withColumn("change", F.lit("stale"))
    return stale.union(found.select(key).distinct().join(stored.select(key), key, "left_anti").withColumn("change", F.lit("new")))


def apply_checks(pages: DataFrame, checks: DataFrame, key: str = "path") -> DataFrame:
    """Pages (path, status, etag, misses) after a round of checks (path, http, etag): action, status, etag and misses.

    404 counts a miss and deletes the page at the third in a row; a page without check stays as it is;
    other errors change nothing; an answer with another etag means modified.
    """
    c = checks.select(F.col(key), F.col("http").alias("_http"), F.col("etag").alias("_etag"))
    rows = pages.join(c, key, "left")
    http, miss = F.col("_http"), F.col("misses") + 1
    action = F.when(http.isNull(), "unchecked").when(http == 404, F.when(miss >= MISSES, "deleted").otherwise("missed")).when(http >= 400, "error").when((http == 304) | F.col("_etag").eqNullSafe(F.col("etag")), "unchanged").otherwise("modified")
    rows = rows.withColumn("action", action)
    ok = F.col("action").isin("unchanged", "modified")
    return rows.withColumns({
        "status": F.when(F.col("action") == "deleted", "deleted").otherwise(F.col("status")), "etag": F.when(F.col("action") == "modified", F.col("_etag")).otherwise(F.col("etag")),
        "misses": F.when(ok, 0).when(http == 404, miss).otherwise(F.col("misses")),
    }).drop("_http", "_etag")


def prune_report(docs: DataFrame, keep: Column, by: str) -> DataFrame:
    """What pruning to a scope would remove and keep, by a column: the dry run."""
    return docs.groupBy(by).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("removed"))


def evict_to_quota(cache: DataFrame, quota: int, size: str = "size_bytes", order: Sequence[str] = ("updated_at", "cache_key"), buckets: int = 1024) -> DataFrame:
    """The rows that stay: the oldest go until the rest is within the quota.

    Sizes are summed over ranges of the first order column before any row is ordered, so that no task
    sorts the whole cache: only the rows of the range in which the quota is reached are ordered singly.
    """
    first = order[0]
    edge = cache.agg(F.min(first).alias("lo"), F.max(first).alias("hi")).first()
    if edge is None or edge.lo is None:
        return cache
    at = F.unix_micros(F.col(first).cast("timestamp")) if not isinstance(edge.lo, (int, float)) else F.col(first)
    lo, hi = cache.agg(F.min(at), F.max(at)).first()
    cell = F.least(F.floor((at - F.lit(lo)) / F.lit(max((hi - lo) / buckets, 1e-9))), F.lit(buckets - 1)).cast("int")
    rows = cache.withColumn("_cell", cell)
    sums = rows.groupBy("_cell").agg(F.sum(size).alias("_n"))
    newer = F.sum("_n").over(Window.orderBy(F.col("_cell").desc())) - F.col("_n")
    sums = F.broadcast(sums.withColumn("_newer", newer))
    rows = rows.join(sums, "_cell")
    inside = rows.where((F.col("_newer") <= quota) & (F.col("_newer") + F.col("_n") > quota))
    w = Window.partitionBy("_cell").orderBy(*[F.col(c).desc() for c in order])
    fit = inside.withColumn("_sum", F.sum(size).over(w) + F.col("_newer")).where(F.col("_sum") <= quota).drop("_sum")
    return rows.where(F.col("_newer") + F.col("_n") <= quota).unionByName(fit).drop("_cell", "_n", "_newer")


def evict_older(cache: DataFrame, cutoff: Column, order: str = "updated_at") -> DataFrame:
    return cache.where(F.col(order) >= cutoff)


def changed_since(docs: DataFrame, mark: Column, changed: str = "updated_at", indexed: str = "indexed_at") -> DataFrame:
    """Documents to index again: never indexed, or changed after that, up to the mark."""
    return docs.where((F.col(changed) <= mark) & (F.col(indexed).isNull() | (F.col(changed) > F.col(indexed))))


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.join(chunks.select(F.col("document_id").alias("id")), "id", "left_anti")


def failed_rows(crawl: DataFrame, roots: DataFrame, catalog_types: Sequence[str] = ("apple-docc", "hig")) -> DataFrame:
    """Failed crawl rows with what to do: drop what no page can be or another source has, retry passing errors, else keep."""
    from .filters import is_invalid_path, is_transient_error

    owner = roots.select(F.col("slug").alias("_slug"), F.col("source_type").alias("_type"))
    rows = crawl.where("status = 'failed'").join(owner, F.substring_index("path", "/", 1) == F.col("_slug"), "left")
    other = F.col("_type").isNotNull() & ~F.col("_type").isin(*catalog_types)
    todo = F.when(is_invalid_path(F.col("path")), "invalid").when(other, "other source").when(is_transient_error(F.col("error")), "retry").otherwise("keep")
    return rows.withColumn("todo", todo).drop("_slug", "_type")


def flat_update(pages: DataFrame, found: DataFrame, checks: DataFrame, key: str = "path") -> DataFrame:
    """Pages (path, status, etag, misses) after an update of a source that lists all its keys: stale ones are deleted, tracked ones checked, new ones added.

    found: the keys that the source has (path); checks as in apply_checks. action is deleted, new, or what the check says.
    """
    stale = pages.join(found.select(key), key, "left_anti").withColumn("action", F.lit("deleted")).withColumn("status", F.lit("deleted"))
    tracked = apply_checks(pages.join(found.select(key), key, "left_semi"), checks, key)
    new = found.select(key).distinct().join(pages.select(key), key, "left_anti").join(checks.select(key, "etag"), key, "left")
    new = new.select(key, F.lit("active").alias("status"), "etag", F.lit(0).alias("misses"), F.lit("new").alias("action"))
    return tracked.unionByName(stale).unionByName(new, allowMissingColumns=True)


def resolve_failed(failed: DataFrame, references: DataFrame) -> DataFrame:
    """(path, resolved): failed paths with the address that their parent's page gives for them, where it differs.

    references: (page, identifier_key, url_key) of the pages there are; a parent is the path without its last segment. Of several
    addresses the first in order counts.
    """
    up = failed.where(F.col("path").contains("/")).withColumn("page", F.regexp_replace("path", "/[^/]*$", ""))
    hit = up.join(references, ["page"]).where((F.col("identifier_key") == F.col("path")) & (F.col("url_key") != F.col("path")))
    return hit.groupBy("path").agg(F.min("url_key").alias("resolved"))


def collect_garbage(docs: DataFrame, sections: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and edges without those whose documents aren't there (either end of an edge)."""
    ids, keys = docs.select(F.col("id").alias("document_id")), docs.select("key")
    kept = edges.join(keys.select(F.col("key").alias("from_key")), "from_key", "left_semi").join(keys.select(F.col("key").alias("to_key")), "to_key", "left_semi")
    return sections.join(ids, "document_id", "left_semi"), kept


def log_update(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The update log with entries added (timestamp, action, root_slug, ...); columns that they lack are null."""
    return log.unionByName(entries, allowMissingColumns=True)


def last_updates(log: DataFrame) -> DataFrame:
    """The last entry of each action."""
    return log.groupBy("action").agg(F.max("timestamp").alias("timestamp"), F.count("*").alias("n"))


def stamp_index(chunks: DataFrame, model: str, version: int, dims: int) -> DataFrame:
    """Chunks with what made them: model, version and dimensions."""
    return chunks.withColumns({"model": F.lit(model), "version": F.lit(version), "dims": F.lit(dims)})


def to_embed(docs: DataFrame, chunks: DataFrame, model: str, version: int, dims: int) -> DataFrame:
    """Documents to embed: those without chunks of this model, version and dimensions; all if the index has another stamp."""
    same = chunks.where((F.col("model") == model) & (F.col("version") == version) & (F.col("dims") == dims))
    return without_chunks(docs, same)


def integrity_report(
    docs: DataFrame, pages: DataFrame, sections: DataFrame, edges: DataFrame, fulltext: DataFrame | None = None, body: DataFrame | None = None, raw: DataFrame | None = None, manifest: dict | None = None, schema_version: int = 0
) -> DataFrame:
    """Rows (name, found, ok): index rows without document, documents against pages, orphan sections and edges.

    With `raw` (key), also documents whose raw payload isn't there, all of them. With a snapshot's manifest, also its count
    of documents, its schema's version, and index rows without document.
    """
    from .graph import orphan_edges, orphan_rows

    ids = docs.select(F.col("id").alias("document_id"))
    one = lambda name, df, ok: df.agg(F.count("*").alias("found")).select(F.lit(name).alias("name"), "found", ok(F.col("found")).alias("ok"))
    zero = lambda c: c == 0
    empty = ids.limit(0)
    lost = lambda index: empty if index is None else index.select(F.col("id").alias("document_id")).distinct().join(ids, "document_id", "left_anti")
    out = one("documents_fulltext", lost(fulltext), zero).union(one("body_fulltext", lost(body), zero))
    more = docs.select(F.lit(1).alias("n")).union(pages.where("status = 'active'").select(F.lit(-1))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("found"))
    out = out.union(more.select(F.lit("document_page_consistency").alias("name"), "found", (F.col("found") <= 10).alias("ok")))
    out = out.union(one("orphan_sections", orphan_rows(sections, docs, "document_id", "id"), zero))
    out = out.union(one("orphan_relationships", orphan_edges(edges, docs.select("key")), zero))
    if raw is not None:
        out = out.union(one("raw_payloads", docs.select("key").join(raw.select("key"), "key", "left_anti"), zero))
    if manifest is not None:
        wanted = manifest["tables"].get("documents", {}).get("rows", 0)
        out = out.union(one("snapshot_document_count", docs, lambda c: c >= wanted))
        version = docs.sparkSession.createDataFrame([("snapshot_schema_version", manifest["schema_version"], schema_version >= manifest["schema_version"])], "name string, found long, ok boolean")
        out = out.union(version).union(one("snapshot_fulltext", lost(fulltext), zero))
    return out


def balanced_bins(sizes: dict[str, int], bins: int) -> list[list[str]]:
    """Largest first into the smallest bin; for exports that are written bin by bin."""
    load, out = [0] * bins, [[] for _ in range(bins)]
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = load.index(min(load))
        load[k] += n
        out[k].append(name)
    return out
