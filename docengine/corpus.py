"""The driver's tables as the document model, by rules that are as short in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import SOURCE_TYPES

KINDS = ("class", "article", "struct", "protocol", "collection", "tutorial", "sampleCode", "func")
HEADINGS = ("Class", "Article", "Structure", "Protocol", "Collection", "Tutorial", "Sample Code", "Function")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: tuple[str, ...], by: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(by) % len(names) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str, body: bool = True) -> DataFrame:
    """Documents with every column of the model; attributes that the table lacks are derived from the id."""
    line = lambda n: F.trim(F.split_part("text", F.lit("\n"), F.lit(n)))
    d = table(spark, sf_dir, "documents")
    cols = {
        "id": F.col("doc_id"), "key": F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), "title": line(1), "abstract": line(2), "headings": line(3),
        "declaration": F.concat(F.lit("func "), F.split_part(line(1), F.lit(" "), F.lit(1)), F.lit("()")), "framework": F.col("source"), "root_slug": F.col("source"),
        "language": F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 13 == 0, "both").otherwise(F.col("lang")), "source_type": _pick(SOURCE_TYPES, "doc_id"),
        "doc_kind": _pick(KINDS, "doc_id"), "role": F.when(F.col("doc_id") % 8 == 1, "article").when(F.col("doc_id") % 8 == 6, "sampleCode").otherwise("symbol"), "role_heading": _pick(HEADINGS, "doc_id"),
        "url_depth": F.lit(2), "is_deprecated": F.col("doc_id") % 7 == 0, "is_beta": F.col("doc_id") % 17 == 0, "is_release_notes": F.col("doc_id") % 31 == 0,
        "min_ios": F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat_ws(".", (F.col("doc_id") % 18).cast("string"), (F.col("doc_id") % 5).cast("string"))),
        "platforms": F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, '{"ios":"13.0"}').when(F.col("doc_id") % 4 == 2, '{"macos":"11.0","ios":"14.0"}').otherwise('{"tvos":"9.0"}'),
        "source_metadata": F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.concat(F.lit('{"year":'), (F.col("doc_id") % 10 + 2014).cast("string"), F.lit(',"track":"Track '), (F.col("doc_id") % 6).cast("string"), F.lit('"}'))),
    }
    out = d.select(*[c.alias(k) for k, c in cols.items()], *([F.col("text").alias("body")] if body else []))
    return out.withColumn("path", F.col("key"))


def _sql_pick(names: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(n) for n in names)}][(doc_id % {len(names)} + 1)::INT]"


#: The same mapping for the oracle: put this before a query as a CTE.
CORPUS_SQL = f"""corpus AS (
  SELECT doc_id AS id, source || '/' || lang || '/' || doc_id AS key, source || '/' || lang || '/' || doc_id AS path,
    trim(split_part(text, chr(10), 1)) AS title, trim(split_part(text, chr(10), 2)) AS abstract, trim(split_part(text, chr(10), 3)) AS headings,
    'func ' || split_part(trim(split_part(text, chr(10), 1)), ' ', 1) || '()' AS declaration, source AS framework, source AS root_slug,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'both' ELSE lang END AS language, {_sql_pick(SOURCE_TYPES)} AS source_type, {_sql_pick(KINDS)} AS doc_kind,
    CASE doc_id % 8 WHEN 1 THEN 'article' WHEN 6 THEN 'sampleCode' ELSE 'symbol' END AS role, {_sql_pick(HEADINGS)} AS role_heading, 2 AS url_depth,
    doc_id % 7 = 0 AS is_deprecated, doc_id % 17 = 0 AS is_beta, doc_id % 31 = 0 AS is_release_notes,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 18) || '.' || (doc_id % 5) END AS min_ios,
    CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{{"ios":"13.0"}}' WHEN 2 THEN '{{"macos":"11.0","ios":"14.0"}}' ELSE '{{"tvos":"9.0"}}' END AS platforms,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '{{"year":' || (doc_id % 10 + 2014) || ',"track":"Track ' || (doc_id % 6) || '"}}' END AS source_metadata, text AS body
  FROM documents)"""


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots: nations, with the region as kind."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("root_id"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("slug"), F.col("n_name").alias("display_name"), F.lower("r_name").alias("kind")
    )


ROOTS_SQL = "roots AS (SELECT n_nationkey AS root_id, lower(replace(n_name, ' ', '-')) AS slug, n_name AS display_name, lower(r_name) AS kind FROM nation JOIN region ON n_regionkey = r_regionkey)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages of the roots: customers, deleted if the balance is negative."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page_id"), F.col("c_nationkey").alias("root_id"), F.lower(F.replace("c_name", F.lit("#"), F.lit("/"))).alias("path"), F.when(F.col("c_acctbal") < 0, "deleted").otherwise("active").alias("status"),
        F.lower("c_mktsegment").alias("doc_kind"), F.concat(F.lit("W/"), F.col("c_custkey").cast("string")).alias("etag"), (F.col("c_custkey") % 4).cast("int").alias("misses"),
    )


PAGES_SQL = "pages_ AS (SELECT c_custkey AS page_id, c_nationkey AS root_id, lower(replace(c_name, '#', '/')) AS path, CASE WHEN c_acctbal < 0 THEN 'deleted' ELSE 'active' END AS status, lower(c_mktsegment) AS doc_kind, 'W/' || c_custkey AS etag, (c_custkey % 4)::INT AS misses FROM customer)"


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from orders to parts; flags tell the relation. Keys repeat."""
    kind = F.when(F.col("l_returnflag") == "A", "child").when(F.col("l_returnflag") == "N", "see_also").otherwise("conforms_to")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("from_key"), F.col("l_partkey").alias("to_key"), kind.alias("relation_type"), F.col("l_linestatus").alias("section"), F.col("l_linenumber").alias("sort_order")
    )


EDGES_SQL = "edges AS (SELECT l_orderkey AS from_key, l_partkey AS to_key, CASE l_returnflag WHEN 'A' THEN 'child' WHEN 'N' THEN 'see_also' ELSE 'conforms_to' END AS relation_type, l_linestatus AS section, l_linenumber AS sort_order FROM lineitem)"


def crawl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "processed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("user_id").alias("root_slug"), status.alias("status"), F.get_json_object("props", "$.k").cast("long").alias("depth"))


CRAWL_SQL = "crawl AS (SELECT event_id AS path, user_id AS root_slug, CASE event_type WHEN 'view' THEN 'processed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS depth FROM events)"


def update_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("user_id").alias("root_slug"), F.col("event_type").alias("action"), F.col("value").alias("duration_ms"))


LOG_SQL = "log AS (SELECT ts AS timestamp, user_id AS root_slug, event_type AS action, value AS duration_ms FROM events)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents: their lines; every fourth one is a declaration, none is empty."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("sort_order", "content_text"))
    kind = F.when(F.col("sort_order") == 0, "abstract").when(F.col("sort_order") % 4 == 3, "declaration").otherwise("discussion")
    return d.withColumn("section_kind", kind).withColumn("heading", F.when(F.col("sort_order") % 3 == 1, F.concat(F.lit("Part "), F.col("sort_order").cast("string"))))


SECTIONS_SQL = """sections AS (
  SELECT document_id, (i - 1)::INT AS sort_order, content_text, CASE WHEN i = 1 THEN 'abstract' WHEN (i - 1) % 4 = 3 THEN 'declaration' ELSE 'discussion' END AS section_kind,
         CASE WHEN (i - 1) % 3 = 1 THEN 'Part ' || (i - 1) END AS heading
  FROM (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS content_text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""
