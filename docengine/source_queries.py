"""Named queries over what sources list: catalogues, archives, chapters, entry points; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .content_queries import LINES_SQL, lines
from .corpus import table
from .registry import query
from .sources import adapters, archives, base  # noqa: F401 - adapters register themselves


def _number() -> Column:
    """The document, as text."""
    return F.col("doc_id").cast("string")


def _catalogues(d: DataFrame) -> DataFrame:
    """A catalogue that isn't quite JSON for each document: a guide, its copy, a PDF, a note, and a path elsewhere."""
    row = lambda name, kind, path: F.concat(F.lit('["'), name, F.lit(f'", "{kind}", "'), path, F.lit('", "OS &amp; X"],'))
    at = lambda ending: F.concat(F.lit("documentation/Lib/"), _number(), ending)
    rows = (
        row(F.col("a"), 3, F.concat(F.lit("../"), at(F.lit("/index.html#top")))), row(F.col("c"), 3, at(F.concat(F.lit("/"), _number(), F.lit(".html")))),
        row(F.col("b"), 3, at(F.lit("/Whole.PDF"))), row(F.col("c"), 2, at(F.lit("/note.html"))), row(F.col("c"), 3, F.lit("samplecode/x.html")),
    )
    return d.select("doc_id", F.concat(F.lit("({columns: {name: 0, type: 1, url: 2, platform: 3,}, documents: ["), *rows, F.lit("]})")).alias("payload"))


@query(f"""WITH {LINES_SQL}, g AS (SELECT 'documentation/Lib/' || doc_id AS lib, doc_id, a, b FROM d)
    SELECT 'apple-archive/' || lib AS key, a AS title, 'https://developer.apple.com/library/archive/' || lib || '/index.html' AS url, 'html' AS format, '{{"resourceType":"Guides","platform":"OS & X","archivePath":"' || lib || '/index.html","format":"html"}}' AS source_metadata FROM g
    UNION ALL SELECT 'apple-archive/' || lib || '/Whole.PDF', b, 'https://developer.apple.com/library/archive/' || lib || '/Whole.PDF', 'pdf', '{{"resourceType":"Guides","platform":"OS & X","archivePath":"' || lib || '/Whole.PDF","format":"pdf"}}' FROM g""")
def archive_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.catalogue(_catalogues(lines(spark, sf_dir)))


@query(f"""WITH {LINES_SQL}, g AS (SELECT 'documentation/Lib/' || doc_id AS lib, a, b, c FROM d), u AS (SELECT 'https://developer.apple.com/library/archive/' AS base)
    SELECT 'apple-archive/' || lib AS key, a AS title, 'archive-guide' AS kind, 'lib' AS framework, base || lib || '/index.html' AS url, 'discussion' AS section_kind, a AS heading, c AS content_text FROM g, u
    UNION ALL SELECT 'apple-archive/' || lib || '/Whole.PDF', b, 'archive-guide', 'lib', base || lib || '/Whole.PDF', 'discussion', 'Original PDF', 'This archive guide is only available as a PDF.' || chr(10) || chr(10) || 'Open the original document: ' || base || lib || '/Whole.PDF' FROM g, u""")
def archive_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the archive with what its catalogues say of them."""
    d = lines(spark, sf_dir)
    page = F.concat(F.lit("<html><head><title>"), "a", F.lit("</title></head><body><main><h2>"), "a", F.lit("</h2><p>"), "c", F.lit("</p></main></body></html>"))
    key = F.concat(F.lit("apple-archive/documentation/Lib/"), _number())
    raw = d.select(key.alias("key"), page.alias("payload")).unionByName(d.select(F.concat(key, F.lit("/Whole.PDF")).alias("key"), F.lit("").alias("payload")))
    bundles = archives.with_catalogue(base.adapter("apple-archive").normalize(raw), archives.catalogue(_catalogues(d)))
    s = F.get("sections", F.lit(0))
    return bundles.select("document.key", "document.title", "document.kind", "document.framework", "document.url", *[s[c].alias(c) for c in ("section_kind", "heading", "content_text")])


_HOST = "lower(regexp_extract(url, '^[^:]*://([^/?#]+)', 1))"


@query(f"SELECT page_id, 'ab' || (page_id % 7) AS slug, 'https://' || {_HOST} || '/Kit' AS base_url, 'ab' || (page_id % 7) || '/' || page_id AS entry_key FROM pages WHERE page_id % 3 <> 0 AND {_HOST} <> ''")
def archive_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of archives on the pages' hosts; every third is read without encryption."""
    i = F.col("page_id").cast("string")
    host = F.regexp_extract("url", "^[^:]*://([^/?#]+)", 1)
    url = F.concat(F.when(F.col("page_id") % 3 == 0, "http://").otherwise("https://"), host, F.lit("/Kit/documentation/Ab"), (F.col("page_id") % 7).cast("string"), F.lit("/"), i, F.lit("/?q#x"))
    return table(spark, sf_dir, "pages").select("page_id", archives.archive_url(url).alias("x")).where("x is not null").select("page_id", "x.*")


def _page(slug: Column, n: Column) -> Column:
    return F.concat(slug, F.when(n > 0, F.concat(F.lit("/"), n.cast("string"))).otherwise(""))


@query("""WITH RECURSIVE p AS (SELECT doc_id % 50 AS s, doc_id // 50 AS n FROM documents), r AS (SELECT s, n FROM p WHERE n = 0 AND s % 2 = 1 UNION SELECT p.s, p.n FROM r JOIN p ON p.s = r.s AND (p.n = 2 * r.n + 1 OR p.n = 2 * r.n + 2)),
    found AS (SELECT s, n FROM r UNION SELECT s, n FROM p WHERE s % 2 = 0) SELECT 's' || s AS slug, 's' || s || CASE WHEN n > 0 THEN '/' || n ELSE '' END AS key FROM found WHERE s <> 3""")
def archives_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty archives of all documents: half list their pages in navigation trees, half are crawled; one belongs to another source."""
    n, number = F.floor(F.col("doc_id") / 50), (F.col("doc_id") % 50).cast("string")
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("s"), F.concat(F.lit("s"), number).alias("slug"), n.alias("n"))
    path = F.concat(F.lit("/documentation/"), _page(F.col("slug"), F.col("n")))
    other = F.struct(F.lit("module").alias("type"), F.lit("/documentation/elsewhere/x").alias("path"))
    index = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("module").alias("type"), path.alias("path")), other).alias("swift")).alias("interfaceLanguages")))
    to = lambda k: F.concat(F.lit("doc://org/documentation/"), _page(F.col("slug"), 2 * F.col("n") + k))
    payload = F.to_json(F.struct(F.array(F.struct(F.array(to(1), to(2), F.lit("doc://org/documentation/elsewhere/x")).alias("identifiers"))).alias("topicSections")))
    pages = d.select(_page(F.col("slug"), F.col("n")).alias("key"), payload.alias("payload"))
    own = spark.createDataFrame([("s3", "packages"), ("s4", "external-docc")], "slug string, source_type string")
    return archives.enumerate_archives(d.select("slug"), d.where("s % 2 = 0").select("slug", index.alias("payload")), pages, own)


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book of two chapters, and one that is missing, for each document."""
    root = F.concat(F.lit("# "), "a", F.lit("\n\n"), "b", F.lit("\n\n## Topics\n\n### Begin\n\n- <doc:TheBasics>\n- <doc:NotThere>\n\n### Empty\n\n### More\n\n- <doc:theend>\n\n## After\n\n<doc:TheBasics>\n"))
    chapter = F.concat(F.lit("## "), "a", F.lit("\n\n"), "c", F.lit("\n"))
    files = F.array(*[F.struct(F.concat(F.lit("b"), _number(), F.lit(f"/{name}")).alias("key"), text.alias("payload")) for name, text in ((archives.BOOK_ROOT, root), ("GuidedTour/TheBasics", chapter), ("Other/TheEnd", chapter))])
    return lines(spark, sf_dir).select(F.inline(files))


@query("""SELECT 'b' || doc_id || '/The-Swift-Programming-Language' AS from_key, 'b' || doc_id || unnest(['/GuidedTour/TheBasics', '/Other/TheEnd']) AS to_key, 'child' AS relation_type, unnest(['Begin', 'More']) AS section, unnest([0, 1])::INT AS sort_order FROM documents""")
def book_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _books(spark, sf_dir)
    return archives.with_chapters(base.adapter("swift-book").normalize(raw), raw).select(F.inline("relationships"))


@query(f"""WITH {LINES_SQL}, i AS (SELECT doc_id, 'b' || doc_id AS book, a FROM d)
    SELECT book || '/The-Swift-Programming-Language' AS key, a AS title, 'collection' AS kind, NULL::VARCHAR AS source_metadata, 'Begin' || chr(10) || 'The Basics' || chr(10) || 'Not There' || chr(10) || 'More' || chr(10) || 'theend' AS topics FROM i
    UNION ALL SELECT book || '/GuidedTour/TheBasics', 'The Basics', 'book-chapter', '{{"bookSection":"Welcome to Swift","bookSectionDir":"GuidedTour"}}', NULL FROM i
    UNION ALL SELECT book || '/Other/TheEnd', 'The End', 'book-chapter', NULL, NULL FROM i""")
def book_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _books(spark, sf_dir)
    topics = F.get(F.filter("sections", lambda s: s["section_kind"] == "topics"), F.lit(0))["content_text"]
    return archives.with_chapters(base.adapter("swift-book").normalize(raw), raw).select("document.key", "document.title", "document.kind", "document.source_metadata", topics.alias("topics"))


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir)
    page = F.concat(F.lit("<html><head><title>"), "a", F.lit("</title></head><body><main><p>"), "b", F.lit("</p></main></body></html>"))
    bundles = base.adapter("swift-org").normalize(d.select(F.concat(F.lit("swift-org/"), _number()).alias("key"), page.alias("payload")))
    parents = F.array(F.concat(F.lit("swift-org/"), _number()), F.concat(F.lit("swift-org/"), (F.col("doc_id") + 1).cast("string")), F.lit("no"))
    registry = d.where("doc_id % 3 = 0").select(parents.alias("parents"), F.concat(F.lit("kit/"), _number()).alias("key"), F.col("a").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("b")).alias("summary"))
    return archives.with_entry_points(bundles, registry)


_RELATED_SQL = f"{LINES_SQL}, l AS (SELECT doc_id, unnest([doc_id, doc_id + 1]) AS parent, a, CASE WHEN doc_id % 2 = 0 THEN b END AS summary FROM d WHERE doc_id % 3 = 0)"


@query(f"WITH {_RELATED_SQL} SELECT 'swift-org/' || parent AS from_key, 'kit/' || l.doc_id AS to_key, 'see_also' AS relation_type, 'Related Documentation' AS section, 0 AS sort_order FROM l JOIN documents p ON p.doc_id = l.parent")
def site_related_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entry points add to pages: edges."""
    return _related(spark, sf_dir).select(F.inline("relationships"))


@query(f"WITH {_RELATED_SQL} SELECT 'swift-org/' || parent AS key, 'Related Documentation' AS heading, a || ':' || coalesce(' ' || summary, '') AS content_text, 1 AS sort_order FROM l JOIN documents p ON p.doc_id = l.parent")
def site_related_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entry points add to pages: a section after the others."""
    s = _related(spark, sf_dir).select(F.col("document.key").alias("key"), F.inline("sections"))
    return s.where("section_kind = 'topics'").select("key", "heading", "content_text", "sort_order")
