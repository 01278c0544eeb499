"""What sources of many pages list: archives with a navigation tree or without, the archive's catalogue, a book's chapters, entry points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities
from ..operators import docc
from ..operators.graph import crawl_frontier
from ..session import ship

# The archive's host and root, the type of guides in its catalogue, the folders and formats that are read
LIBRARY = "https://developer.apple.com/library/archive"
ARCHIVE_ROOT = "apple-archive"
GUIDE = "3"
FOLDERS = ("documentation/", "featuredarticles/")
FORMATS = ("html", "htm", "pdf")
# Catalogued paths that the archive doesn't have
MISSING = (
    "documentation/Hardware/hardware2.html",
    "documentation/Hardware/legacy/legacy.html",
    "documentation/Carbon/Conceptual/DesktopIcons/ch13.html",
    "documentation/Carbon/Conceptual/DragMgrProgrammersGuide/DragMgrProgrammersGuide.pdf",
    "documentation/General/Conceptual/Apple_News_Format_Ref/index.html",
    "documentation/General/Conceptual/News_API_Ref/index.html",
    "documentation/Performance/Conceptual/Mac_OSX_Numerics/Mac_OSX_Numerics.pdf",
    "documentation/General/Conceptual/AppStoreSearchAdsAPIReference/index.html",
    "documentation/QuickTime/whatsnew.htm",
)

# The file of a book's root page, and what its folders of chapters are called
BOOK_ROOT = "The-Swift-Programming-Language"
BOOK_SECTIONS = {"GuidedTour": "Welcome to Swift", "LanguageGuide": "Language Guide", "ReferenceManual": "Language Reference", "RevisionHistory": "Revision History"}

_HEAD = "columns map<string,int>, documents array<array<string>>"


def catalogue(libraries: DataFrame, payload: str = "payload", skip: Sequence[str] = MISSING) -> DataFrame:
    """Guides (key, title, url, format, source_metadata) of catalogues, whose rows are lists with their columns named by number.

    Catalogues that aren't JSON are mended: brackets around all of it, names without quotes and commas before a closing bracket go.
    What can't be mended has no guides. Of guides with a key, the first in its catalogue stays; of several catalogues, that of the
    smallest path.
    """
    lenient = {"allowUnquotedFieldNames": "true"}
    mended = lambda p: F.regexp_replace(_unwrapped(F.trim(p)), r",\s*([}\]])", "$1")
    read = lambda p: F.coalesce(_documents(F.from_json(p, _HEAD)), _documents(F.from_json(mended(p), _HEAD, lenient)))
    # what is an element of an array is worked out once; and of an outer generator, the optimizer infers no filter that reads all once more
    path = lambda url: F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^\.\./", ""), "(?s)#.*$", "")
    cell = lambda d, x, c: F.get(d, x["columns"][c])
    listed = lambda x: F.transform(x["documents"], lambda d, i: F.struct(i.alias("place"), path(cell(d, x, "url")).alias("path"), *[cell(d, x, c).alias(c) for c in ("name", "type", "platform")]))
    rows = libraries.select(F.inline_outer(F.flatten(F.transform(F.filter(F.transform(F.array(payload), read), lambda x: x.isNotNull()), listed)))).where("place is not null")
    ending = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    rows = rows.withColumn("format", F.lower(F.when(ending == "", "html").otherwise(ending)))
    wanted = (F.col("type") == GUIDE) & (F.startswith("path", F.lit(FOLDERS[0])) | F.startswith("path", F.lit(FOLDERS[1]))) & F.col("format").isin(*FORMATS) & ~F.col("path").isin(*skip)
    rows = rows.where(wanted).select(archive_key(F.col("path")).alias("key"), "name", "platform", "path", "format", F.struct("place", "path").alias("_at"))
    # names are decoded after the choice, so that those of guides that go aren't
    first = rows.groupBy("key").agg(F.min_by(F.struct("name", "platform", "path", "format"), "_at").alias("x")).select("key", "x.*")
    meta = F.to_json(F.struct(F.lit("Guides").alias("resourceType"), decode_entities(F.col("platform")).alias("platform"), F.col("path").alias("archivePath"), "format"))
    return first.select("key", decode_entities(F.col("name")).alias("title"), F.concat(F.lit(LIBRARY + "/"), "path").alias("url"), "format", meta.alias("source_metadata"))


def _unwrapped(text: Column) -> Column:
    """Without brackets around all of it; a line's end may follow them."""
    return F.when(text.startswith("(") & text.endswith(")"), F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(F.regexp_replace(text, r"(?s)^\((.*)\)$", "$1"))


def _documents(x: Column) -> Column:
    """A parsed catalogue if it has rows, else null."""
    return F.get(F.filter(F.array(x), lambda y: y["documents"].isNotNull() & y["columns"].isNotNull()), F.lit(0))


def archive_key(path: Column) -> Column:
    """The key of a guide: an index, or a page named as its folder, stands for the folder."""
    folder, base = F.regexp_extract(path, r"(?i)^(.*)/([^/]+)\.html?$", 1), F.lower(F.regexp_extract(path, r"(?i)^(.*)/([^/]+)\.html?$", 2))
    stands = (base != "") & ((base == "index") | (base == F.lower(F.element_at(F.split(folder, "/"), -1))))
    return F.concat(F.lit(ARCHIVE_ROOT + "/"), F.when(stands, folder).otherwise(path))


def with_catalogue(bundles: DataFrame, guides: DataFrame) -> DataFrame:
    """Bundles of archive pages with what the catalogue says: kind, framework, address, metadata; PDFs become stubs that name the original."""
    own = guides.select(F.col("key").alias("_key"), F.struct(F.col("title").alias("title"), F.col("url").alias("url"), F.col("format").alias("format"), F.col("source_metadata").alias("meta")).alias("_g"))
    rows = bundles.join(own, F.col("document.key") == F.col("_key"), "left")
    key = F.col("document.key")
    tail = F.regexp_replace(key, f"^{ARCHIVE_ROOT}/", "")
    url = F.coalesce("_g.url", F.concat(F.lit(LIBRARY + "/"), F.when(F.lower(tail).rlike(r"\.(html|htm|pdf)$"), tail).otherwise(F.concat(tail, F.lit("/index.html")))))
    pdf = F.coalesce(F.col("_g.format") == "pdf", F.lower(key).endswith(".pdf"))
    doc = F.col("document").withField("kind", F.lit("archive-guide")).withField("url", url).withField("source_metadata", F.coalesce("_g.meta", "document.source_metadata"))
    doc = doc.withField("framework", F.lower(F.get(F.split(key, "/"), F.lit(2))))
    doc = doc.withField("title", F.when(pdf, F.coalesce("_g.title", "document.title")).otherwise(F.col("document.title")))
    doc = doc.withField("abstract_text", F.when(pdf, F.lit("Archived PDF guide. Open the original PDF URL for the full document.")).otherwise(F.col("document.abstract_text")))
    text = F.concat(F.lit("This archive guide is only available as a PDF.\n\nOpen the original document: "), url)
    return rows.select(doc.alias("document"), F.when(pdf, F.array(_section("discussion", F.lit("Original PDF"), text))).otherwise(F.col("sections")).alias("sections"), "relationships")


def _section(kind: str, heading: Column, text: Column, data: Column | None = None, order: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("section_kind"), heading.alias("heading"), text.alias("content_text"), (none if data is None else data).alias("content_json"),
        (F.lit(0) if order is None else order).cast("int").alias("sort_order"),
    )


def _next_order(sections: Column) -> Column:
    return F.when(F.size(sections) <= 0, 0).otherwise(F.array_max(F.transform(sections, lambda s: F.coalesce(s["sort_order"], F.lit(0)))) + 1)


# ---- archives of DocC pages ------------------------------------------------------------------------------------------


def archive_url(url: Column) -> Column:
    """(slug, base_url, entry_key) of the address of a page in an archive of another host; null for what isn't one.

    Archives are read by https alone. The host's own pages aren't others', and names of operators aren't slugs.
    """
    m = lambda k: F.regexp_extract(url, r"(?s)^(?i:https)://(?:[^/?#@]*@)?([^/?#@]+)((?:/[^?#]*?)??)/documentation/([^?#]*)", k)
    host, rest = F.lower(m(1)), F.lower(F.rtrim(m(3), F.lit("/")))
    plain = F.regexp_replace(host, r":\d*$", "")
    segments = F.split(rest, "/")
    good = (host != "") & (rest != "") & (plain != "developer.apple.com") & ~plain.endswith(".developer.apple.com")
    good = good & ~F.exists(segments, lambda s: (s == "") | s.rlike(r"^\.[.\-+*/<>=!&|^~%_]"))
    return F.when(good, F.struct(F.get(segments, F.lit(0)).alias("slug"), F.concat(F.lit("https://"), host, m(2)).alias("base_url"), rest.alias("entry_key")))


def detected_archives(pages: DataFrame, known: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    """Archives (slug, base_url, entry_key, display_name) that pages name beyond the known slugs; of a slug, the one with the smallest address."""
    found = pages.select(archive_url(F.col(url)).alias("a"), F.col(title).alias("t"), F.col(url).alias("u")).where("a is not null")
    best = found.groupBy("a.slug").agg(F.min_by(F.struct("a", "t"), F.struct("u", "t")).alias("x"))
    best = best.select("slug", "x.a.base_url", "x.a.entry_key", F.coalesce("x.t", "slug").alias("display_name"))
    return best.join(known.select("slug").distinct(), "slug", "left_anti")


def listed_pages(indexes: DataFrame, scope: bool = False) -> DataFrame:
    """(slug, key, place): the pages of its own slug that an archive's navigation tree (slug, payload) lists; or with `scope` all that it
    lists, with keys slug/documentation/... Payloads that can't be read list nothing."""
    ship(indexes.sparkSession)

    def run(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in payloads:
            yield p.map(docc.nav_pages)

    pages = F.pandas_udf(run, "array<string>")
    rows = indexes.select("slug", F.posexplode(pages("payload")).alias("place", "key"))
    if scope:
        return rows.select("slug", F.concat("slug", F.lit("/documentation/"), "key").alias("key"), "place")
    return rows.where(F.substring_index("key", "/", 1) == F.col("slug")).select("slug", "key", "place")


def enumerate_archives(archives: DataFrame, indexes: DataFrame, pages: DataFrame, roots: DataFrame, source_type: str = "external-docc") -> DataFrame:
    """(slug, key) of the pages of archives (slug): what their navigation tree lists; without one, what references reach from the slug's page.

    pages (key, payload) are what has been fetched. Slugs that roots (slug, source_type) give to another source are left out. There is
    no limit to a crawl.
    """
    taken = roots.where(~F.col("source_type").eqNullSafe(F.lit(source_type))).select("slug")
    own = archives.select("slug").distinct().join(taken, "slug", "left_anti")
    listed = listed_pages(indexes.join(own, "slug", "left_semi")).select("slug", "key").distinct()
    bare = own.join(listed, "slug", "left_anti")
    mine = pages.withColumn("_slug", F.substring_index("key", "/", 1)).join(bare, F.col("_slug") == bare.slug, "left_semi").drop("_slug")
    reached = crawl_frontier(docc.reference_keys(mine), bare.select(F.col("slug").alias("key")))
    there = reached.select("key").join(mine.select("key"), "key", "left_semi")
    return listed.unionByName(there.select(F.substring_index("key", "/", 1).alias("slug"), "key"))


def scoped(bundles: DataFrame, archives: DataFrame) -> DataFrame:
    """Bundles of archives whose pages (keys slug/documentation/...) name each other without the slug: keys of links get it, addresses are the archive's.

    archives: (slug, base_url). Bundles of other slugs stay as they are.
    """
    rows = bundles.join(archives.select(F.col("slug").alias("_slug"), "base_url"), F.substring_index("document.key", "/", 1) == F.col("_slug"), "left")
    slug = F.col("_slug")
    put = lambda k: F.when(k.startswith(F.concat(slug, F.lit("/"))), k).otherwise(F.concat(slug, F.lit("/documentation/"), k))
    tail = F.substr("document.key", F.length(slug) + 2)
    doc = F.col("document").withField("url", F.concat("base_url", F.lit("/"), tail)).withField("framework", slug)
    edges = F.transform("relationships", lambda r: r.withField("to_key", put(r["to_key"])).withField("from_key", F.col("document.key")))
    return rows.select(F.when(slug.isNull(), F.col("document")).otherwise(doc).alias("document"), "sections", F.when(slug.isNull(), F.col("relationships")).otherwise(edges).alias("relationships"))


# ---- entry points and chapters ---------------------------------------------------------------------------------------


def with_entry_points(bundles: DataFrame, registry: DataFrame, heading: str = "Related Documentation") -> DataFrame:
    """Bundles with the links that a registry (parents, key, title, summary) adds to its parents' pages: a section of topics after all
    others, and edges see_also after all others. Links of a page go by key. Pages without any stay as they are."""
    links = registry.select(F.explode("parents").alias("_key"), "key", "title", "summary").distinct()
    links = links.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("key", "title", "summary"))).alias("_l"))
    rows = bundles.join(links, F.col("document.key") == F.col("_key"), "left")
    abstract = lambda x: F.when(F.coalesce(x["summary"], F.lit("")) != "", F.array(F.struct(F.lit("text").alias("type"), x["summary"].alias("text"))))
    item = lambda x: F.struct(x["key"].alias("identifier"), x["key"].alias("key"), x["title"].alias("title"), abstract(x).alias("abstract"))
    groups = F.to_json(F.array(F.struct(F.lit(heading).alias("title"), F.lit(None).cast("string").alias("type"), F.transform("_l", item).alias("items"))), {"ignoreNullFields": "false"})
    text = F.array_join(F.transform("_l", lambda x: F.trim(F.concat(x["title"], F.lit(": "), F.coalesce(x["summary"], F.lit(""))))), "\n")
    more = F.array(_section("topics", F.lit(heading), text, groups, _next_order(F.col("sections"))))
    edges = F.transform("_l", lambda x, i: F.struct(
        F.col("document.key").alias("from_key"), x["key"].alias("to_key"), F.lit("see_also").alias("relation_type"), F.lit(heading).alias("section"), (F.size("relationships") + i).cast("int").alias("sort_order"),
    ))
    add = lambda name, what: F.when(F.col("_l").isNull(), F.col(name)).otherwise(F.concat(F.col(name), what)).alias(name)
    return rows.select("document", add("sections", more), add("relationships", edges))


def topics_of(text: Column) -> Column:
    """array<(title, items)>: the groups of links (### title, <doc:Name>) below a book's heading `## Topics`; groups without links are none."""
    inside = F.regexp_extract(F.concat(F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n## ")), r"(?s)\n##[ \t]+Topics[ \t]*\n(.*?)(?=\n##[ \t])", 1)
    groups = F.slice(F.split(F.concat(F.lit("\n"), inside), r"\n###[ \t]+"), 2, 1 << 30)
    links = lambda g: F.regexp_extract_all(g, F.lit("<doc:([A-Za-z0-9_-]+)>"), F.lit(1))
    return F.filter(F.transform(groups, lambda g: F.struct(F.trim(F.substring_index(g, "\n", 1)).alias("title"), links(g).alias("items"))), lambda g: (g["title"] != "") & (F.size(g["items"]) > 0))


def spoken(name: Column) -> Column:
    """A file's name as words."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def with_chapters(bundles: DataFrame, raw: DataFrame, root: str = BOOK_ROOT) -> DataFrame:
    """Books' bundles with their order of chapters: a root page's list of links becomes a section of topics and edges child.

    A book's keys begin with its name; its root page is the file `root`. raw (key, payload) are the Markdown files. A link is the name of a chapter's file, whatever its case and folder; of several
    files, the one of the smallest key. Links to chapters that aren't there are listed, without a key and an edge. Chapters are of kind
    book-chapter, the root is a collection; a page without a title has the words
    of its file's name; chapters in one of the known folders have its title in their metadata.
    """
    leaf = lambda c: F.lower(F.substring_index(c, "/", -1))
    book = lambda c: F.substring_index(c, "/", 1)
    is_root = lambda c: F.col(c) == F.concat(book(c), F.lit("/" + root))
    listed = raw.where(is_root("key")).select(book("key").alias("book"), F.posexplode(topics_of(F.col("payload"))).alias("g", "t"))
    listed = listed.select("book", "g", F.col("t.title").alias("group"), F.posexplode("t.items").alias("i", "name")).withColumn("_leaf", F.lower("name"))
    files = raw.where(~is_root("key")).groupBy(book("key").alias("book"), leaf("key").alias("_leaf")).agg(F.min("key").alias("to"))
    found = listed.join(files, ["book", "_leaf"], "left").select("book", "g", "group", "i", F.struct(F.concat(F.lit("swift-book://"), "name").alias("identifier"), F.col("to").alias("key"), spoken(F.col("name")).alias("title")).alias("item"))
    groups = found.groupBy("book", "g", "group").agg(F.array_sort(F.collect_list(F.struct("i", "item"))).alias("items"))
    every = groups.groupBy(F.concat("book", F.lit("/" + root)).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("g", "group", F.col("items.item").alias("items")))).alias("_g"))
    rows = bundles.join(every, F.col("document.key") == F.col("_key"), "left")
    rest = F.filter("sections", lambda s: ~((s["section_kind"] == "discussion") & s["heading"].eqNullSafe(F.lit("Topics"))))
    data = F.to_json(F.transform("_g", lambda g: F.struct(g["group"].alias("title"), F.lit(None).cast("string").alias("type"), g["items"].alias("items"))), {"ignoreNullFields": "false"})
    text = F.array_join(F.transform("_g", lambda g: F.array_join(F.concat(F.array(g["group"]), g["items"]["title"]), "\n")), "\n")
    links = F.flatten(F.transform("_g", lambda g: F.transform(F.filter(g["items"], lambda x: x["key"].isNotNull()), lambda x: F.struct(g["group"].alias("group"), x["key"].alias("key")))))
    edges = F.transform(links, lambda x, i: F.struct(
        F.col("document.key").alias("from_key"), x["key"].alias("to_key"), F.lit("child").alias("relation_type"), x["group"].alias("section"), (F.size("relationships") + i).cast("int").alias("sort_order"),
    ))
    doc = F.col("document").withField("kind", F.when(is_root("document.key"), "collection").otherwise("book-chapter"))
    name = F.substring_index("document.key", "/", -1)  # which is the title of documents without one, too
    doc = doc.withField("title", F.when(F.coalesce(F.col("document.title") == name, F.lit(True)), spoken(name)).otherwise(F.col("document.title")))
    folder = F.get(F.split("document.key", "/"), F.lit(1))
    section = F.create_map(*[F.lit(x) for kv in BOOK_SECTIONS.items() for x in kv])[folder]
    meta = F.to_json(F.struct(section.alias("bookSection"), folder.alias("bookSectionDir")))
    known = section.isNotNull() & (F.size(F.split("document.key", "/")) > 2) & ~is_root("document.key")
    doc = doc.withField("source_metadata", F.when(known, meta).otherwise(F.col("document.source_metadata")))
    has = F.col("_g").isNotNull()
    return rows.select(
        doc.alias("document"), F.when(has, F.concat(rest, F.array(_section("topics", F.lit("Topics"), text, data, _next_order(rest))))).otherwise(F.col("sections")).alias("sections"),
        F.when(has, F.concat("relationships", edges)).otherwise(F.col("relationships")).alias("relationships"),
    )
