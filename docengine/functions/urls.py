"""Links: mapping web addresses to keys, and classing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pages that moved
REDIRECTS = {
    "documentation/concurrency": "swift-migration-guide/documentation/migrationguide",
    "documentation/package-manager": "swift-package-manager/documentation/packagemanagerdocs",
    "documentation/tspl": "swift-book/The-Swift-Programming-Language",
}
# Hosts, the path that is left out, and the prefix of the keys (lower-cased or not)
PREFIX_RULES = (
    ("developer.apple.com", "/documentation/", "", True),
    ("developer.apple.com", "/(?=design/)", "", True),
    ("docs.swift.org", "/swift-book/", "swift-book", False),
    ("docs.swift.org", "/compiler/", "swift-compiler", False),
    ("docs.swift.org", "/swiftpm/", "swift-package-manager", False),
    ("(?:www\\.)?swift.org", "/migration/", "swift-migration-guide", False),
)
OPAQUE = r"(?i)^(mailto:|tel:|javascript:|data:)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))


def url_path(url: Column) -> Column:
    """The path, / if there is none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def map_url_to_key(url: Column) -> Column:
    """The key of the document that a web address stands for; null if no rule knows it.

    The rules are a function of an element, so that their long expression is no part of what is compiled for a whole stage.
    """
    return F.get(F.transform(F.array(url), _key_of), F.lit(0))


def _key_of(url: Column) -> Column:
    host, path = url_host(url), url_path(url)
    bare = F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/+$", "")
    swift = host.rlike(r"^(www\.)?swift\.org$")
    moved = None
    for k, v in REDIRECTS.items():
        moved = F.when(bare == k, v) if moved is None else moved.when(bare == k, v)
    out = F.when(swift & moved.isNotNull(), moved)
    for h, p, prefix, low in PREFIX_RULES:
        rest = F.regexp_replace(F.regexp_replace(path, f"^{p}", ""), "/+$", "")
        key = F.when(rest != "", F.lower(rest) if low else F.concat(F.lit(f"{prefix}/"), rest)).otherwise(F.lit(prefix or None).cast("string"))
        out = out.when(host.rlike(f"^{h.replace('.org', chr(92) + '.org').replace('.com', chr(92) + '.com')}$") & path.rlike(f"^{p}") & key.isNotNull(), key)
    # archive pages: the index, or a page named as its folder, stands for the folder
    old = F.regexp_replace(F.regexp_replace(path, "^/library/archive/", ""), "/+$", "")
    folder, base, ext = (F.regexp_extract(old, r"(?i)^(.*)/([^/]+)\.(html|htm)$", i) for i in (1, 2, 3))
    own = (F.lower(base) == "index") | (F.lower(base) == F.lower(F.substring_index(folder, "/", -1)))
    archive = F.when(ext == "", old).when(own, folder).otherwise(F.concat(folder, F.lit("/"), base, F.lit("."), F.lower(ext)))
    out = out.when((host == "developer.apple.com") & path.rlike("^/library/archive/.*[^/]"), F.concat(F.lit("apple-archive/"), archive))
    video = r"^/videos/play/(wwdc\d{4})/(\d+)/?$"
    out = out.when((host == "developer.apple.com") & path.rlike(video), F.concat(F.lit("wwdc/"), F.regexp_extract(path, video, 1), F.lit("-"), F.regexp_extract(path, video, 2)))
    proposal = r"/proposals/(\d{4}-[^/]+?)(?:\.md|\.html)?/?$"
    evolution = (swift & path.rlike(r"^/swift-evolution/proposals/\d{4}-")) | ((host == "github.com") & path.rlike(r"^/(?:apple|swiftlang)/swift-evolution/(?:blob|tree)/"))
    return out.when(evolution & path.rlike(proposal), F.concat(F.lit("swift-evolution/"), F.regexp_extract(path, proposal, 1)))


def by_longest_prefix(links: DataFrame, rules: DataFrame, url: str = "url", out: str = "mapped") -> DataFrame:
    """links with a column `out`: the key of the rule (prefix, key) with the longest prefix of the address, and what follows it.

    A prefix is a host with any number of the path's segments, without scheme; only whole segments count, and query and fragment
    don't. Of rules with one prefix, the smallest key holds. Addresses that no rule fits, or that have no scheme, get null.
    Distinct addresses meet the rules; each has as many prefixes as the deepest rule has segments, however long it is.
    """
    rules = rules.where("prefix IS NOT NULL AND key IS NOT NULL").groupBy(F.regexp_replace("prefix", "/+$", "").alias("_prefix")).agg(F.min("key").alias("_key"))
    deepest = rules.agg(F.max(F.size(F.split("_prefix", "/")))).first()[0] or 0
    path = F.when(url_path(F.col("_url")) == "/", "").otherwise(F.regexp_replace(url_path(F.col("_url")), "/+$", ""))
    each = links.select(F.col(url).alias("_url")).where(url_host(F.col("_url")) != "").distinct()
    each = each.withColumn("_parts", F.split(F.concat(url_host(F.col("_url")), path), "/"))
    depths = F.sequence(F.lit(1), F.least(F.size("_parts"), F.lit(max(deepest, 1))))
    rows = each.withColumn("_depth", F.explode(depths)).withColumn("_prefix", F.concat_ws("/", F.slice("_parts", F.lit(1), F.col("_depth")))).join(rules, "_prefix")
    rest = F.array_compact(F.transform(F.slice("_parts", F.col("_depth") + 1, F.size("_parts")), lambda x: F.when(x != "", x)))
    rows = rows.select("_url", "_depth", F.concat_ws("/", F.concat(F.array("_key"), rest)).alias("_mapped"))
    best = rows.groupBy("_url").agg(F.max_by("_mapped", "_depth").alias(out))
    return links.join(best, links[url] == best["_url"], "left").drop("_url")


def classify_links(links: DataFrame, known: DataFrame, url_col: str = "href", docs_base: str = "/docs") -> DataFrame:
    """links with category and internal_key; known: the keys there are (column key), each once."""
    u = F.col(url_col)
    inner = F.regexp_extract(u, f"^{docs_base}/([^?#]+?)/?(?:[?#].*)?$", 1)
    is_inner = u.startswith(f"{docs_base}/")
    inner_key = F.when(is_inner & (inner != ""), F.try_url_decode(inner))
    mapped = F.when(~is_inner & u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), map_url_to_key(u))
    rows = links.withColumn("_candidate", F.coalesce(inner_key, mapped))
    rows = rows.join(known.select(F.col("key").alias("_known")), F.col("_candidate") == F.col("_known"), "left")
    there = F.col("_known").isNotNull()
    category = (
        F.when(u.isNull() | (u == ""), "relative_broken").when(u.startswith("#"), "fragment").when(u.rlike(OPAQUE), "external").when(is_inner & there, "internal_ok").when(is_inner, "internal_broken")
        .when(u.startswith("/") | ~u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "relative_broken").when(there, "external_resolvable").otherwise("external")
    )
    key = F.when(is_inner, F.coalesce("_candidate", u)).when(there, F.col("_candidate"))
    return rows.withColumn("category", category).withColumn("internal_key", key).drop("_candidate", "_known")


def safe_segment(segment: Column, most: int = 200, kept: int = 180) -> Column:
    """Segments of more than `most` bytes are cut to `kept` bytes (of whole characters), ~ and twelve digits of their SHA-1."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(segment.cast("binary"), 1, kept).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(segment) > most, F.concat(cut, F.lit("~"), F.substring(F.sha1(segment), 1, 12))).otherwise(segment)


def safe_key(key: Column) -> Column:
    return F.concat_ws("/", F.transform(F.split(key, "/"), lambda s: safe_segment(s)))


def is_storage_key(key: Column) -> Column:
    """Keys that may be a path: not absolute, without .. or . segments, backslashes or control characters."""
    return F.coalesce((key != "") & ~key.rlike(r"^/|(^|/)\.{1,2}(/|$)|//|\\|[\x00-\x1f]"), F.lit(False))


def key_path(base: str, kind: Column | str, key: Column, ending: str) -> Column:
    """Where a key's file is below a folder; null for keys that may not be a path."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(is_storage_key(key), F.concat(F.lit(f"{base.rstrip('/')}/"), kind, F.lit("/"), safe_key(key), F.lit(ending)))


def relative_path(source: Column, target: Column) -> Column:
    """The way from one path's folder to another path; the target's name alone if they are the same."""
    a, b = F.split(source, "/"), F.split(target, "/")
    folders = lambda x: F.slice(x, 1, F.size(x) - 1)
    depth = F.least(F.size(a), F.size(b)) - 1
    # the first place where the folders differ, or where the shorter ones end
    same = F.coalesce(F.array_position(F.transform(F.sequence(F.lit(0), depth), lambda i: (i == depth) | (F.get(a, i) != F.get(b, i))), True).cast("int") - 1, depth)
    up = F.array_repeat(F.lit(".."), F.size(a) - 1 - same)
    down = F.slice(b, same + 1, F.size(b) - same)
    usable = (source != "") & (target != "")
    return F.when(F.coalesce(usable, F.lit(False)), F.when(source == target, F.element_at(b, -1)).otherwise(F.concat_ws("/", F.concat(F.when(F.size(folders(a)) > same, up).otherwise(F.array().cast("array<string>")), down)))).otherwise(F.coalesce(target, F.lit("")))


def absolute_url(href: Column, base: Column) -> Column:
    """A link as it stands in a page, made absolute by the page's address; null if it can't be."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    bare = F.regexp_replace(href, r"[?#].*$", "")
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    parts = F.split(F.concat(folder, bare), "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == ".") | (x == ""), acc).otherwise(F.array_append(acc, x))
    path = F.concat(F.lit("/"), F.concat_ws("/", F.aggregate(parts, F.array().cast("array<string>"), step)), F.when(bare.endswith("/"), "/").otherwise(""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(origin == "", None).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^/]+)//", 1), href))
        .when(href.startswith("/"), F.concat(origin, href)).when(bare == "", F.concat(origin, url_path(base), tail)).otherwise(F.concat(origin, path, tail))
    )


def resolve_links(links: DataFrame, known: DataFrame, docs_base: str = "/docs", href: str = "href", base: str = "base") -> DataFrame:
    """links (href, and the address of the page they are on) with `resolved`: the site's own page of a known document, else the absolute address.

    Anchors, mail, data and the like, links to the site's own pages and what can't be made absolute stay as they are. known: the keys there
    are (column key), each once.
    """
    raw = F.col(href)
    rows = links.withColumn("_abs", F.when(~raw.rlike(OPAQUE) & ~raw.startswith("#"), absolute_url(raw, F.col(base))))
    own = url_path(F.col("_abs")).startswith(f"{docs_base}/") & (url_host(F.col("_abs")) == F.coalesce(F.nullif(url_host(F.col(base)), F.lit("")), url_host(F.col("_abs"))))
    rows = rows.withColumn("_key", F.when(~own, map_url_to_key(F.col("_abs")))).join(known.select(F.col("key").alias("_known")), F.col("_key") == F.col("_known"), "left")
    inside = F.concat(F.lit(f"{docs_base}/"), "_known", F.lit("/"), F.regexp_extract("_abs", "(#.*)$", 1))
    out = F.when(F.col("_abs").isNull() | own, raw).when(F.col("_known").isNotNull(), inside).otherwise(F.col("_abs"))
    return rows.withColumn("resolved", out).drop("_abs", "_key", "_known")


def package_key(url: Column) -> Column:
    """The key of a package by the address of its repository; null for other addresses."""
    pattern = r"(?i)^https?://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$"
    owner, repo = (F.lower(F.try_url_decode(F.regexp_extract(F.trim(url), pattern, k))) for k in (1, 2))
    return F.when(owner != "", F.concat(F.lit("packages/"), owner, F.lit("/"), repo))


def composite_etag(value: Column) -> Column:
    """A package's etag as (source, repo, readme, branch, readmeFilename); what is no JSON is the repository's etag."""
    fields = ("repo", "readme", "branch", "readmeFilename")
    json = F.from_json(value, "source string, " + ", ".join(f"{f} string" for f in fields), {"mode": "PERMISSIVE"})
    is_json = F.coalesce(F.try_parse_json(value).isNotNull(), F.lit(False))
    source = F.when(is_json & (json["source"] == "raw"), "raw").otherwise("api")
    repo = F.when(is_json, json["repo"]).otherwise(F.nullif(value, F.lit("")))
    return F.struct(source.alias("source"), repo.alias("repo"), *[F.when(is_json, json[f]).alias(f) for f in fields[1:]])


def package_check(stored: Column, read: Column) -> Column:
    """Whether a package changed: its repository's etag or its readme's, whichever both have."""
    a, b = composite_etag(stored), composite_etag(read)
    same = lambda f: F.coalesce(a[f] == b[f], a[f].isNull() & b[f].isNull())
    return F.when(same("repo") & same("readme"), "unchanged").otherwise("modified")
