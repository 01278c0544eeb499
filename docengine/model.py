"""The document model: source types, canonical columns, and the contract that every adapter fulfils."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the document model
SOURCE_TYPES = (
    "apple-docc", "swift-docc", "external-docc", "apple-archive", "guidelines", "hig", "packages", "sample-code", "swift-book", "swift-evolution", "swift-org", "wwdc",
)
DEFAULT_SOURCE_TYPE = "apple-docc"
ROOT_SOURCE_TYPES = {
    "app-store-review": "guidelines", "design": "hig", "apple-archive": "apple-archive", "packages": "packages", "sample-code": "sample-code",
    "swift-book": "swift-book", "swift-evolution": "swift-evolution", "swift-org": "swift-org", "wwdc": "wwdc",
}
PLATFORMS = ("ios", "macos", "watchos", "tvos", "visionos")

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _struct(fields: str) -> T.StructType:
    """A struct from "name kind, name kind"; needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])


SECTION = _struct("section_kind string, heading string, content_text string, content_json string, sort_order int")
RELATION = _struct("from_key string, to_key string, relation_type string, section string, sort_order int")
DOCUMENT = _struct(
    "source_type string, key string, title string, kind string, role string, role_heading string, framework string, url string, language string, "
    "abstract_text string, declaration_text string, headings string, platforms_json string, min_ios string, min_macos string, min_watchos string, "
    "min_tvos string, min_visionos string, is_deprecated boolean, is_beta boolean, is_release_notes boolean, url_depth int, source_metadata string"
)
BUNDLE = T.StructType([T.StructField("document", DOCUMENT), T.StructField("sections", T.ArrayType(SECTION)), T.StructField("relationships", T.ArrayType(RELATION))])

# The one row shape of all search tiers
RESULT_COLUMNS = (
    "id", "path", "title", "role", "role_heading", "doc_kind", "abstract", "declaration", "platforms", "framework", "root_slug", "source_type", "source_metadata", "url_depth",
    "language", "is_release_notes", "is_deprecated", "is_beta", "min_ios", "min_macos", "min_watchos", "min_tvos", "min_visionos",
)


def coerce_source_type(value: Column) -> Column:
    """The value if it is a source type, else the default."""
    return F.when(value.isin(*SOURCE_TYPES), value).otherwise(F.lit(DEFAULT_SOURCE_TYPE))


def root_source_type(slug: Column, kind: Column) -> Column:
    """A root's source type: by its slug, then by its kind."""
    out = F.when(kind == "guidelines", "guidelines").when(kind == "design", "hig").otherwise(DEFAULT_SOURCE_TYPE)
    by_slug = None
    for k, v in ROOT_SOURCE_TYPES.items():
        by_slug = F.when(slug == k, v) if by_slug is None else by_slug.when(slug == k, v)
    return F.coalesce(by_slug, out)


def framework_of(key: Column) -> Column:
    """First segment of a key, a leading documentation/ skipped."""
    return F.split_part(F.regexp_replace(key, "^documentation/", ""), F.lit("/"), F.lit(1))


def url_depth(key: Column) -> Column:
    """Segments less one."""
    return F.size(F.split(key, "/")) - 1


def result_rows(rows: DataFrame) -> DataFrame:
    """Rows in the shape of all search tiers; columns that they lack are null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS])


# What each surface shows, and flags that are shown only if they are true
SURFACES = {
    "search": ("path", "title", "framework", "root_slug", "doc_kind", "source_type", "abstract", "declaration", "platforms", "language", "snippet", "related_count", "confidence"),
    "read": ("title", "framework", "root_slug", "role_heading", "doc_kind", "abstract", "declaration", "path", "platforms"),
    "lookup": ("path", "title", "framework", "doc_kind"),
}
FLAGS = ("is_deprecated", "is_beta", "is_release_notes")


def project(rows: DataFrame, surface: str) -> DataFrame:
    """Only what a surface shows; flags that aren't true are null, so that nothing else gets out."""
    there = [c for c in SURFACES[surface] if c in rows.columns]
    return rows.select(*there, *[F.when(F.col(c), True).alias(c) for c in FLAGS if c in rows.columns])
