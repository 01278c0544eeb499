"""Search filters over documents in the model's columns; a filter that isn't set adds no predicate."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import normalize_identifier
from ..functions.versions import version_at_most
from ..model import PLATFORMS

# Kinds that name a role
ROLE_KINDS = ("symbol", "article", "collection", "overview", "tutorial", "samplecode", "sample_code", "sample-project", "sampleproject")
#: The name that users give the language, and that documents have.
LANGUAGE_ALIASES = {"objc": "occ"}


@dataclass(frozen=True)
class Filters:
    frameworks: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    kind: str | None = None
    language: str | None = None
    year: int | None = None
    track: str | None = None
    deprecated: str = "include"
    platform: str | None = None
    min_versions: dict[str, str] = field(default_factory=dict)


def _norm(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def parse_sources(value: str | Iterable[str] | None) -> tuple[str, ...]:
    items = (value.split(",") if isinstance(value, str) else value) or ()
    return tuple(x.strip().lower() for x in items if x.strip())


def parse_deprecated(value: str | None) -> str:
    v = (value or "").strip().lower()
    return v if v in ("exclude", "only") else "include"


def by_framework(frameworks: Iterable[str]) -> Column:
    names = [f.strip().lower() for f in frameworks if f]
    return _norm("root_slug").isin(*names) | _norm("framework").isin(*names)


def by_kind(kind: str) -> Column:
    """A kind as shown (mixed case) is compared with the heading; a lower-case one with roles and kinds, if it names a role."""
    target = kind.strip().lower()
    if kind == kind.lower() and target in ROLE_KINDS:
        return (_norm("role") == target) | (_norm("doc_kind") == target)
    return _norm("role_heading") == target


def by_language(language: str) -> Column:
    name = language.strip().lower()
    return _norm("language").isin("", "both", name, LANGUAGE_ALIASES.get(name, name))


def by_metadata(year: int | None, track: str | None) -> Column:
    ok = F.col("source_metadata").isNotNull()
    if year:
        ok &= F.get_json_object("source_metadata", "$.year").try_cast("int") == year
    if track:
        ok &= F.lower(F.trim(F.get_json_object("source_metadata", "$.track"))).contains(track.strip().lower())
    return F.coalesce(ok, F.lit(False))


def by_platform(platform: str, requested: str) -> Column:
    """Documents of unknown version pass. Version 0 asks for the platform alone: a version, no list, or a list that has it."""
    column = f"min_{platform}"
    listed = F.get_json_object("platforms", f"$.{platform}")
    actual = F.coalesce(F.col(column), listed) if column in ("min_ios",) else listed
    if requested == "0":
        keys = F.json_object_keys("platforms")
        return F.coalesce(actual.isNotNull() | F.col("platforms").isNull() | (F.size(keys) == 0) | F.array_contains(keys, platform), F.lit(True))
    return version_at_most(actual, requested)


def apply(docs: DataFrame, f: Filters) -> DataFrame:
    """All filters that are set, before any limit."""
    if f.frameworks:
        docs = docs.where(by_framework(f.frameworks))
    if f.sources:
        docs = docs.where(_norm("source_type").isin(*f.sources))
    if f.kind and f.kind.strip():
        docs = docs.where(by_kind(f.kind))
    if f.language:
        docs = docs.where(by_language(f.language))
    if f.year or f.track:
        docs = docs.where(by_metadata(f.year, f.track))
    if f.deprecated != "include":
        docs = docs.where(F.coalesce(F.col("is_deprecated"), F.lit(False)) == (f.deprecated == "only"))
    asked = dict(f.min_versions)
    if f.platform and f.platform.lower() in PLATFORMS:
        asked.setdefault(f.platform.lower(), "0")
    for platform, version in asked.items():
        docs = docs.where(by_platform(platform, version))
    return docs


def resolve_root(roots: DataFrame, name: str) -> DataFrame:
    """The root that a name means, one row at most: its slug, then whatever the case, then a part of the display name, then of the slug."""
    low = name.lower()
    rank = F.when(F.col("slug") == name, 0).when(F.lower("slug") == low, 1).when(F.lower("display_name").contains(low), 2).when(F.lower("slug").contains(low), 3)
    return roots.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "slug").limit(1).drop("_rank")


def in_scope(column: Column, keep: Iterable[str]) -> Column:
    """Scope's keep list; an empty one keeps all."""
    names = list(keep)
    return column.isin(*names) if names else F.lit(True)


def is_transient_error(error: Column) -> Column:
    """Errors that pass: server errors, too many requests, timeouts, broken connections."""
    # What stored errors say
    pattern = r"(?i)\bHTTP (5\d{2}|408|429)\b|timed? ?out|timeout|fetch failed|unable to connect|network|socket|ECONNRESET|ECONNREFUSED|ETIMEDOUT|EAI_AGAIN"
    return F.coalesce(error.rlike(pattern), F.lit(False))


def is_invalid_path(path: Column) -> Column:
    """Failed paths that are never tried again: those that normalising rejects or changes, and anchors."""
    same = normalize_identifier(path)
    return F.coalesce(path.contains("#") | (same != path), F.lit(True)) | same.isNull()
