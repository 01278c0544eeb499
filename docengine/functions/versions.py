"""Versions as sortable integers, and platform lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_version(text: Column) -> Column:
    """major * 1e6 + minor * 1e3 + patch of the leading number; null if there is none or a part is 1000 or more.

    A fourth part may be there and counts for the bound alone.
    """
    parts = F.split(F.regexp_extract(F.trim(text), r"^\d+(?:\.\d+){0,3}", 0), r"\.")
    n = F.transform(parts, lambda p: F.expr("1").cast("long") * p.try_cast("long"))
    ok = F.forall(n, lambda x: x.isNotNull() & (x < 1000))
    at = lambda i: F.coalesce(F.get(n, F.lit(i)), F.lit(0))
    return F.when(ok, at(0) * 1_000_000 + at(1) * 1000 + at(2))


def version_at_most(actual: Column, requested: str) -> Column:
    """Whether a version is known to be above the requested one: unknown versions pass."""
    got = encode_version(actual)
    return F.coalesce(got <= encode_version(F.lit(requested)), F.lit(True))


def tidy_float(value: Column) -> Column:
    """Two decimals, without zeros at the end."""
    return F.regexp_replace(F.call_function("format_number", value, F.lit("0.00")), r"\.?0+$", "")


def platform_map(platforms: Column) -> Column:
    """A list of (name, introducedAt) to a map of lower-cased names; entries without either are left out."""
    usable = F.filter(platforms, lambda p: p["name"].isNotNull() & p["introducedAt"].isNotNull())
    entries = F.transform(usable, lambda p: F.struct(F.lower(p["name"]), p["introducedAt"]))
    # a name that repeats has its first place and its last version
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda o: o["col1"] == e["col1"]))
    last = lambda e: F.element_at(F.filter(entries, lambda o: o["col1"] == e["col1"]), -1)["introducedAt"]
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["col1"], last(e))))


def serialize_platforms(platforms: Column) -> Column:
    """A map of platforms as JSON; null stays null."""
    return F.to_json(platforms)


def read_platforms(text: Column) -> Column:
    """The map again; null for what is no JSON object."""
    return F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False)), F.from_json(text, "map<string,string>"))
