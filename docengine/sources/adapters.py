"""The twelve adapters."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pieces import computed
from ..model import BUNDLE, DOCUMENT
from ..operators import docc, html, markdown
from ..session import ship
from .base import SourceAdapter, register, whole_files


def _bundles(raw: DataFrame, one: Any, *more: str) -> DataFrame:
    """Bundles of payloads by a function of (key, payload), and of more columns, to a bundle or None, in Arrow batches."""
    return computed(raw, ("key", "payload", *more), one, BUNDLE)


def document(**values: Any) -> dict[str, Any]:
    """A canonical document with the defaults of all fields that aren't given."""
    out: dict[str, Any] = dict.fromkeys(DOCUMENT.names)
    key = values["key"]
    out |= {"is_deprecated": False, "is_beta": False, "is_release_notes": False, "url_depth": key.count("/"), "framework": key.split("/")[0], "title": key.split("/")[-1]}
    return out | {k: v for k, v in values.items() if v is not None}


class DocC(SourceAdapter):
    def __init__(self, source_type: str, display_name: str, mode: str = "crawl", prefix: str = "") -> None:
        self.source_type, self.display_name, self.mode, self.prefix = source_type, display_name, mode, prefix

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        rows = whole_files(spark, path, "*.json")
        return rows.withColumn("key", F.concat(F.lit(self.prefix), F.regexp_replace("key", "^(documentation/)", "")))

    def normalize(self, raw: DataFrame) -> DataFrame:
        return docc.normalize_pages(raw, self.source_type)


class Markdown(SourceAdapter):
    """Markdown files; `fields` finds metadata in a file's header."""

    def __init__(self, source_type: str, display_name: str, fields: dict[str, str] | None = None) -> None:
        self.source_type, self.display_name, self.fields = source_type, display_name, fields or {}

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return whole_files(spark, path, "*.md").withColumn("key", F.concat_ws("/", F.lit(self.source_type), "key"))

    def normalize(self, raw: DataFrame) -> DataFrame:
        source, fields = self.source_type, self.fields

        def one(key: str, text: str) -> dict[str, Any]:
            d = markdown.normalize(text, key)
            found = {k: m[1].strip() for k, r in fields.items() if (m := re.search(r, text or "", re.MULTILINE))}
            doc = document(source_type=source, key=key, title=d["title"], kind="article", role="article", abstract_text=d["abstract_text"], headings=d["headings"], source_metadata=json.dumps(found, sort_keys=True) if found else None)
            return {"document": doc, "sections": d["sections"], "relationships": []}

        return _bundles(raw, one)


class Html(SourceAdapter):
    """HTML pages; a title's ending that all pages have is cut off; pages that moved become redirects.

    A page tells by itself whether it has moved, so that pages are read once and none is shuffled.
    """

    def __init__(self, source_type: str, display_name: str, title_suffix: str = "", mode: str = "flat") -> None:
        self.source_type, self.display_name, self.suffix, self.mode = source_type, display_name, title_suffix, mode

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return whole_files(spark, path, "*.html").withColumn("key", F.concat_ws("/", F.lit(self.source_type), F.regexp_replace("key", "/index$", "")))

    def normalize(self, raw: DataFrame) -> DataFrame:
        source, suffix = self.source_type, self.suffix

        def one(key: str, text: str, to: str | None) -> dict[str, Any]:
            if to is not None:
                return stub(key, to)
            d = html.parse(text, preserve=True)
            parts = [{"section_kind": "abstract" if i == 0 and s["heading"] is None else "discussion", "heading": s["heading"], "content_text": s["content"], "content_json": None, "sort_order": i} for i, s in enumerate(d["sections"])]
            heads = " ".join(s["heading"] for s in d["sections"] if s["heading"]) or None
            return {"document": document(source_type=source, key=key, title=(d["title"] or "").removesuffix(suffix).strip() or None, kind="article", role="article", abstract_text=d["description"], headings=heads), "sections": parts, "relationships": []}

        def stub(key: str, text: str) -> dict[str, Any]:
            return {"document": document(source_type=source, key=key, kind="redirect", title=f"Moved to {text}", abstract_text=f"This page has moved. The current location is {text}.", url=text), "sections": [], "relationships": []}

        return _bundles(raw.select("key", "payload", html.redirect_target(F.col("payload")).alias("to")), one, "to")


class Guidelines(Html):
    """One page of numbered sections: a document for each, with its parent by the number."""

    def __init__(self) -> None:
        super().__init__("guidelines", "Review guidelines", mode="snapshot")

    def normalize(self, raw: DataFrame) -> DataFrame:
        ship(raw.sparkSession)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for text in pdf["payload"]:
                    parts = [m for m in re.finditer(r'(?is)<(h3|li)[^>]*\bdata-sidenav[^>]*>(.*?)(?=<(?:h3|li)[^>]*\bdata-sidenav|\Z)', text or "")]
                    found: dict[str, dict[str, Any]] = {}
                    for m in parts:
                        body = html.to_markdown(html._Tree(m[2]).root)
                        number = re.match(r"\**(\d+(?:\.\d+)*(?:\([a-z]\))?)[\s.]", body)
                        if number:
                            title, _, rest = body.partition("\n")
                            found[number[1]] = {"title": title.strip("* "), "text": (rest or title).strip()}
                    for n, s in found.items():
                        up = re.sub(r"\([a-z]\)$", "", n) if "(" in n else n.rpartition(".")[0]
                        key, parent = f"app-store-review/{n}", f"app-store-review/{up}" if up in found else None
                        edges = [{"from_key": parent, "to_key": key, "relation_type": "child", "section": None, "sort_order": 0}] if parent else []
                        out.append({"document": document(source_type="guidelines", key=key, title=s["title"], kind="guidelines", role="article"), "sections": [{"section_kind": "discussion", "heading": s["title"], "content_text": s["text"], "content_json": None, "sort_order": 0}], "relationships": edges})
                yield pd.DataFrame(out, columns=BUNDLE.names)

        return raw.select("payload").mapInPandas(run, BUNDLE)


class Sessions(SourceAdapter):
    """Sessions: HTML pages, and WebVTT transcripts for those without; of a key in both, the page."""

    source_type, display_name = "wwdc", "Sessions"

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        a, b = whole_files(spark, path, "*.html").withColumn("_k", F.lit(0)), whole_files(spark, path, "*.vtt").withColumn("_k", F.lit(1))
        best = a.unionByName(b).groupBy("key").agg(F.min_by(F.struct("payload", "etag"), "_k").alias("x"))
        return best.select(F.concat(F.lit("wwdc/"), "key").alias("key"), "x.payload", "x.etag")

    def normalize(self, raw: DataFrame) -> DataFrame:
        from ..functions.text import clean_transcript

        raw = raw.withColumn("payload", F.when(F.col("payload").startswith("WEBVTT"), F.concat(F.lit("\0"), clean_transcript(F.col("payload")))).otherwise(F.col("payload")))

        def one(key: str, text: str) -> dict[str, Any]:
            year = re.search(r"wwdc(\d{4})", key)
            meta = json.dumps({"year": int(year[1])}) if year else None
            if text is None:  # a session that is known, without its page or transcript
                return {"document": document(source_type="wwdc", key=key, kind="article", role="session", source_metadata=meta), "sections": [], "relationships": []}
            if text.startswith("\0"):
                parts = [{"section_kind": "discussion", "heading": "Transcript", "content_text": text[1:], "content_json": None, "sort_order": 0}]
                return {"document": document(source_type="wwdc", key=key, kind="article", role="session", source_metadata=meta), "sections": parts, "relationships": []}
            d = html.parse(text, preserve=True)
            parts = [{"section_kind": "discussion", "heading": s["heading"], "content_text": s["content"], "content_json": None, "sort_order": i} for i, s in enumerate(d["sections"])]
            return {"document": document(source_type="wwdc", key=key, title=d["title"], kind="article", role="session", abstract_text=d["description"], source_metadata=meta), "sections": parts, "relationships": []}

        return _bundles(raw, one)


class SampleCode(SourceAdapter):
    """Derived from documents whose role is sampleCode."""

    source_type, display_name = "sample-code", "Sample code"

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        d = spark.read.parquet(path).where(F.col("role") == "sampleCode")
        return d.select(F.concat(F.lit("sample-code/"), "key").alias("key"), F.to_json(F.struct("*")).alias("payload"), F.sha2(F.to_json(F.struct("*")), 256).alias("etag"))

    def normalize(self, raw: DataFrame) -> DataFrame:
        def one(key: str, text: str) -> dict[str, Any]:
            d = json.loads(text)
            meta = json.dumps({"sampleProject": d["key"], "frameworks": [d.get("framework")]})
            return {"document": document(source_type="sample-code", key=key, title=d.get("title"), kind="sampleCode", role="sampleCode", abstract_text=d.get("abstract_text"), source_metadata=meta), "sections": [], "relationships": []}

        return _bundles(raw, one)


class Archive(Html):
    """Archive pages: an index, or a page named as its folder, stands for the folder; a PDF is its metadata alone."""

    def __init__(self) -> None:
        super().__init__("apple-archive", "Archive")

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        from ..functions.urls import map_url_to_key

        rows = whole_files(spark, path, "*.html")
        pdf = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("key"), F.lit("").alias("payload"), F.col("length").cast("string").alias("etag"))
        url = F.concat(F.lit("https://developer.apple.com/library/archive/"), "key", F.lit(".html"))
        return rows.withColumn("key", map_url_to_key(url)).unionByName(pdf.withColumn("key", F.concat(F.lit("apple-archive/"), "key")))

    def check(self, stored: DataFrame, raw: DataFrame) -> DataFrame:
        """The archive never changes."""
        return stored.select("key", F.lit("unchanged").alias("status"))


def packages(official: DataFrame, full: DataFrame, limit: int | None = None) -> DataFrame:
    """Package lists (key, url, ...) united: official rows first, each key once."""
    rows = official.withColumn("official", F.lit(True)).unionByName(full.withColumn("official", F.lit(False)), allowMissingColumns=True)
    best = rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), "official").alias("x")).select("x.*")
    return best.orderBy(F.col("official").desc(), "key").limit(limit) if limit else best


def enrich(docs: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with what another database knows (key, usr, platforms_json), where they have nothing; and its new documents.

    Keys with an anchor aren't documents.
    """
    a = assets.where(~F.col("key").contains("#"))
    filled = docs.join(a.select("key", F.col("usr").alias("_usr"), F.col("platforms_json").alias("_p")), "key", "left")
    filled = filled.withColumn("usr", F.coalesce("usr", "_usr")).withColumn("platforms_json", F.coalesce("platforms_json", "_p")).drop("_usr", "_p")
    return filled, a.join(docs.select("key"), "key", "left_anti")


def entry_points(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Links (key, title, url) that a registry (parents, title, url) adds to its parents' pages."""
    return docs.select("key").join(registry.select(F.explode("parents").alias("key"), "title", "url"), "key")


# What a proposal's header says
EVOLUTION_FIELDS = {
    "seNumber": r"^\* Proposal: \[(SE-\d{4})\]", "status": r"^\* Status: \**([^*\n]+)", "swiftVersion": r"Implemented \(Swift ([\d.]+)", "authors": r"^\* Authors?: (.+)$", "reviewManager": r"^\* Review Manager: (.+)$",
}

for _a in (
    DocC("apple-docc", "Documentation"), DocC("hig", "Design", prefix="design/"), DocC("swift-docc", "Compiler archives", "flat"), DocC("external-docc", "Other archives", "flat"),
    Markdown("swift-evolution", "Proposals", EVOLUTION_FIELDS), Markdown("swift-book", "Book"), Markdown("packages", "Packages"), Html("swift-org", "Project site", " | Swift.org"),
    Guidelines(), Archive(), Sessions(), SampleCode(),
):
    register(_a)
