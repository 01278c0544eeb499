"""DocC pages: JSON to canonical documents, sections and relationships."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Generator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import normalize_identifier
from ..functions.pieces import computed
from ..functions.trees import dumps, loads, unwound
from ..functions.urls import by_longest_prefix, map_url_to_key
from ..model import BUNDLE, RELATION
from ..session import ship
from .markdown import write_yaml

# Names of platforms, and of relations
PLATFORM_KEYS = {"iOS": "ios", "macOS": "macos", "watchOS": "watchos", "tvOS": "tvos", "visionOS": "visionos", "Mac Catalyst": "maccatalyst", "macCatalyst": "maccatalyst", "iPadOS": "ipados"}
RELATION_TYPES = {"inheritsFrom": "inherits_from", "conformsTo": "conforms_to", "inheritedBy": "inherited_by"}
#: Inline nodes that only wrap others.
_WRAPPERS = ("emphasis", "strong", "newTerm", "inlineHead", "superscript", "subscript", "strikethrough")


def identifier(raw: str | None) -> str | None:
    """The same rules as functions.identifiers.normalize_identifier, for one string."""
    import re

    if not raw or re.match(r"https?://", raw):
        return None
    i = re.sub(r"^doc://[^/]+/(?:documentation/(?=.)|(?=design/.))", "", raw)
    i = re.sub(r"^/(?=design/|app-store-review/)", "", i)
    i = re.sub(r"^documentation/", "", re.sub(r"^/documentation/", "", i))
    i = i.lower().rstrip("/").split("#")[0]
    return None if not i or any(not s or re.match(r"\.[.\-+*/<>=!&|^~%_]", s) for s in i.split("/")) else i


def text_of(nodes: Any, refs: dict[str, Any]) -> str:
    """Plain text of content or inline nodes, however deep: a line for each block."""
    return unwound(_text(nodes, refs))


def _text(nodes: Any, refs: dict[str, Any]) -> Generator:
    out = []
    for n in nodes if isinstance(nodes, list) else []:
        if not isinstance(n, dict):
            continue
        match n.get("type"):
            case "paragraph":
                out.append((yield _text(n.get("inlineContent"), refs)) + "\n")
            case "heading":
                out.append((n.get("text") or (yield _text(n.get("inlineContent"), refs))) + "\n")
            case "codeListing":
                out.append("\n".join(n.get("code") or []) + "\n")
            case "unorderedList" | "orderedList":
                for i in n.get("items") or []:
                    out.append((yield _text(i.get("content"), refs)))
            case "aside":
                out.append(f"{n.get('style') or 'Note'}: {(yield _text(n.get('content'), refs)).strip()}\n")
            case "table":
                lines = []
                for row in _cells(n):
                    cells = []
                    for c in row:
                        cells.append((yield _text(c, refs)).strip())
                    lines.append(" | ".join(cells))
                out.append("\n".join(lines) + "\n")
            case "links":
                out.append("\n".join((refs.get(i) or {}).get("title") or identifier(i) or i for i in n.get("items") or []) + "\n")
            case "text":
                out.append(n.get("text") or "")
            case "codeVoice":
                out.append(n.get("code") or "")
            case "reference":
                out.append((refs.get(n.get("identifier")) or {}).get("title") or n.get("title") or n.get("identifier") or "")
            case "link":
                out.append(n.get("title") or n.get("destination") or "")
            case t if t in _WRAPPERS:
                out.append((yield _text(n.get("inlineContent"), refs)))
            case _:
                own = n.get("text") or (str(n["code"]) if n.get("code") else "")
                out.append(own or (yield _text(n.get("inlineContent"), refs)) or (yield _text(n.get("content"), refs)))
    return "".join(out)


def _cells(table: dict[str, Any]) -> list[list[Any]]:
    """The content of a table's cells, by row."""
    rows = [r if isinstance(r, list) else r.get("cells") or [] for r in table.get("rows") or []]
    return [[c.get("content") if isinstance(c, dict) else c for c in r] for r in rows]


def resolve(ident: str, refs: dict[str, Any]) -> str | None:
    """A reference's key: by its address, else by itself."""
    return identifier((refs.get(ident) or {}).get("url")) or identifier(ident)


def references(page: dict[str, Any]) -> list[str]:
    """Keys that a crawl goes on to: topics, relationships, see-also, and topics mentioned with an abstract."""
    refs = page.get("references") or {}
    listed = [i for part in ("topicSections", "relationshipsSections", "seeAlsoSections") for s in page.get(part) or [] for i in s.get("identifiers") or []]
    out = [resolve(i, refs) for i in listed if not i.startswith("doc://com.externally.resolved")]
    out += [identifier(r["url"]) for i, r in refs.items() if not i.startswith("doc://com.externally.resolved") and r.get("type") == "topic" and "/documentation/" in (r.get("url") or "") and r.get("abstract")]
    return list(dict.fromkeys(k for k in out if k))


def platforms(meta: dict[str, Any]) -> dict[str, str]:
    names = ((p.get("name"), p.get("introducedAt")) for p in meta.get("platforms") or [])
    return {PLATFORM_KEYS.get(n) or n.lower(): v for n, v in names if n and v}


def normalize(page: dict[str, Any], key: str, source_type: str = "apple-docc", external: bool = False) -> dict[str, Any]:
    """{document, sections, relationships}; the orders 0 to 3 are kept for abstract, declaration, parameters and properties.

    With `external`, relationships have the address too where rules for addresses may know more than the identifier.
    """
    meta, refs, primary = page.get("metadata") or {}, page.get("references") or {}, page.get("primaryContentSections") or []
    of = lambda kind: [s for s in primary if s.get("kind") == kind]
    declared = [d for s in of("declarations") for d in s.get("declarations") or []]
    declaration = "".join(t.get("text") or "" for t in declared[0].get("tokens") or []) or None if declared else None
    language = next((x for d in declared for x in ("swift", "occ") if x in (d.get("languages") or [])), "swift" if (meta.get("modules") or [{}])[0].get("name") else None)
    abstract = text_of(page["abstract"], refs) if page.get("abstract") else None
    heads = [n.get("text") or text_of(n.get("inlineContent"), refs) for s in of("content") for n in s.get("content") or [] if n.get("type") == "heading"]
    known = platforms(meta)
    base = "https://developer.apple.com/" + ("" if source_type == "hig" or key.startswith("design/") else "documentation/")
    document = {
        "source_type": source_type, "key": key, "title": meta.get("title"), "kind": meta.get("symbolKind") or page.get("kind") or meta.get("role"), "role": meta.get("role"),
        "role_heading": meta.get("roleHeading"), "framework": key.split("/")[0], "url": base + key, "language": language, "abstract_text": abstract, "declaration_text": declaration,
        "headings": " ".join(h for h in heads if h) or None, "platforms_json": json.dumps(known, separators=(",", ":")) if known else None, **{f"min_{p}": known.get(p) for p in ("ios", "macos", "watchos", "tvos", "visionos")},
        "is_deprecated": meta.get("deprecated") is True, "is_beta": meta.get("beta") is True, "is_release_notes": "release-notes" in key or meta.get("role") == "releaseNotes", "url_depth": key.count("/"), "source_metadata": None,
    }
    sections: list[dict[str, Any]] = []

    def add(kind: str, heading: str | None, text: str | None, data: Any, order: int | None = None) -> None:
        if text or data:
            sections.append({"section_kind": kind, "heading": heading, "content_text": text or "", "content_json": dumps(data) if data else None, "sort_order": max([3, *(s["sort_order"] for s in sections)]) + 1 if order is None else order})

    add("abstract", None, abstract, page.get("abstract"), 0)
    add("declaration", "Declaration", declaration, declared, 1)
    parameters = [p for s in of("parameters") for p in s.get("parameters") or []]
    add("parameters", "Parameters", "\n".join(f"{p.get('name')}: {text_of(p.get('content'), refs).strip()}" for p in parameters), parameters, 2)
    properties = [p for s in of("properties") for p in s.get("items") or []]
    add("properties", "Properties", "\n".join(f"{p.get('name')}: {text_of(p.get('content'), refs).strip()}" for p in properties), properties, 3)
    for s in of("restEndpoint"):
        add("rest_endpoint", s.get("title") or "URL", "".join(t.get("text") or "" for t in s.get("tokens") or []), s.get("tokens"))
    for s in of("restParameters"):
        add("rest_parameters", s.get("title") or "Parameters", "\n".join(f"{i.get('name')}: {text_of(i.get('content'), refs).strip()}" for i in s.get("items") or []), s.get("items"))
    for s in of("restResponses"):
        add("rest_responses", s.get("title") or "Response Codes", "\n".join(f"{i.get('status')} {i.get('reason') or ''}: {text_of(i.get('content'), refs).strip()}" for i in s.get("items") or []), s.get("items"))
    for s in of("possibleValues"):
        add("possible_values", s.get("title") or "Possible Values", "\n".join(f"{v.get('name')}: {text_of(v.get('content'), refs).strip()}" for v in s.get("values") or []), s.get("values"))
    for s in of("mentions"):
        add("mentioned_in", "Mentioned in", "\n".join((refs.get(m) or {}).get("title") or m for m in s.get("mentions") or []), s.get("mentions"))
    for s in of("content"):
        nodes = s.get("content") or []
        heading = next((n.get("text") or text_of(n.get("inlineContent"), refs) for n in nodes if n.get("type") == "heading"), None)
        add("discussion", heading or "Overview", text_of(nodes, refs).strip(), nodes)
    relationships = []
    for part, kind, name in (("topicSections", "topics", "Topics"), ("relationshipsSections", "relationships", "Relationships"), ("seeAlsoSections", "see_also", "See Also")):
        groups = page.get(part) or []
        add(kind, name, "\n".join((refs.get(i) or {}).get("title") or resolve(i, refs) or i for g in groups for i in g.get("identifiers") or []), groups)
        for g in groups:
            relation = {"topics": "child", "see_also": "see_also"}.get(kind) or RELATION_TYPES.get(g.get("type") or "", g.get("type") or "related")
            for i in g.get("identifiers") or []:
                url = (refs.get(i) or {}).get("url")
                near = identifier(url)
                row = {"from_key": key, "to_key": near or identifier(i), "relation_type": relation, "section": g.get("title"), "sort_order": len(relationships)}
                if row["to_key"] or external and url:
                    relationships.append(row | ({"url": None if near else url} if external else {}))
    return {"document": document, "sections": sections, "relationships": relationships}


def normalize_pages(pages: DataFrame, source_type: str = "apple-docc", key: str = "key", payload: str = "payload") -> DataFrame:
    """Bundles of DocC pages (key, JSON payload); payloads that are no JSON object give none.

    A reference's key is that of its address, else what the rules for web addresses make of it, else that of its identifier.
    """

    def one(k: str, p: str) -> dict[str, Any] | None:
        page = _page(p)
        return None if page is None else normalize(page, k, source_type, external=True)

    schema = T.StructType([*BUNDLE.fields[:2], T.StructField("relationships", T.ArrayType(T.StructType([*RELATION.fields, T.StructField("url", T.StringType())])))])
    rows = computed(pages, (key, payload), one, schema)
    mapped = F.transform("relationships", lambda x: x.withField("to_key", F.coalesce(map_url_to_key(x["url"]), x["to_key"])).dropFields("url"))
    known = F.filter(mapped, lambda x: x["to_key"].isNotNull())
    return rows.withColumn("relationships", F.transform(known, lambda x, i: x.withField("sort_order", i)))


def is_payload(text: str | None) -> bool:
    """Whether a file looks like a DocC page."""
    try:
        page = loads(text or "")
    except ValueError:
        return False
    return isinstance(page, dict) and isinstance(page.get("metadata"), dict) and ("identifier" in page or "primaryContentSections" in page or "references" in page)


def nav_keys(index: dict[str, Any], language: str = "swift") -> list[str]:
    """All pages of an archive's navigation tree, in order, each once."""
    out: dict[str, None] = {}
    stack = list(reversed((index.get("interfaceLanguages") or {}).get(language) or []))
    while stack:
        n = stack.pop()
        if n.get("type") != "groupMarker" and (k := identifier(n.get("path"))):
            out[k] = None
        stack.extend(reversed(n.get("children") or []))
    return list(out)


def nav_pages(payload: str | None, language: str = "swift") -> list[str]:
    """The same of a payload; one that isn't a navigation tree lists nothing."""
    try:
        index = loads(payload or "")
    except ValueError:
        return []
    return nav_keys(index, language) if isinstance(index, dict) and isinstance(index.get("interfaceLanguages"), dict) else []


def consolidate_links(node: Any, known: set[str]) -> dict[str, int]:
    """Resolved keys in a content tree that aren't known are taken out, in place; links get theirs. Counts added, removed, kept."""
    counts = {"added": 0, "removed": 0, "kept": 0}
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, list):
            stack.extend(n)
        elif isinstance(n, dict):
            has = n.get("_resolvedKey")
            if n.get("type") in ("reference", "link") and isinstance(has, str):
                counts["kept" if has in known else "removed"] += 1
                if has not in known:
                    del n["_resolvedKey"]
            if n.get("type") == "link" and "_resolvedKey" not in n and (k := identifier((n.get("destination") or "").replace("https://developer.apple.com", ""))) in known:
                n["_resolvedKey"] = k
                counts["added"] += 1
            stack.extend(n.values())
    return counts


# What is written on both sides of inline nodes
_MARKS = {"emphasis": "*", "newTerm": "**", "strong": "**", "inlineHead": "**", "strikethrough": "~~"}


def relative(source: str, target: str) -> str:
    """The same rules as functions.urls.relative_path, for one pair of keys."""
    if not source or not target:
        return target or ""
    folder = posixpath.relpath("/" + posixpath.dirname(target), "/" + posixpath.dirname(source))
    name = target.rsplit("/", 1)[-1]
    return name if folder == "." or source == target else f"{folder}/{name}"


def _linked(ident: str, title: str | None, path: str) -> str | None:
    """A link from a page to another one's file; null if the identifier is none of a page."""
    key = identifier(ident)
    return f"[{title or key}]({relative(path, key)}.md)" if key else None


def _listed(idents: Any, refs: dict[str, Any], path: str) -> str:
    titles = [(i, (refs.get(i) or {}).get("title")) for i in idents or []]
    return "\n".join(f"- {_linked(i, t, path) or t or i}" for i, t in titles)


def markdown_of(nodes: Any, refs: dict[str, Any], path: str = "") -> str:
    """Content or inline nodes as Markdown, however deep; links are relative to the page's path."""
    return unwound(_markdown(nodes, refs, path))


def _markdown(nodes: Any, refs: dict[str, Any], path: str) -> Generator:
    out = []
    for n in nodes if isinstance(nodes, list) else []:
        if not isinstance(n, dict):
            continue
        match n.get("type"):
            case "paragraph":
                out.append((yield _markdown(n.get("inlineContent"), refs, path)) + "\n\n")
            case "heading":
                out.append("#" * (n.get("level") or 2) + f" {n.get('text') or (yield _markdown(n.get('inlineContent'), refs, path))}\n\n")
            case "codeListing":
                out.append(f"```{n.get('syntax') or ''}\n" + "\n".join(n.get("code") or []) + "\n```\n\n")
            case "unorderedList" | "orderedList" as kind:
                items = []
                for k, i in enumerate(n.get("items") or [], 1):
                    items.append((f"{k}. " if kind == "orderedList" else "- ") + (yield _markdown(i.get("content"), refs, path)).strip())
                out.append("\n".join(items) + "\n\n")
            case "aside":
                out.append(f"> **{n.get('style') or 'Note'}:** {(yield _markdown(n.get('content'), refs, path)).strip()}\n\n")
            case "table":
                lines = []
                for row in _cells(n):
                    cells = []
                    for c in row:
                        cells.append((yield _markdown(c, refs, path)).strip().replace("\n", " "))
                    lines += ["| " + " | ".join(cells) + " |"] + (["|" + " --- |" * len(cells)] if not lines else [])
                out.append("\n".join(lines) + "\n\n")
            case "links":
                out.append(_listed(n.get("items"), refs, path) + "\n\n")
            case "text":
                out.append(n.get("text") or "")
            case "codeVoice":
                out.append(f"`{n.get('code') or ''}`")
            case "reference":
                ident = n.get("identifier") or ""
                title = (refs.get(ident) or {}).get("title") or n.get("title") or ident
                out.append((_linked(ident, title, path) if n.get("isActive") is not False else None) or f"`{title}`")
            case "link":
                out.append(f"[{n.get('title') or n.get('destination') or ''}]({n.get('destination') or ''})")
            case "image":
                out.append(f"![{n.get('alt') or ''}]({n.get('source') or ''})")
            case t if t in _MARKS:
                out.append(_MARKS[t] + (yield _markdown(n.get("inlineContent"), refs, path)) + _MARKS[t])
            case _:
                out.append(n.get("text") or (yield _markdown(n.get("inlineContent"), refs, path)) or (yield _markdown(n.get("content"), refs, path)))
    return "".join(out)


def render_page(page: dict[str, Any], path: str) -> str:
    """A DocC page as Markdown: front matter, title, abstract, its content, and lists of links."""
    meta, refs = page.get("metadata") or {}, page.get("references") or {}
    known = [f"{p['name']} {p['introducedAt']}+" if p.get("introducedAt") else p["name"] for p in meta.get("platforms") or [] if p.get("name")]
    module = ((meta.get("modules") or [{}])[0] or {}).get("name")
    out = [write_yaml({"title": meta.get("title"), "framework": module, "role": meta.get("role"), "role_heading": meta.get("roleHeading"), "platforms": known or None, "path": path}).strip()]
    out += [f"# {meta['title']}"] if meta.get("title") else []
    out.append(markdown_of(page.get("abstract"), refs, path).strip())
    for s in page.get("primaryContentSections") or []:
        if s.get("kind") == "declarations":
            code = [("swift" if not d.get("languages") else d["languages"][0], "".join(t.get("text") or "" for t in d.get("tokens") or [])) for d in s.get("declarations") or []]
            out.append("\n\n".join(["## Declaration", *(f"```{lang}\n{text}\n```" for lang, text in code)]))
        elif s.get("kind") == "parameters":
            out.append("\n\n".join(["## Parameters", "\n".join(f"- `{p.get('name')}`: {markdown_of(p.get('content'), refs, path).strip()}" for p in s.get("parameters") or [])]))
        elif s.get("kind") != "mentions":
            out.append(markdown_of(s.get("content"), refs, path).strip())
    for part, name in (("topicSections", "Topics"), ("relationshipsSections", "Relationships"), ("seeAlsoSections", "See Also")):
        if page.get(part):
            out.append(f"## {name}")
            for g in page[part]:
                out += [f"### {g['title']}"] if g.get("title") else []
                out.append(_listed(g.get("identifiers"), refs, path))
    return "\n\n".join(x for x in out if x) + "\n"


def _page(payload: str | None) -> dict[str, Any] | None:
    try:
        page = loads(payload)
    except (TypeError, ValueError):
        return None
    return page if isinstance(page, dict) else None


def render_pages(pages: DataFrame) -> DataFrame:
    """(key, markdown) of DocC pages (key, payload); payloads that are no JSON object give null."""
    one = lambda k, p: {"markdown": None if (page := _page(p)) is None else render_page(page, k)}
    return computed(pages, ("key", "payload"), one, "markdown string", ("key",))


def render_contents(contents: DataFrame) -> DataFrame:
    """contents (key, payload: a JSON list of content nodes, of any depth) with their plain text and Markdown; null for what is no list."""
    def one(k: str, p: str) -> dict[str, Any]:
        try:
            nodes = loads(p)
        except (TypeError, ValueError):
            nodes = None
        return {"text": text_of(nodes, {}), "markdown": markdown_of(nodes, {}, k).strip()} if isinstance(nodes, list) else {"text": None, "markdown": None}

    return computed(contents, ("key", "payload"), one, "text string, markdown string", contents.columns)


def reference_keys(pages: DataFrame) -> DataFrame:
    """(from_key, to_key): what a crawl of DocC pages (key, payload) goes on to."""
    one = lambda p: None if (page := _page(p)) is None else {"to": references(page)}
    return computed(pages, ("payload",), one, "to array<string>", ("key",)).select(F.col("key").alias("from_key"), F.explode("to").alias("to_key"))


def _link_keys(node: Any) -> list[str]:
    """Keys that links in a content tree have, or may get."""
    out: dict[str, None] = {}
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, list):
            stack.extend(n)
        elif isinstance(n, dict):
            for k in (n.get("_resolvedKey"), identifier((n.get("destination") or "").replace("https://developer.apple.com", "")) if n.get("type") == "link" else None):
                if isinstance(k, str):
                    out[k] = None
            stack.extend(n.values())
    return list(out)


def consolidate(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(key, payload, added, removed, kept): content trees with their links' keys as `known` (key) has them.

    Only the keys that a page's own links have are joined to it, so that the list of all keys goes to no task whole.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("array<string>")
    def keys_of(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: _link_keys(loads(p)))

    @F.pandas_udf("payload string, added long, removed long, kept long")
    def run(payloads: pd.Series, known_: pd.Series) -> pd.DataFrame:
        rows = []
        for p, ks in zip(payloads, known_, strict=True):
            tree = loads(p)
            counts = consolidate_links(tree, set() if ks is None else set(ks))
            rows.append((dumps(tree, sort_keys=True), counts["added"], counts["removed"], counts["kept"]))
        return pd.DataFrame(rows, columns=["payload", "added", "removed", "kept"])

    linked = pages.select(F.col("key").alias("page"), F.explode(keys_of("payload")).alias("key")).join(known.select("key"), "key", "left_semi")
    own = linked.groupBy(F.col("page").alias("key")).agg(F.collect_set("key").alias("_known"))
    return pages.join(own, "key", "left").select("key", run("payload", "_known").alias("r")).select("key", "r.*")


def listed_references(pages: DataFrame) -> DataFrame:
    """(from_key, place, identifier, url): what the link sections of DocC pages (key, payload) list, in order."""
    def one(payload: str) -> dict[str, Any]:
        page = _page(payload) or {}
        refs = page.get("references") or {}
        idents = [i for part in ("topicSections", "relationshipsSections", "seeAlsoSections") for s in page.get(part) or [] for i in s.get("identifiers") or []]
        return {"listed": [{"identifier": i, "url": (refs.get(i) or {}).get("url")} for i in idents]}

    rows = computed(pages, ("payload",), one, "listed array<struct<identifier:string,url:string>>", ("key",))
    return rows.select(F.col("key").alias("from_key"), F.posexplode("listed").alias("place", "r")).select("from_key", "place", "r.identifier", "r.url")


def resolve_references(listed: DataFrame, rules: DataFrame) -> DataFrame:
    """listed references with to_key: the address's own key, else by the rule (prefix, key) with the longest prefix of it, else by the
    built-in rules for addresses, else the identifier's. Null if none knows it."""
    own = normalize_identifier(F.col("url"))
    rows = by_longest_prefix(listed.withColumn("_outer", F.when(own.isNull(), F.col("url"))), rules, "_outer", "_mapped")
    return rows.withColumn("to_key", F.coalesce(own, "_mapped", map_url_to_key(F.col("_outer")), normalize_identifier(F.col("identifier")))).drop("_outer", "_mapped")
