"""HTML pages: plain text, metadata and links as columns; sections and Markdown by a parser over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Generator
from html import unescape
from html.parser import HTMLParser
from typing import Any
from weakref import ref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pieces import computed
from ..functions.text import decode_entities
from ..functions.trees import unwound

# Elements that break a paragraph, and those that are left out with what they hold
BLOCK_TAGS = (
    "p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote", "pre", "section", "article", "header", "footer", "nav", "aside", "main", "figure", "figcaption",
    "details", "summary", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot",
)
STRIPPED = ("nav", "header", "footer", "script", "style", "noscript")
CONTAINERS = ("main", "article", ".content", "#content", "#contents", "body")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def _tags(names: tuple[str, ...]) -> str:
    return "|".join(names)


def strip_elements(html: Column, names: tuple[str, ...] = STRIPPED) -> Column:
    """Without the named elements and what they hold, nested in their like or not, one name after the other.

    An end tag without its element, and an element that ends itself, lose the tag alone; so do elements that never end, whose
    content stays, with that of their like inside them. Null stays null.
    """
    for name in names:
        html = F.get(F.transform(F.array(html), _without(name)), F.lit(0))
    return html


def _without(name: str) -> Callable[[Column], Column]:
    """The text between tags is kept where no element of the name is open; a depth runs over the tags, and what the outermost
    elements hold is left out as slices, so that work grows with the text."""
    tag = rf"(?i)</?{name}(?:[\s/][^>]*)?>"
    kind = lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1)
    pair = lambda begin, end: F.struct(begin.alias("begin"), end.alias("end"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.array().cast("array<struct<begin:int,end:int>>").alias("cuts"))

    def step(at: Column, x: Column) -> Column:
        outside, ends = at["depth"] == 0, (at["depth"] == 1) & (x["kind"] == -1)
        begin = F.when(outside, x["i"]).otherwise(at["begin"])
        cuts = F.when(outside & (x["kind"] <= 0), F.array_append(at["cuts"], pair(x["i"], x["i"]))).when(ends, F.array_append(at["cuts"], pair(at["begin"], x["i"]))).otherwise(at["cuts"])
        return F.struct(F.greatest(at["depth"] + x["kind"], F.lit(0)).alias("depth"), begin.alias("begin"), cuts.alias("cuts"))

    def kept(x: Column) -> Column:
        """Pieces from the end of a cut (or the beginning) to the beginning of the next one (or the end)."""
        pieces, cuts = x["pieces"], x["cuts"]
        first = lambda k: F.when(k == 0, 0).otherwise(F.get(cuts, k - 1)["end"] + 1)
        last = lambda k: F.coalesce(F.get(cuts, k)["begin"], F.size(pieces) - 1)
        spans = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: F.slice(pieces, first(k) + 1, last(k) - first(k) + 1))
        return F.concat_ws("", F.flatten(spans))

    def without(html: Column) -> Column:
        tags = F.transform(F.regexp_extract_all(html, F.lit(tag), 0), lambda t, i: F.struct(i.alias("i"), kind(t).alias("kind")))
        found = F.struct(F.split(html, tag, -1).alias("pieces"), F.aggregate(tags, start, step)["cuts"].alias("cuts"))
        return F.when(html.rlike(tag), F.get(F.transform(F.array(found), kept), F.lit(0))).otherwise(html)

    return without


def plain_text(html: Column) -> Column:
    """Text of a fragment: block elements as empty lines, other tags as spaces, entities decoded, white space tidied."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"<\?[^?]*\?>", ""), r"(?is)<svg.*?</svg>", "")
    s = F.regexp_replace(s, rf"(?i)</?(?:{_tags(BLOCK_TAGS)})(?![A-Za-z0-9_])[^>]*>", "\n\n")
    s = decode_entities(F.regexp_replace(s, r"</?\w+[^>]*>", " "))
    lines = F.transform(F.split(s, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.btrim(F.regexp_replace(F.concat_ws("\n", lines), r"\n{3,}", "\n\n"), F.lit("\n "))


def container(html: Column) -> Column:
    """What the first of main, article or body holds; else everything."""
    out = None
    for tag in ("main", "article", "body"):
        part = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1)
        out = F.when(part != "", part) if out is None else out.when(part != "", part)
    return out.otherwise(html)


def title(html: Column) -> Column:
    t = F.trim(plain_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(t != "", t)


def meta_content(html: Column, attribute: str, name: str) -> Column:
    """A meta element's content, whichever attribute comes first."""
    key = rf"{attribute}\s*=\s*[\"']{name}[\"']"
    a = F.regexp_extract(html, rf"(?i)<meta[^>]+{key}[^>]+content\s*=\s*[\"']([^\"']*)[\"'][^>]*>", 1)
    b = F.regexp_extract(html, rf"(?i)<meta[^>]+content\s*=\s*[\"']([^\"']*)[\"'][^>]+{key}[^>]*>", 1)
    out = F.trim(decode_entities(F.when(a != "", a).otherwise(b)))
    return F.when(out != "", out)


def redirect_target(html: Column) -> Column:
    """Where a short page that says it has moved points to; null for other pages."""
    stub = (F.length(html) <= 2048) & html.rlike(r"(?i)<title[^>]*>\s*(Redirecting|Document Has Moved|Moved Permanently)")
    finds = (
        r"(?i)<link[^>]+rel\s*=\s*[\"']canonical[\"'][^>]+href\s*=\s*[\"']([^\"']+)[\"']", r"(?i)<meta[^>]+http-equiv\s*=\s*[\"']refresh[\"'][^>]+content\s*=\s*[\"'][^\"']*url\s*=\s*([^\"';]+)",
        r"(?i)<a[^>]+href\s*=\s*[\"']([^\"']+)[\"']",
    )
    found = F.coalesce(*[F.when(F.regexp_extract(html, r, 1) != "", F.trim(F.regexp_extract(html, r, 1))) for r in finds])
    return F.when(stub, found)


def links(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, place, href, section) of the links of pages; section is the region that began last before the link."""
    region = r"<(article|nav|aside|header|footer)\b[^>]*>"
    parts = F.split(F.col(html), f"(?i)(?={region})")
    rows = pages.select(id_col, F.posexplode(parts).alias("part_no", "part"))
    tag, cls = F.lower(F.regexp_extract("part", f"(?i)^{region}", 1)), F.lower(F.regexp_extract("part", r"(?i)^<\w+\b[^>]*?class\s*=\s*\"([^\"]*)\"", 1))
    name = (
        F.when(tag == "", "other").when(cls.contains("breadcrumb"), "breadcrumb").when(cls.contains("topics") | cls.contains("see-also"), "related").when(cls.contains("symbols-detail"), "sidebar")
        .when(tag == "aside", "sidebar").when(tag == "nav", "breadcrumb").when(tag.isin("header", "footer"), "chrome").otherwise(tag)
    )
    hrefs = F.regexp_extract_all("part", F.lit(r"(?i)<a\s[^>]*href\s*=\s*\"([^\"]+)\""), 1)
    return rows.select(id_col, "part_no", name.alias("section"), F.posexplode(hrefs).alias("place", "href"))


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], up: "_Node | None") -> None:
        self.tag, self.attrs, self.items = tag, attrs, []
        # weak, so that a page's tree is freed with its root and doesn't wait for the collector of cycles
        self._up = None if up is None else ref(up)

    @property
    def up(self) -> "_Node | None":
        return None if self._up is None else self._up()


class _Tree(HTMLParser):
    """A forgiving tree: end tags close the nearest element of their name, if there is one."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=False)
        self.root = self.at = _Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node: _Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)

    def handle_entityref(self, name: str) -> None:
        self.at.items.append(unescape(f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.at.items.append(unescape(f"&#{name};"))


def _walk(node: _Node) -> Any:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(x for x in reversed(n.items) if isinstance(x, _Node))


def _is(node: _Node, selector: str) -> bool:
    if selector[0] == ".":
        return selector[1:] in node.attrs.get("class", "").split()
    return node.attrs.get("id") == selector[1:] if selector[0] == "#" else node.tag == selector


def _flat(node: _Node | str, raw: bool = False) -> str:
    """Text of a node, blocks apart."""
    return unwound(_text(node, raw))


def _text(node: _Node | str, raw: bool) -> Generator:
    if isinstance(node, str):
        return node
    if node.tag in STRIPPED or node.tag == "svg":
        return ""
    parts = []
    for x in node.items:
        parts.append(x if isinstance(x, str) else (yield _text(x, raw)))
    inner = "".join(parts)
    return f"\n\n{inner}\n\n" if node.tag in BLOCK_TAGS and not raw else inner


def _tidy(text: str) -> str:
    out: list[str] = []
    for line in text.split("\n"):
        line = " ".join(line.split())
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def to_markdown(node: _Node | str, resolve: Callable[[str], str | None] | None = None) -> str:
    """Markdown of a tree: code, links, emphasis, lists, definitions and headings; fences keep their white space."""
    fences: list[str] = []

    def inner(n: _Node) -> Generator:
        parts = []
        for x in n.items:
            parts.append(x if isinstance(x, str) else (yield go(x)))
        return "".join(parts)

    def go(n: _Node | str) -> Generator:
        if isinstance(n, str):
            return n
        text = lambda: " ".join(_flat(n, raw=True).split())
        match n.tag:
            case t if t in STRIPPED or t == "svg":
                return ""
            case "pre":
                fences.append(_flat(n, raw=True).strip("\n"))
                return f"\n\n\x00{len(fences) - 1}\x00\n\n"
            case "code":
                return f"`{t}`" if (t := text().replace("`", "'")) else ""
            case "a" if "href" in n.attrs:
                to = resolve(n.attrs["href"]) if resolve else n.attrs["href"]
                return (f"[{t}]({to})" if to is not None else t) if (t := text()) else ""
            case "strong" | "b":
                return f"**{t}**" if (t := text()) else ""
            case "em" | "i":
                return f"*{t}*" if (t := text()) else ""
            case "ul" | "ol":
                items = []
                for x in n.items:
                    if isinstance(x, _Node) and x.tag == "li":
                        items.append(" ".join((yield inner(x)).split()))
                return "\n\n" + "\n".join(f"{f'{k}.' if n.tag == 'ol' else '-'} {x}" for k, x in enumerate((x for x in items if x), 1)) + "\n\n"
            case "dl":
                out, term = [], ""
                for x in (x for x in n.items if isinstance(x, _Node)):
                    t = " ".join((yield inner(x)).split())
                    if x.tag == "dd":
                        out.append(f"**{term}** — {t}" if term and t else t or f"**{term}**")
                        term = ""
                    elif t:
                        if term:
                            out.append(f"**{term}**")
                        term = t
                return "\n\n" + "\n\n".join([*out, *([f"**{term}**"] if term else [])]) + "\n\n"
            case "h3" | "h4" | "h5" | "h6":
                return f"\n\n{'#' * int(n.tag[1])} {t}\n\n" if (t := text()) else ""
            case t if t in BLOCK_TAGS:
                return f"\n\n{(yield inner(n))}\n\n"
        return (yield inner(n))

    out = _tidy(unwound(go(node)))
    for k, code in enumerate(fences):
        out = out.replace(f"\x00{k}\x00", f"```\n{code}\n```")
    return out


def parse(html: str | None, preserve: bool = False, selector: str | None = None, resolve: Callable[[str], str | None] | None = None) -> dict[str, Any]:
    """title, description and sections (heading, content) of a page: split at h2, or at h3 if there is none."""
    if not html:
        return {"title": None, "description": None, "sections": []}
    tree = _Tree(html).root
    nodes = list(_walk(tree))
    box = next((n for s in ([selector] if selector else []) + list(CONTAINERS) for n in nodes if _is(n, s)), tree)
    find = lambda tag: next((n for n in nodes if n.tag == tag), None)
    words = lambda n: " ".join(_flat(n, raw=True).split()) or None if n is not None else None
    description = next((n.attrs.get("content", "").strip() or None for n in nodes if n.tag == "meta" and n.attrs.get("name", "").lower() == "description"), None)
    split = "h2" if any(n.tag == "h2" for n in _walk(box)) else "h3"
    parts: list[tuple[_Node | None, list]] = [(None, [])]

    around: set[int] = set()
    for n in _walk(box):
        up = n.up if n.tag == split else None
        while up is not None and id(up) not in around:
            around.add(id(up))
            up = up.up
    # sections open at each heading, wherever it is nested
    todo: list[_Node | str] = list(reversed(box.items))
    while todo:
        x = todo.pop()
        if isinstance(x, _Node) and x.tag == split:
            parts.append((x, []))
        elif isinstance(x, _Node) and x.tag not in STRIPPED and id(x) in around:
            todo.extend(reversed(x.items))
        else:
            parts[-1][1].append(x)
    sections = []
    for head, items in parts:
        piece = _Node("div", {}, None)
        piece.items = items
        content = to_markdown(piece, resolve) if preserve else _tidy(_flat(piece))
        heading = words(head)
        if heading or content:
            sections.append({"heading": heading, "content": content})
    return {"title": words(find("title")) or words(find("h1")), "description": description, "sections": sections or [{"heading": None, "content": ""}]}


def sections(pages: DataFrame, html: str = "html", id_col: str = "page_id", preserve: bool = False) -> DataFrame:
    """(id, title, description, sort_order, heading, content) of pages, by the parser."""
    kind = "title string, description string, sections array<struct<heading:string,content:string>>"
    rows = computed(pages, (html,), lambda x: parse(x, preserve), kind, (id_col,))
    return rows.select(id_col, "title", "description", F.posexplode("sections").alias("sort_order", "s")).select(id_col, "title", "description", "sort_order", "s.heading", "s.content")


def markdown(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, markdown) of whole pages."""
    return computed(pages, (html,), lambda x: {"markdown": to_markdown(_Tree(x).root) if x else ""}, "markdown string", (id_col,))
