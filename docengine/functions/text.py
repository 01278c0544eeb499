"""Text: entities, slugs, snippets, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities; &amp; goes last so that nothing is decoded twice
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "nbsp": " "}
# Families of proposal states, by prefix
STATUS_FAMILIES = (
    ("active review", "Active Review"), ("scheduled for review", "Scheduled for Review"), ("awaiting review", "Awaiting Review"), ("accepted", "Accepted"),
    ("previewing", "Previewing"), ("partially implemented", "Partially Implemented"), ("implemented", "Implemented"), ("returned for revision", "Returned for Revision"),
    ("deferred", "Deferred"), ("rejected", "Rejected"), ("withdrawn", "Withdrawn"), ("expired", "Expired"),
)


def decode_entities(text: Column) -> Column:
    """Named and numeric entities (decimal and hexadecimal); a number above the last code point stays as it is."""
    out = text
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    number = r"&#(?:0{0,6}[0-9]{1,6}|[xX]0{0,6}(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4});"

    def char(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        return F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.regexp_replace(piece, f"^{number}", ""))

    parts = F.split(out, f"(?={number})", -1)
    out = F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike(f"^{number}"), char(p)).otherwise(p)))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for char, name in (("<", "lt"), (">", "gt"), ('"', "quot")):
        out = F.replace(out, F.lit(char), F.lit(f"&{name};"))
    return F.replace(out, F.lit("'"), F.lit("&#39;"))


def slugify(text: Column) -> Column:
    """Lower case, runs of white space to a hyphen, other characters than letters, digits, _ and - left out."""
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[^\w-]", ""), "-{2,}", "-"), "^-|-$", "")


def is_safe_href(href: Column) -> Column:
    """Anchors, paths from the root (not //) and http(s) links."""
    return F.coalesce(href.rlike(r"(?i)^(#|/(?!/)|https?://)"), F.lit(False))


def readable_name(key: Column) -> Column:
    """The last segment of a key, words between hyphens with a capital first."""
    words = F.split(F.substring_index(F.coalesce(key, F.lit("")), "/", -1), "-", -1)
    return F.concat_ws(" ", F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))))


def snippet(text: Column, query: Column, most: int = 220) -> Column:
    """A window of the text around the first of the query's words, three dots where it is cut.

    A third (35 %) of the window stands before the hit. Without a hit, the text's beginning.
    """
    terms = F.filter(F.transform(F.split(F.lower(query), r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_-]+", "")), lambda t: t != "")
    # the text is an element of an array, so that it is lower-cased once and not for each word
    places = F.transform(F.array(F.lower(text)), lambda low: F.array_min(F.filter(F.transform(terms, lambda t: F.call_function("instr", low, t)), lambda p: p > 0)))
    hit = F.get(places, F.lit(0))
    start = F.greatest(hit - 1 - int(most * 0.35), F.lit(0))
    end = F.least(F.length(text), start + most)
    cut = F.trim(F.substring(text, start + 1, end - start))
    around = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(text), "...").otherwise(""))
    head = F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(F.substring(text, 1, most - 3)), F.lit("...")))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(hit.isNull(), head).otherwise(around)


def content_hash(*cols: str) -> Column:
    """SHA-256 of a row as JSON with its fields in order of names."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def evolution_status(status: Column) -> Column:
    s = F.lower(F.trim(status))
    out = F.when(F.coalesce(s, F.lit("")) == "", "Other")
    for prefix, label in STATUS_FAMILIES:
        out = out.when(s.startswith(prefix), label)
    return out.otherwise("Other")


def section_number(title: Column) -> Column:
    """The dotted number, with a letter in brackets or not, that a guideline's title begins with; null if none."""
    n = F.regexp_extract(title, r"^(\d+(?:\.\d+)*(?:\([a-z]\))?)[\s.]", 1)
    return F.when(n != "", n)


def parent_number(number: Column) -> Column:
    """1.2 of 1.2.3, and 1.2.3 of 1.2.3(a); null for a top number."""
    return F.when(number.contains("("), F.regexp_replace(number, r"\([a-z]\)$", "")).when(number.contains("."), F.regexp_replace(number, r"\.[^.]*$", ""))


def first_sentence(markdown: Column, most: int = 300) -> Column:
    """A guideline's abstract: its first sentence, headings, list marks, bold and links undone."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: ~x.startswith("#") & (F.trim(x) != ""))
    text = F.concat_ws(" ", F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[-*]\s+", ""))))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("**"), F.lit("")), r"\[([^\]]+)\]\([^)]+\)", "$1"), r"\s+", " "))
    one = F.regexp_extract(text, r"^(.+?[.!?])\s", 1)
    return F.substring(F.when(one != "", one).otherwise(text), 1, most)


def markdown_abstract(text: Column, most: int = 280) -> Column:
    """The first line after the first heading that is neither heading, tag, badge nor image; or one before it."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: x != "")
    first = F.array_position(F.transform(lines, lambda x: x.startswith("# ")), True)
    plain = lambda x: ~x.startswith("<") & ~x.startswith("[![") & ~x.startswith("![")
    fit = F.filter(lines, lambda x, i: plain(x) & ((first == 0) | (i + 1 < first) | ((i + 1 > first) & ~x.startswith("#"))))
    return F.substring(F.regexp_replace(F.get(fit, F.lit(0)), r"\s+", " "), 1, most)


def clean_transcript(text: Column) -> Column:
    """A WebVTT transcript's lines: no header, cue numbers, times, notes or tags; a line that repeats the one before goes."""
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, r"<[^<>]+>", ""), r"<[^>]+>", "")
    lines = F.transform(F.split(text, r"\r\n?|\n"), lambda x: F.trim(strip(decode_entities(x))))
    kept = F.filter(lines, lambda x: (x != "") & (x != "WEBVTT") & ~x.rlike(r"^\d+$|^NOTE|^[\d:.]+\s+-->"))
    return F.concat_ws("\n", F.filter(kept, lambda x, i: (i == 0) | (F.get(kept, F.greatest(i - 1, F.lit(0))) != x)))


def sections_digest(kinds: Column) -> Column:
    """The shape of a document's sections, an array of (section_kind, text, json, sort_order): 16 digits of a SHA-256."""
    part = F.transform(kinds, lambda s: F.concat_ws("|", F.coalesce(s["section_kind"], F.lit("")), F.length(F.coalesce(s["content_text"], F.lit(""))).cast("string"), F.coalesce(F.length(s["content_json"]), F.lit(0)).cast("string"), F.coalesce(s["sort_order"], F.lit(0)).cast("string")))
    return F.when(F.size(kinds) > 0, F.substring(F.sha2(F.concat_ws("|", part), 256), 1, 16)).otherwise("empty")


def plain_text(title: Column, abstract: Column, declaration: Column, headings: Column, sections: Column) -> Column:
    """What the body index holds: the parts that aren't empty, with an empty line between them.

    sections: an array of (heading, content_text) in order.
    """
    body = F.transform(sections, lambda s: F.concat_ws("\n", F.when(s["heading"] != "", s["heading"]), F.when(s["content_text"] != "", s["content_text"])))
    parts = F.filter(F.concat(F.array(title, abstract, declaration, headings), F.transform(body, lambda b: F.when(F.trim(b) != "", F.trim(b)))), lambda p: p.isNotNull() & (p != ""))
    return F.trim(F.regexp_replace(F.concat_ws("\n\n", parts), r"\n{3,}", "\n\n"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits: what the indexes hold."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def last_updated(html: Column) -> Column:
    """The date that a guidelines page shows as its last update; null if none."""
    found = F.trim(F.regexp_extract(html, r"Last Updated:\s*<a[^>]*>([^<]+)</a>", 1))
    return F.when(found != "", found)
