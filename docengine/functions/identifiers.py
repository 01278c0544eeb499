"""Identifiers and queries: normalising, splitting, intent."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a relaxed query leaves out
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "does", "for", "from", "get", "have", "how", "i", "if", "in", "into", "is", "it",
    "its", "me", "my", "of", "on", "or", "should", "that", "the", "their", "then", "there", "these", "this", "to", "use", "using", "want", "was",
    "way", "we", "were", "what", "when", "where", "which", "while", "why", "will", "with", "you", "your",
)

# Patterns of the intent classes, in order of precedence
INTENT_PATTERNS = (
    ("symbol", 0.9, r"[a-z][A-Z]"),
    ("symbol", 0.9, r"[.:]{2}"),
    ("symbol", 0.9, r"[A-Z]\w+\.(?:[a-z]\w+|[A-Z]\w+)"),
    ("symbol", 0.7, r"^[A-Z][A-Za-z0-9]+$"),
    ("error", 0.8, r"(?i)\b(error|crash|exception|fail|issue|bug|fix|troubleshoot|exc_bad|abort|segfault)\b"),
    ("howto", 0.8, r"(?i)\b(how|guide|tutorial|example|implement|create|build|use|setup|configure|add|make)\b"),
    ("concept", 0.7, r"(?i)\b(what\s+is|difference\s+between|vs\.?|overview|introduction|explain)\b"),
    ("wwdc", 0.8, r"(?i)\bwwdc\b|\b20[12]\d\b"),
)


def normalize_identifier(raw: Column) -> Column:
    """A canonical key of a reference; null for web links, empty ones, operators and empty segments."""
    i = F.regexp_replace(raw, r"^doc://[^/]+/(?:documentation/(?=.)|(?=design/.))", "")
    i = F.regexp_replace(i, r"^/(?=design/|app-store-review/)", "")
    i = F.regexp_replace(i, r"^/documentation/", "")
    i = F.regexp_replace(i, r"^documentation/", "")
    i = F.regexp_replace(F.lower(i), r"/+$", "")
    i = F.substring_index(i, "#", 1)
    bad = raw.rlike(r"^https?://") | (i == "") | i.rlike(r"(^|/)(/|$)") | i.rlike(r"(^|/)\.[.\-+*/<>=!&|^~%_]")
    return F.when(~bad, i)


def root_slug(path: Column) -> Column:
    return F.when(path != "", F.substring_index(path, "/", 1))


def camel_subwords(word: Column) -> Column:
    """Parts of a camel-case word; none if there is only one."""
    parts = F.filter(F.split(F.regexp_replace(word, "([a-z0-9])([A-Z])", "$1 $2"), " "), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """Distinct lower-cased trigrams; none for fewer than three characters. The text is lowered and cut into characters once."""
    three = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))
    none = F.array().cast("array<string>")
    cut = F.transform(F.array(F.split(F.lower(text), "")), lambda c: F.when(F.size(c) >= 3, F.array_distinct(three(c))).otherwise(none))
    return F.coalesce(cut[0], none)


def fuzzy_distance(a: Column, b: Column, most: int = 2) -> Column:
    """Edit distance, or most + 1 if it is above."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def intent(query: Column) -> Column:
    """(type, confidence) of a query."""
    q = F.trim(query)
    make = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    out = F.when(F.coalesce(q, F.lit("")) == "", make("general", 0.5))
    for kind, confidence, pattern in INTENT_PATTERNS:
        out = out.when(q.rlike(pattern), make(kind, confidence))
    return out.otherwise(make("general", 0.5))


def detect_intent(query: str | None) -> tuple[str, float]:
    """The same for one query, on the driver."""
    q = (query or "").strip()
    return next(((k, c) for k, c, p in INTENT_PATTERNS if q and re.search(p, q, re.ASCII)), ("general", 0.5))


def tokenize(query: str | None) -> list[str]:
    """Tokens of a query to be relaxed: words and dots; single digits are left out."""
    return [t for t in re.split(r"[^A-Za-z0-9_.]+", query or "") if t and not re.fullmatch(r"[0-9]", t)]


def prune_stopwords(tokens: list[str]) -> list[str]:
    return [t for t in tokens if re.search("[a-z][A-Z]", t) or t.lower() not in STOPWORDS]


def high_signal_token(tokens: list[str]) -> str | None:
    """The first camel-case token, else the longest of four characters or more (the first of those)."""
    camel = next((t for t in tokens if re.search("[a-z][A-Z]", t)), None)
    return camel or max((t for t in tokens if len(t) >= 4), key=len, default=None)


def sanitize_trigram(query: str | None) -> str:
    q = (query or "").strip()
    if not q:
        return '""'
    return q if re.fullmatch(r"[A-Za-z0-9_\s]+", q) else '"' + q.replace('"', '""') + '"'


def query_tokens(query: Column) -> Column:
    """tokenize, of a column."""
    return F.filter(F.split(F.coalesce(query, F.lit("")), r"[^A-Za-z0-9_.]+"), lambda t: (t != "") & ~t.rlike("^[0-9]$"))


def without_stopwords(tokens_: Column) -> Column:
    """prune_stopwords, of a column."""
    return F.filter(tokens_, lambda t: t.rlike("[a-z][A-Z]") | ~F.lower(t).isin(*STOPWORDS))


def high_signal(tokens_: Column) -> Column:
    """high_signal_token, of a column; null if there is none. The tokens are gone through once: a value of all of them within a lambda
    would be worked out anew for each."""
    none = F.lit(None).cast("string")

    def step(at: Column, t: Column) -> Column:
        longer = F.length(t) > F.coalesce(F.length(at["long"]), F.lit(3))
        return F.struct(F.coalesce(at["camel"], F.when(t.rlike("[a-z][A-Z]"), t)).alias("camel"), F.when(longer, t).otherwise(at["long"]).alias("long"))

    return F.aggregate(tokens_, F.struct(none.alias("camel"), none.alias("long")), step, lambda at: F.coalesce(at["camel"], at["long"]))


def trigram_query(query: Column) -> Column:
    """sanitize_trigram, of a column."""
    q = F.trim(F.coalesce(query, F.lit("")))
    return F.when(q == "", '""').when(q.rlike(r"^[A-Za-z0-9_\s]+$"), q).otherwise(F.concat(F.lit('"'), F.replace(q, F.lit('"'), F.lit('""')), F.lit('"')))
