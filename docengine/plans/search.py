"""Ranked search: filters, tiers, merge, relaxation, rules, fusion, diversity, one page."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import detect_intent, high_signal_token, prune_stopwords, tokenize
from ..functions.text import snippet
from ..model import RESULT_COLUMNS
from ..operators import bounded, filters, ranking, search, semantic
from .deadline import Deadline, Late

#: Rows that a page's last steps on the driver are given at most.
WINDOW = 300


@dataclass
class Corpus:
    """Documents with their indexes; each is a DataFrame that is built once for a corpus version."""

    docs: DataFrame
    postings: DataFrame
    stats: tuple[int, float]
    grams: DataFrame
    parts: DataFrame | None = None
    body: DataFrame | None = None
    body_stats: tuple[int, float] = (0, 1.0)
    body_blocks: DataFrame | None = None
    synonyms: DataFrame | None = None
    chunks: DataFrame | None = None
    embed: Callable[[str], Sequence[float]] | None = None
    edges: DataFrame | None = None
    roots: DataFrame | None = None


def build(docs: DataFrame, body: bool = True, **more: Any) -> Corpus:
    """Stores the indexes of a corpus, each sorted by its term."""
    postings, stats = search.store(docs)
    blocks, own_stats = bounded.store(docs, {"body": 1.0}) if body else (None, (0, 1.0))
    own = bounded.postings(blocks) if body else None
    return Corpus(docs, postings, stats, search.store_trigrams(docs), search.store_parts(docs), own, own_stats, blocks, **more)


def _in_bodies(corpus: Corpus, docs: DataFrame, query: search.Query, limit: int) -> DataFrame:
    """(id, score) of the best bodies: from blocks, if there are any and places don't matter."""
    if corpus.body_blocks is None or any(g.placed for g in query.groups):
        return search.match(corpus.body, corpus.body_stats, query, {"body": 1.0})
    return bounded.best(corpus.body_blocks, corpus.body_stats, query, limit, docs).rows


@dataclass
class Answer:
    results: list[dict[str, Any]] = field(default_factory=list)
    total: int = 0
    intent: tuple[str, float] = ("general", 0.5)
    relaxed: str | None = None
    has_more: bool = False
    missing: list[str] = field(default_factory=list)

    @property
    def partial(self) -> bool:
        """Whether tiers are missing that the deadline cut off."""
        return bool(self.missing)


def ranked(corpus: Corpus, query: str, f: filters.Filters = filters.Filters(), limit: int = 100, offset: int = 0, fuzzy: bool = True, deep: bool = True, eager: bool = True, fast: bool = False, rrf: bool = False, lam: float = 0.7, seconds: float | None = None) -> Answer:
    """One page of a search. Filters hold before any limit; tiers run in order until the window is full.

    The strict tiers always run to their end. What lies deeper (fuzzy titles, bodies, meaning) is cancelled once `seconds` have passed
    since the search began; the answer is then made of the others and names those that are missing.
    """
    q = query.strip()
    if not q:
        return Answer()
    deadline = Deadline(corpus.docs.sparkSession, seconds)
    window = min(max(limit, 1) + max(offset, 0), WINDOW)
    frameworks = list(f.frameworks)
    if frameworks and corpus.roots is not None and (root := filters.resolve_root(corpus.roots, frameworks[0]).first()):
        frameworks[0] = root["slug"]
    if frameworks and corpus.synonyms is not None:
        frameworks += [r[0] for r in search.expand_synonyms(corpus.synonyms, frameworks[0]).collect() if r[0] not in frameworks]
    f = filters.Filters(**{**f.__dict__, "frameworks": tuple(frameworks)})
    docs = filters.apply(corpus.docs, f)
    rows: list[dict[str, Any]] = []
    seen: set[str] = set()
    missing: list[str] = []

    def add(df: DataFrame, quality: str | None, extra: Sequence[str] = ()) -> int:
        before = len(rows)
        for r in df.select(*[c for c in (*RESULT_COLUMNS, *extra) if c in df.columns]).collect():
            d = r.asDict()
            if d["path"] not in seen:
                seen.add(d["path"])
                rows.append(d | {"match_quality": quality or search.TIERS[d["tier"]]})
        return len(rows) - before

    def deeper(name: str, work: Callable[[], Any], otherwise: Any = None) -> Any:
        try:
            return deadline.run(work)
        except Late:
            missing.append(name)
            return otherwise

    add(search.title_exact(docs, q, window), "exact")
    if not (fast and len(rows) >= window):
        n = add(search.full_text(docs, corpus.postings, corpus.stats, q, window), None, ("tier",))
        narrowed = bool(f.frameworks or f.kind or len(f.sources) == 1)
        if not (fast and (n >= window or (narrowed and rows))):
            add(search.substring(docs, q, window, corpus.grams), "substring")
    if len(rows) < 5 and len(q) >= 4 and fuzzy:
        near = lambda: search.fuzzy_by_trigrams(docs, corpus.grams, q, window) if corpus.parts is None else search.fuzzy(docs, corpus.parts, q, window)
        deeper("fuzzy", lambda: add(near(), "fuzzy", ("distance",)))
    if corpus.body is not None and deep and (len(rows) < window or not eager):
        deeper("body", lambda: add(docs.join(_in_bodies(corpus, docs, search.parse(q), window), "id").orderBy(F.col("score").desc(), "id").limit(window), "body"))
    relaxed = None
    if not rows and len(q) >= 4 and '"' not in q and len(words := tokenize(q)) >= 3:
        kept = prune_stopwords(words)
        steps: list[tuple[str, str, Callable[[], DataFrame]]] = []
        if kept:
            steps.append(("pruned", "relaxed", lambda: search.full_text(docs, corpus.postings, corpus.stats, q, window, search.parse(" ".join(kept)))))
        if len(kept) >= 2:
            some = search.Query(tuple(search.Group((), (t.lower(),)) for t in kept), any=True)
            steps.append(("pruned-or", "relaxed-or", lambda: search.full_text(docs, corpus.postings, corpus.stats, q, window, some)))
        if (token := high_signal_token(kept or words)) and len(token) >= 3:
            steps.append(("trigram", "relaxed-token", lambda: search.substring(docs, token, window, corpus.grams)))
        relaxed = next((name for name, quality, run in steps if add(run(), quality)), None)
    intent = detect_intent(q)
    if rows:
        rows = _scored(corpus, rows, q, intent[0])
    if corpus.chunks is not None and corpus.embed is not None and not fast:
        rows = deeper("semantic", lambda: _fused(corpus, docs, rows, q, window, rrf, lam), rows)
    page = rows[offset : offset + limit]
    return Answer(_enriched(corpus, page, q), len(rows), intent, relaxed, len(rows) >= offset + limit and len(page) == limit, missing)


def _scored(corpus: Corpus, rows: list[dict[str, Any]], q: str, intent: str) -> list[dict[str, Any]]:
    """Rules as one projection over the window's rows, then the order with its tolerance."""
    spark = corpus.docs.sparkSession
    small = spark.createDataFrame(
        [(i, r["match_quality"], r["path"], r["title"], r.get("role_heading") or r.get("role"), r["source_type"], r["url_depth"], r["is_release_notes"]) for i, r in enumerate(rows)],
        "i int, match_quality string, path string, title string, kind string, source_type string, url_depth int, is_release_notes boolean",
    )
    scores = {r[0]: r[1] for r in small.select("i", ranking.rule_score(q, intent)).collect()}
    return ranking.rerank_rows([r | {"score": scores[i]} for i, r in enumerate(rows)])


def _fused(corpus: Corpus, docs: DataFrame, rows: list[dict[str, Any]], q: str, window: int, rrf: bool, lam: float) -> list[dict[str, Any]]:
    spark = corpus.docs.sparkSession
    found = semantic.search(corpus.chunks, corpus.embed(q)).withColumnRenamed("document_id", "id")
    hits = [r.asDict() for r in docs.join(F.broadcast(found), "id").orderBy(F.col("score").desc(), "id").collect()]
    if not hits:
        return rows
    by_path = {r["path"]: r for r in rows} | {h["path"]: {k: h[k] for k in RESULT_COLUMNS if k in h} | {"match_quality": "semantic"} for h in hits if h["path"] not in {r["path"] for r in rows}}
    lists = [(0, r["path"], i, 1.0, float(r["score"])) for i, r in enumerate(rows, 1)] + [(1, h["path"], i, 0.6, float(h["score"])) for i, h in enumerate(hits, 1)]
    df = spark.createDataFrame(lists, "list int, key string, rank int, weight double, score double")
    fused = {r["key"]: r["fused"] for r in (ranking.weighted_rrf(df) if rrf else ranking.hybrid_fusion(df)).collect()}
    lexical = {r["path"]: i for i, r in enumerate(rows)}
    out = sorted(by_path.values(), key=lambda r: (-fused[r["path"]], lexical.get(r["path"], len(lexical))))
    exact = [r for r in out if r["match_quality"] == "exact"]
    if 0 < len(exact) <= 5:
        out = sorted(exact, key=lambda r: lexical[r["path"]]) + [r for r in out if r["match_quality"] != "exact"]
    code = {h["path"]: h["code"] for h in hits}
    head = min(len(out), max(window, 20))
    return ranking.mmr([r | {"score": fused[r["path"]]} for r in out[:head]], lambda r: code.get(r["path"]), ranking.hamming_similarity, min(1.0, max(0.0, lam))) + out[head:]


def _enriched(corpus: Corpus, page: list[dict[str, Any]], q: str) -> list[dict[str, Any]]:
    """Snippets and counts of related documents, for the page alone."""
    if not page:
        return page
    rows = corpus.docs.where(F.col("path").isin(*[r["path"] for r in page]))
    text = {r[0]: r[1] for r in rows.select("path", snippet(F.col("body"), F.lit(q))).collect()} if "body" in corpus.docs.columns else {}
    related = {}
    if corpus.edges is not None:
        related = {r[0]: r[1] for r in corpus.edges.where(F.col("from_key").cast("string").isin(*[r["path"] for r in page])).groupBy("from_key").count().collect()}
    label = {"exact": "exact", "prefix": "partial", "contains": "partial", "match": "partial"}
    return [r | {"snippet": text.get(r["path"]), "related_count": related.get(r["path"], 0), "confidence": label.get(r["match_quality"], "approximate")} for r in page]
