"""Named queries over the driver's tables, one or more for each operator, with the same in SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus
from .corpus import CORPUS_SQL, CRAWL_SQL, EDGES_SQL, LOG_SQL, PAGES_SQL, ROOTS_SQL, SECTIONS_SQL, table
from .functions import identifiers, stemming, text, urls, versions
from .operators import bounded, chunks, client_search, corpus_stats, filters, graph, html, maintenance, ranking, search, semantic
from .plans import search as plan
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401 - the names that users of this module know
from .session import shared_dir
from .sources import snapshot
from .sources.versions import VersionedTables
from .streaming import incremental

Q = "the and"


# ---- search ----------------------------------------------------------------------------------------------------------

_FIELDS_SQL = "[(title, 10.0), (abstract, 5.0), (declaration, 3.0), (headings, 2.0), (key, 1.0)]"


def _postings_sql(fields: dict[str, float]) -> str:
    each = " UNION ALL ".join(f"SELECT id, unnest(list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term, {w}::DOUBLE AS w FROM corpus" for c, w in fields.items())
    return f"tok AS ({each}), len AS (SELECT id, count(*)::DOUBLE AS length FROM tok GROUP BY id), post AS (SELECT term, id, sum(w) AS tf FROM tok GROUP BY term, id)"


def _match_sql(groups: list[str], need: int) -> str:
    """groups: SQL tests of a term."""
    per = " UNION ALL ".join(f"SELECT {g} AS g, id, sum(tf) AS tf FROM post WHERE {test} GROUP BY id" for g, test in enumerate(groups))
    return f"""stat AS (SELECT (SELECT count(*) FROM corpus)::DOUBLE AS n, (SELECT sum(length) FROM len) / (SELECT count(*) FROM corpus) AS mean),
        per AS ({per}), dfs AS (SELECT g, count(*) AS df FROM per GROUP BY g),
        hit AS (SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS k
                FROM per JOIN dfs USING (g) JOIN len USING (id), stat GROUP BY id HAVING count(*) >= {need})"""


_STORED: dict[tuple, tuple] = {}


def _index(spark: SparkSession, sf_dir: str, fields: dict[str, float] = search.FIELDS) -> tuple[DataFrame, DataFrame, tuple[int, float]]:
    """The stored index of the corpus; searches of one application share it."""
    docs, key = corpus.documents(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir, tuple(fields))
    if key not in _STORED:
        _STORED[key] = search.store(docs, fields)
    return docs, *_STORED[key]


def _body_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, float]]:
    """The stored blocks of the corpus' bodies."""
    key = (spark.sparkContext.applicationId, sf_dir, "body blocks")
    if key not in _STORED:
        _STORED[key] = bounded.store(corpus.documents(spark, sf_dir), {"body": 1.0})
    return _STORED[key]


_TIER_SQL = "CASE WHEN lower(title) = '{q}' OR lower(key) = '{q}' THEN 0 WHEN starts_with(lower(title), '{q}') THEN 1 WHEN contains(lower(title), '{q}') THEN 2 ELSE 3 END::INT"


@query(f"WITH {CORPUS_SQL}, {_postings_sql(search.FIELDS)}, {_match_sql(["starts_with(term, 'the')", "starts_with(term, 'and')"], 2)} SELECT id, {_TIER_SQL.format(q=Q)} AS tier, score FROM hit JOIN corpus USING (id) ORDER BY tier, score DESC, id LIMIT 50")
def search_fulltext_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, postings, stats = _index(spark, sf_dir)
    return search.full_text(docs, postings, stats, Q, 50).select("id", "tier", "score")


@query(f"WITH {CORPUS_SQL}, {_postings_sql(search.FIELDS)}, {_match_sql(["starts_with(term, 'the')", "starts_with(term, 'and')"], 2)} SELECT id, {_TIER_SQL.format(q=Q)} AS tier, score FROM hit JOIN corpus USING (id) WHERE (language IS NULL OR language IN ('en', 'both')) AND NOT is_deprecated AND source_type IN ('wwdc', 'hig', 'apple-docc') ORDER BY tier, score DESC, id LIMIT 50")
def search_fulltext_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, postings, stats = _index(spark, sf_dir)
    docs = filters.apply(docs, filters.Filters(language="en", deprecated="exclude", sources=filters.parse_sources("wwdc, HIG,apple-docc")))
    return search.full_text(docs, postings, stats, Q, 50).select("id", "tier", "score")


@query(f"WITH {CORPUS_SQL}, {_postings_sql({'body': 1.0})}, {_match_sql(["starts_with(term, 'the')", "starts_with(term, 'and')"], 2)} SELECT id, score FROM hit ORDER BY score DESC, id LIMIT 50")
def search_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, stats = _body_blocks(spark, sf_dir)
    return search.match(bounded.postings(blocks), stats, search.parse(Q)).orderBy(F.col("score").desc(), "id").limit(50)


@query(f"WITH {CORPUS_SQL}, {_postings_sql({'body': 1.0})}, {_match_sql(["term = 'thereand'", "starts_with(term, 'les')"], 1)} SELECT id, score FROM hit ORDER BY score DESC, id LIMIT 50")
def search_body_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best bodies from the blocks of postings that can hold them."""
    blocks, stats = _body_blocks(spark, sf_dir)
    some = search.Query((search.Group((), ("thereand",)), search.Group(("les",))), any=True)
    return bounded.best(blocks, stats, some, 50).rows


@query(f"WITH {CORPUS_SQL}, {_postings_sql(search.FIELDS)}, {_match_sql(["term = 'thereand'", "term = 'erenst'", "term = 'les'"], 1)} SELECT id, score FROM hit ORDER BY score DESC, id LIMIT 50")
def relax_pruned_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, postings, stats = _index(spark, sf_dir)
    kept = identifiers.prune_stopwords(identifiers.tokenize("how to use the thereand and erenst with les"))
    parsed = search.Query(tuple(search.Group((), (t,)) for t in kept), any=True)
    return search.match(postings, stats, parsed).orderBy(F.col("score").desc(), "id").limit(50)


_TREE_SQL = """seen AS (SELECT id, bool_or(g = 0) AS a, bool_or(g = 1) AS b, bool_or(g = 2) AS c FROM per GROUP BY id)"""


@query(f"WITH {CORPUS_SQL}, {_postings_sql(search.FIELDS)}, {_match_sql(["starts_with(term, 'the')", "term = 'and'", "term = 'of'"], 1)}, {_TREE_SQL} SELECT id, score FROM hit JOIN seen USING (id) WHERE a AND NOT b OR c ORDER BY score DESC, id LIMIT 50")
def search_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators as they are written: NOT binds closer than OR."""
    docs, postings, stats = _index(spark, sf_dir)
    return search.match(postings, stats, search.parse("the* NOT and OR of")).orderBy(F.col("score").desc(), "id").limit(50)


@query(f"WITH {CORPUS_SQL}, {_postings_sql(search.FIELDS)}, {_match_sql(["starts_with(term, 'the')", "term = 'and'", "term = 'of'"], 1)}, {_TREE_SQL} SELECT id, score FROM hit JOIN seen USING (id) WHERE a AND (b OR c) ORDER BY score DESC, id LIMIT 50")
def search_boolean_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, postings, stats = _index(spark, sf_dir)
    return search.match(postings, stats, search.parse("the* AND (and OR of)")).orderBy(F.col("score").desc(), "id").limit(50)


_PLACES_SQL = "pl AS (" + " UNION ALL ".join(
    f"SELECT id, {k} AS f, {w}::DOUBLE AS w, unnest(l) AS term, generate_subscripts(l, 1) AS p FROM (SELECT id, list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS l FROM corpus)"
    for k, (c, w) in enumerate(search.FIELDS.items())
) + ")"
_STAT_SQL = "stat AS (SELECT (SELECT count(*) FROM corpus)::DOUBLE AS n, (SELECT sum(length) FROM len) / (SELECT count(*) FROM corpus) AS mean)"


def _placed_sql(*groups: str) -> str:
    """groups: SQL of (id, w, f, p), the places that count, of each group; documents have all of them."""
    per = " UNION ALL ".join(f"SELECT {g} AS g, id, sum(w) AS tf FROM (SELECT DISTINCT id, w, f, p FROM ({sql})) GROUP BY id" for g, sql in enumerate(groups))
    return f"""WITH {CORPUS_SQL}, {_postings_sql(search.FIELDS)}, {_PLACES_SQL}, {_STAT_SQL}, per AS ({per}), dfs AS (SELECT g, count(*) AS df FROM per GROUP BY g)
        SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
        FROM per JOIN dfs USING (g) JOIN len USING (id), stat GROUP BY id HAVING count(*) = {len(groups)} ORDER BY score DESC, id LIMIT 50"""


_PAIR_SQL = "SELECT a.id, a.w, a.f, a.p FROM pl a JOIN pl b ON a.id = b.id AND a.f = b.f AND b.p BETWEEN {low} AND {high} WHERE a.term = '{a}' AND b.term = '{b}'"


@query(_placed_sql(_PAIR_SQL.format(low="a.p + 1", high="a.p + 1", a="the", b="and")))
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the places in the index alone."""
    _, postings, stats = _index(spark, sf_dir)
    return search.match(postings, stats, search.parse('"The and"')).orderBy(F.col("score").desc(), "id").limit(50)


@query(_placed_sql(" UNION ALL ".join(_PAIR_SQL.format(low="a.p", high="a.p + 4", a=a, b=b) for a, b in (("the", "of"), ("of", "the")))))
def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with three others between them at most, in either order."""
    _, postings, stats = _index(spark, sf_dir)
    return search.match(postings, stats, search.parse("NEAR(the of, 3)")).orderBy(F.col("score").desc(), "id").limit(50)


@query(_placed_sql("SELECT * FROM pl WHERE term = 'the' AND f = 0", "SELECT * FROM pl WHERE starts_with(term, 'an') AND f IN (1, 3)"))
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in the fields that the query names."""
    _, postings, stats = _index(spark, sf_dir)
    return search.match(postings, stats, search.parse('title: "the" AND {abstract headings}: "an"*')).orderBy(F.col("score").desc(), "id").limit(50)


def _porter_sql(word: str) -> str:
    """Porter's steps one CTE after the other, from the column of a table `vocab`; the last one is `stems` (term, stem)."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    m1, is1, m2 = f"^({c})?{v}{c}", f"^({c})?{v}{c}({v})?$", f"^({c})?{v}{c}{v}{c}"
    vowel, short = f"^({c})?[aeiouy]", f"^{c}[aeiouy][^aeiouwxy]$"
    has = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"
    cut = lambda n: f"w[:-{n + 1}]"
    ctes = [f"p0 AS (SELECT {word} AS term, {word} AS w FROM vocab WHERE {has(word, '^[a-z]{3,}$')})"]

    def step(k: int, *selects: str) -> None:
        ctes.append(f"p{k} AS (" + "SELECT term, " + ", ".join(selects) + f" FROM p{k - 1})")

    step(1, f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {cut(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {cut(1)} ELSE w END AS w")
    step(2, f"CASE WHEN w LIKE '%eed' THEN NULL WHEN w LIKE '%ed' AND {has(cut(2), vowel)} THEN {cut(2)} WHEN w LIKE '%ing' AND {has(cut(3), vowel)} THEN {cut(3)} END AS s, CASE WHEN w LIKE '%eed' AND {has(cut(3), m1)} THEN {cut(1)} ELSE w END AS w")
    step(3, f"CASE WHEN s IS NULL THEN w WHEN {has('s', '(at|bl|iz)$')} OR {has('s', short)} THEN s || 'e' WHEN s[-1] = s[-2] AND length(s) > 1 AND {has('s', '[^aeiouylsz]$')} THEN s[:-2] ELSE s END AS w")
    step(4, f"CASE WHEN w LIKE '%y' AND {has(cut(1), vowel)} THEN {cut(1)} || 'i' ELSE w END AS w")
    k = 4
    for rules in (stemming.STEP_2, stemming.STEP_3, dict.fromkeys(stemming.STEP_4, "")):
        step(k + 1, f"w, regexp_extract(w, '({'|'.join(rules)})$') AS s")
        step(k + 2, "w, s, w[:length(w) - length(s)] AS b")
        put = "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"
        test = has("b", m1) if k < 8 else f"{has('b', m2)} AND (s <> 'ion' OR {has('b', '[st]$')})"
        step(k + 3, f"CASE WHEN s <> '' AND {test} THEN b || {put} ELSE w END AS w")
        k += 3
    step(k + 1, f"CASE WHEN w LIKE '%e' AND ({has(cut(1), m2)} OR {has(cut(1), is1)} AND NOT {has(cut(1), short)}) THEN {cut(1)} ELSE w END AS w")
    step(k + 2, f"CASE WHEN w LIKE '%ll' AND {has(cut(1), m2)} THEN {cut(1)} ELSE w END AS w")
    return f"{', '.join(ctes)}, stems AS (SELECT term, w AS stem FROM p{k + 2} UNION ALL SELECT {word}, {word} FROM vocab WHERE NOT {has(word, '^[a-z]{3,}$')})"


@query(f"WITH {CORPUS_SQL}, tok AS (SELECT DISTINCT unnest(string_split_regex(lower(body), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM corpus), vocab AS (SELECT term FROM tok WHERE term <> ''), {_porter_sql('term')} SELECT term, stem FROM stems")
def stems_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of each word of all texts."""
    words = corpus.documents(spark, sf_dir).select(F.explode(text.tokens(F.col("body"))).alias("term")).distinct()
    return words.select("term", stemming.porter(F.col("term")).alias("stem"))


@query(f"""WITH {CORPUS_SQL}, {_postings_sql(search.FIELDS).replace('post AS', 'words AS')}, vocab AS (SELECT DISTINCT term FROM words), {_porter_sql('term')},
    post AS (SELECT stem AS term, id, sum(tf) AS tf FROM words JOIN stems USING (term) GROUP BY ALL), {_match_sql(["term = 'tion'", "term = 'eate'"], 1)} SELECT id, score FROM hit ORDER BY score DESC, id LIMIT 50""")
def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the query find all words of their stem."""
    _, postings, stats = _index(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, "stems")
    if key not in _STORED:
        _STORED[key] = (search.store_stemmed(postings),)
    asked = search.Query((search.Group((), ("tioning",)), search.Group((), ("eates",))), any=True)
    return search.match(_STORED[key][0], stats, search.stemmed_query(asked, postings)).orderBy(F.col("score").desc(), "id").limit(50)


@query(f"WITH {CORPUS_SQL} SELECT id, key, title FROM corpus WHERE lower(title) = (SELECT lower(title) FROM corpus WHERE id = 1) ORDER BY role <> 'symbol', length(key), key LIMIT 50")
def search_title_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    wanted = docs.where("id = 1").first()["title"]
    return search.title_exact(docs, wanted, 50).select("id", "key", "title")


@query(f"WITH {CORPUS_SQL} SELECT id, title FROM corpus WHERE contains(lower(title), 'tion the') ORDER BY id LIMIT 100")
def search_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    return search.substring(docs, "tion The", 100, search.build_trigram_index(docs)).select("id", "title")


@query(f"""WITH {CORPUS_SQL}, g AS (SELECT DISTINCT id, lower(title)[i:i+2] AS gram FROM corpus, range(1, (SELECT max(length(title)) FROM corpus)) r(i) WHERE length(title) >= i + 2),
    c AS (SELECT id, count(*) AS shared FROM g WHERE gram IN (SELECT 'that it'[i:i+2] FROM range(1, 6) r(i)) GROUP BY id ORDER BY shared DESC, id LIMIT 250)
    SELECT id, title, levenshtein(lower(title), 'that it')::INT AS distance FROM c JOIN corpus USING (id) WHERE levenshtein(lower(title), 'that it') <= 2 ORDER BY distance, id LIMIT 50""")
def search_fuzzy_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    return search.fuzzy_by_trigrams(docs, search.build_trigram_index(docs), "That it", 50).select("id", "title", "distance")


@query("""SELECT DISTINCT doc_id AS id, w AS title, levenshtein(w, 'thering')::INT AS distance FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents)
    WHERE levenshtein(w, 'thering') <= 2 ORDER BY distance, id, title LIMIT 500""")
def search_fuzzy_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all texts as a title: none within two edits is missed."""
    docs = corpus.documents(spark, sf_dir)
    words = docs.select(F.col("id").alias("doc"), F.explode(F.array_distinct(F.split(F.lower("body"), " "))).alias("title")).withColumn("id", F.xxhash64("doc", "title"))
    hits = search.fuzzy(words, search.build_part_index(words), "Thering", 1 << 20)
    return hits.select(F.col("doc").alias("id"), "title", "distance").orderBy("distance", "id", "title").limit(500)


@query(f"WITH {CORPUS_SQL} SELECT tier, count(*) AS n FROM (SELECT {_TIER_SQL.format(q='the')} AS tier FROM corpus) GROUP BY tier")
def search_tier_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).groupBy(search.tier_of("The").alias("tier")).agg(F.count("*").alias("n"))


@query(f"""WITH {CORPUS_SQL}, a AS (SELECT *, row_number() OVER (ORDER BY key) AS pos, 0 AS tier_seq, 'exact' AS q FROM corpus WHERE starts_with(lower(title), 'the') ORDER BY key LIMIT 300),
    b AS (SELECT *, row_number() OVER (ORDER BY id DESC) AS pos, 1 AS tier_seq, 'substring' AS q FROM corpus WHERE contains(lower(title), 'the') ORDER BY id DESC LIMIT 300),
    m AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tier_seq, pos) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
    SELECT path, q AS match_quality, (row_number() OVER (ORDER BY tier_seq, pos))::INT AS position FROM m WHERE k = 1""")
def search_merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    a, b = docs.where(F.lower("title").startswith("the")), docs.where(F.lower("title").contains("the"))
    return search.first_wins([("exact", a, [F.col("key")]), ("substring", b, [F.col("id").desc()])], 300).select("path", "match_quality", "position")


@query(f"""WITH {CORPUS_SQL}, q AS (SELECT id, trim(title) AS q FROM corpus)
    SELECT id, CASE WHEN regexp_matches(q, '[a-z][A-Z]|[.:]{{2}}|[A-Z]\\w+\\.(?:[a-z]\\w+|[A-Z]\\w+)') OR regexp_matches(q, '^[A-Z][A-Za-z0-9]+$') THEN 'symbol'
      WHEN regexp_matches(q, '(?i)\\b(error|crash|exception|fail|issue|bug|fix|troubleshoot|exc_bad|abort|segfault)\\b') THEN 'error'
      WHEN regexp_matches(q, '(?i)\\b(how|guide|tutorial|example|implement|create|build|use|setup|configure|add|make)\\b') THEN 'howto'
      WHEN regexp_matches(q, '(?i)\\b(what\\s+is|difference\\s+between|vs\\.?|overview|introduction|explain)\\b') THEN 'concept'
      WHEN regexp_matches(q, '(?i)\\bwwdc\\b|\\b20[12]\\d\\b') THEN 'wwdc' ELSE 'general' END AS type FROM q WHERE q <> ''""")
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).where(F.trim("title") != "").select("id", identifiers.intent(F.col("title")).getField("type").alias("type"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(p_brand || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda x: x <> ''), '/') AS parts FROM part WHERE len(list_filter(string_split(regexp_replace(p_brand || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda x: x <> '')) > 1")
def query_camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = identifiers.camel_subwords(F.concat("p_brand", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", parts.alias("parts")).where(F.size("parts") > 0).withColumn("parts", F.concat_ws("/", "parts"))


@query(f"WITH {CORPUS_SQL}, g AS (SELECT DISTINCT id, lower(title)[i:i+2] AS gram FROM corpus, range(1, (SELECT max(length(title)) FROM corpus)) r(i) WHERE length(title) >= i + 2) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.build_trigram_index(corpus.documents(spark, sf_dir)).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"WITH {CORPUS_SQL}, {_postings_sql(search.FIELDS)} SELECT term, id, tf, length::BIGINT AS length FROM post JOIN len USING (id)")
def fulltext_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.build_index(corpus.documents(spark, sf_dir)).drop("places")


@query("WITH s AS (SELECT source AS canonical, lang AS alias FROM documents UNION SELECT lang, source FROM documents WHERE doc_id % 3 = 0) SELECT alias AS name FROM s WHERE canonical = 'en' UNION SELECT canonical FROM s WHERE alias = 'en'")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table of synonyms has for a name, either way: here sources and languages that occur together."""
    d = table(spark, sf_dir, "documents")
    return search.expand_synonyms(d.select(F.col("source").alias("canonical"), F.col("lang").alias("alias")).union(d.where("doc_id % 3 = 0").select("lang", "source")), "en")


@query(f"WITH {ROOTS_SQL} SELECT slug, display_name FROM (SELECT *, CASE WHEN slug = 'ION_2' THEN 0 WHEN lower(slug) = 'ion_2' THEN 1 WHEN contains(lower(display_name), 'ion_2') THEN 2 WHEN contains(lower(slug), 'ion_2') THEN 3 END AS r FROM roots) WHERE r IS NOT NULL ORDER BY r, slug LIMIT 1")
def resolve_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.resolve_root(corpus.roots(spark, sf_dir), "ION_2").select("slug", "display_name")


@query()
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search, one page; rows only, as the order within 0.001 of score isn't SQL."""
    docs = corpus.documents(spark, sf_dir)
    answer = plan.ranked(plan.build(docs, edges=corpus.relationships(spark, sf_dir)), Q, limit=20)
    rows = [(i, r["path"], r["title"], r["match_quality"], r["confidence"], float(r["score"]), r["snippet"]) for i, r in enumerate(answer.results, 1)]
    return spark.createDataFrame(rows, "position int, path string, title string, match_quality string, confidence string, score double, snippet string")


# ---- filters ---------------------------------------------------------------------------------------------------------


@query(f"WITH {CORPUS_SQL} SELECT id FROM corpus WHERE lower(role) = 'article' OR lower(doc_kind) = 'article'")
def filter_kind_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply(corpus.documents(spark, sf_dir, False), filters.Filters(kind="article")).select("id")


@query(f"WITH {CORPUS_SQL} SELECT id FROM corpus WHERE lower(role_heading) = 'structure'")
def filter_kind_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply(corpus.documents(spark, sf_dir, False), filters.Filters(kind="Structure")).select("id")


@query(f"WITH {CORPUS_SQL} SELECT id FROM corpus WHERE json_extract_string(source_metadata, '$.year') = '2017' AND contains(lower(json_extract_string(source_metadata, '$.track')), 'track 3')")
def filter_year_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply(corpus.documents(spark, sf_dir, False), filters.Filters(year=2017, track="Track 3")).select("id")


@query(f"WITH {CORPUS_SQL} SELECT id FROM corpus WHERE is_deprecated AND framework IN ('src1', 'src2')")
def filter_deprecated_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply(corpus.documents(spark, sf_dir, False), filters.Filters(deprecated="only", frameworks=("SRC1", "src2"))).select("id")


_VERSION_SQL = "CAST(split_part({v}, '.', 1) AS BIGINT) * 1000000 + CAST(coalesce(nullif(split_part({v}, '.', 2), ''), '0') AS BIGINT) * 1000"


@query(f"WITH {CORPUS_SQL}, v AS (SELECT id, coalesce(min_ios, json_extract_string(platforms, '$.ios')) AS v FROM corpus) SELECT id FROM v WHERE v IS NULL OR {_VERSION_SQL.format(v='v')} <= 12003000")
def platform_min_version_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply(corpus.documents(spark, sf_dir, False), filters.Filters(min_versions={"ios": "12.3"})).select("id")


@query(f"WITH {CORPUS_SQL} SELECT id FROM corpus WHERE platforms IS NULL OR json_extract_string(platforms, '$.macos') IS NOT NULL")
def platform_only_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply(corpus.documents(spark, sf_dir, False), filters.Filters(platform="macOS")).select("id")


@query("SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE p_size::BIGINT * 1000000 + (p_partkey % 20) * 1000 END AS version FROM part")
def version_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("p_size") == 7, "beta 7").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 20).cast("string"), F.lit(" beta")))
    return table(spark, sf_dir, "part").select("p_partkey", versions.encode_version(v).alias("version"))


# ---- vectors ---------------------------------------------------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 4").alias("document_id"), (F.col("vec_id") % 4).alias("ord"), F.col("embedding").alias("vector"))
    return e, list(e.where("chunk_id = 7").first()["vector"])


_VEC_SQL = """q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 7),
    v AS (SELECT vec_id AS chunk_id, vec_id // 4 AS document_id, embedding, qv, (SELECT count(*) FROM range(1, 65) r(i) WHERE (embedding[i] >= 0) <> (qv[i] >= 0)) AS distance FROM embeddings, q)"""
_I8_SQL = """s AS (SELECT *, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM (SELECT * FROM v ORDER BY distance, chunk_id LIMIT 200)),
    r AS (SELECT chunk_id, document_id, distance, scale * list_sum(list_transform(range(1, 65), lambda i: qv[i]::DOUBLE * round(embedding[i]::DOUBLE / scale))) AS score FROM s)"""


@query(f"WITH {_VEC_SQL} SELECT chunk_id, distance FROM v ORDER BY distance, chunk_id LIMIT 50")
def vec_sign_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _chunks(spark, sf_dir)
    return semantic.shortlist(semantic.build_chunk_index(e), q, 50).select("chunk_id", "distance")


@query(f"WITH {_VEC_SQL} SELECT chunk_id, distance FROM v ORDER BY distance, chunk_id LIMIT 50")
def vec_hamming_subcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the stored table of sub-codes."""
    e, q = _chunks(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, "subcodes")
    if key not in _STORED:
        _STORED[key] = (semantic.store_subcodes(semantic.build_chunk_index(e)),)
    return semantic.nearest(_STORED[key][0], q, 50).select("chunk_id", "distance")


@query(f"WITH {_VEC_SQL}, {_I8_SQL} SELECT chunk_id, round(score, 6) AS score FROM r")
def vec_int8_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _chunks(spark, sf_dir)
    return semantic.rescore(semantic.shortlist(semantic.build_chunk_index(e), q), q).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC_SQL}, {_I8_SQL} SELECT document_id, round(max(r.score), 6) AS score FROM r GROUP BY document_id ORDER BY max(r.score) DESC, document_id LIMIT 50")
def vec_chunk_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _chunks(spark, sf_dir)
    return semantic.search(semantic.build_chunk_index(e), q).select("document_id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC_SQL} SELECT chunk_id, round(list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(qv::DOUBLE[], qv::DOUBLE[])), 6) AS cosine FROM v ORDER BY cosine DESC, chunk_id LIMIT 20")
def vec_exact_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _chunks(spark, sf_dir)
    return semantic.exact_cosine(e, q, 20).select("chunk_id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_VEC_SQL} SELECT document_id, distance, 1 - distance / 64 AS score FROM v WHERE chunk_id % 4 = 0 ORDER BY distance, document_id LIMIT 50")
def vec_whole_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _chunks(spark, sf_dir)
    codes = semantic.build_chunk_index(e.where("ord = 0")).select("document_id", "code")
    return semantic.search_whole(codes, q).select("document_id", "distance", "score")


# ---- ranking ---------------------------------------------------------------------------------------------------------

_LISTS_SQL = f"""{CORPUS_SQL}, lists AS (
    SELECT 0 AS list, key, row_number() OVER (ORDER BY length(body) DESC, id) AS rank, 1.0::DOUBLE AS weight, length(body)::DOUBLE AS score FROM corpus QUALIFY rank <= 300
    UNION ALL SELECT 1, key, row_number() OVER (ORDER BY length(title), id) AS rank, 0.6::DOUBLE, -length(title)::DOUBLE FROM corpus QUALIFY rank <= 300)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists of all documents, each cut to a search's window before it is numbered."""
    from pyspark.sql import Window

    d = corpus.documents(spark, sf_dir)
    part = lambda n, order, weight, score: d.orderBy(*order).limit(plan.WINDOW).select(F.lit(n).alias("list"), "key", F.row_number().over(Window.orderBy(*order)).alias("rank"), F.lit(weight).alias("weight"), score.cast("double").alias("score"))
    return part(0, [F.length("body").desc(), F.col("id")], 1.0, F.length("body")).union(part(1, [F.length("title"), F.col("id")], 0.6, -F.length("title")))


@query(f"WITH {_LISTS_SQL} SELECT key, round(sum(weight / (60 + rank)), 9) AS fused FROM lists GROUP BY key")
def fusion_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.weighted_rrf(_lists(spark, sf_dir)).select("key", F.round("fused", 9).alias("fused"))


_HYBRID_SQL = f"{_LISTS_SQL}, n AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY list) > min(score) OVER (PARTITION BY list) THEN (score - min(score) OVER (PARTITION BY list)) / (max(score) OVER (PARTITION BY list) - min(score) OVER (PARTITION BY list)) ELSE 0 END AS norm FROM lists)"


@query(f"WITH {_HYBRID_SQL} SELECT key, round(sum(weight / (60 + rank) + 0.5 * weight * norm), 9) AS fused FROM n GROUP BY key")
def fusion_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hybrid_fusion(_lists(spark, sf_dir)).select("key", F.round("fused", 9).alias("fused"))


@query(f"""WITH {_LISTS_SQL}, f AS (SELECT key, round(sum(weight / (60 + rank)), 9) AS fused, min(rank) AS lexical_rank FROM lists GROUP BY key), x AS (SELECT *, length(key) = (SELECT min(length(key)) FROM f) AND lexical_rank <= 3 AS e FROM f),
    y AS (SELECT *, e AND (SELECT count(*) FROM x WHERE e) BETWEEN 1 AND 5 AS first FROM x)
    SELECT key, (row_number() OVER (ORDER BY first DESC, CASE WHEN first THEN lexical_rank END NULLS LAST, fused DESC, key))::INT AS position FROM y QUALIFY position <= 300""")
def fusion_exact_hoist(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    rows = ranking.weighted_rrf(lists).withColumn("fused", F.round("fused", 9)).join(lists.groupBy("key").agg(F.min("rank").alias("lexical_rank")), "key")
    short = rows.agg(F.min(F.length("key"))).first()[0]
    exact = (F.length("key") == short) & (F.col("lexical_rank") <= 3)
    return ranking.hoist_exact(rows.withColumn("match_quality", F.when(exact, "exact").otherwise("match")), plan.WINDOW).select("key", "position")


@query()
def mmr_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential, over one window; tests hold it against a plain version."""
    e, q = _chunks(spark, sf_dir)
    rows = [r.asDict() for r in semantic.search(semantic.build_chunk_index(e), q, top=30).collect()]
    out = ranking.mmr(rows, lambda r: r["code"], ranking.hamming_similarity)
    return spark.createDataFrame([(i, r["document_id"]) for i, r in enumerate(out, 1)], "position int, document_id long")


@query(f"""WITH {CORPUS_SQL}, b AS (SELECT *, CASE id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' WHEN 2 THEN 'match' ELSE 'body' END AS mq, lower(source_type) AS s, lower(role_heading) AS k FROM corpus)
    SELECT id, round(CASE mq WHEN 'exact' THEN 100.0::DOUBLE WHEN 'prefix' THEN 80.0 WHEN 'match' THEN 50.0 ELSE 10.0 END
      * CASE WHEN split_part(path, '/', -1) = 'how to make the example' OR lower(title) = 'how to make the example' THEN 3.0 ELSE 1.0 END
      * CASE WHEN s IN ('hig', 'guidelines') OR k = 'article' THEN 1.3 ELSE 1.0 END * CASE WHEN is_release_notes OR contains(path, 'release-notes') THEN 0.4 ELSE 1.0 END
      * CASE WHEN s = 'apple-archive' THEN 0.6 ELSE 1.0 END * CASE WHEN s = 'sample-code' THEN 1.2 ELSE 1.0 END * CASE WHEN s = 'packages' THEN 0.45 ELSE 1.0 END
      * CASE s WHEN 'apple-docc' THEN 1.3 WHEN 'hig' THEN 1.2 WHEN 'sample-code' THEN 1.12 WHEN 'guidelines' THEN 1.05 ELSE 1.0 END * 0.9, 6) AS score FROM b""")
def rerank_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    mq = F.when(F.col("id") % 4 == 0, "exact").when(F.col("id") % 4 == 1, "prefix").when(F.col("id") % 4 == 2, "match").otherwise("body")
    rows = corpus.documents(spark, sf_dir, False).withColumn("match_quality", mq).withColumn("kind", F.col("role_heading"))
    return rows.select("id", F.round(ranking.rule_score("How to make the example", "howto"), 6).alias("score"))


@query("""WITH j AS (SELECT lang AS query, doc_id AS key FROM documents JOIN labels USING (doc_id) WHERE quality = 1), r AS (SELECT lang AS query, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    n AS (SELECT query, count(*) AS relevant FROM j GROUP BY query), h AS (SELECT query, count(*) FILTER (rank <= 10) AS found, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg, min(rank) AS first FROM r JOIN j USING (query, key) GROUP BY query)
    SELECT query, round(coalesce(found, 0) / relevant, 6) AS recall, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= relevant), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr FROM n LEFT JOIN h USING (query)""")
def eval_ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    judged = d.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("key"))
    ranked = d.select(F.col("lang").alias("query"), F.col("doc_id").alias("key"), F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")).alias("rank"))
    return ranking.ir_metrics(ranked, judged).select("query", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(value) FILTER (i = greatest(ceil(0.5 * n), 1)) AS p50, max(value) FILTER (i = greatest(ceil(0.95 * n), 1)) AS p95, max(value) FILTER (i = greatest(ceil(0.99 * n), 1)) AS p99 FROM r GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.nearest_rank(table(spark, sf_dir, "events"), "value", (0.5, 0.95, 0.99), ("event_type",))


@query("SELECT le, (SELECT count(*) FROM events WHERE value >= 0 AND value <= le) AS n FROM (VALUES (1.0::DOUBLE), (5.0), (10.0), (25.0), (50.0), (100.0), (250.0), (500.0), (1000.0), (2500.0), ('inf'::DOUBLE)) t(le)")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.histogram(table(spark, sf_dir, "events"), "value")


# ---- counts ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {CORPUS_SQL}, p AS (SELECT 'kind' AS field, doc_kind AS value FROM corpus UNION ALL SELECT 'role', role FROM corpus UNION ALL SELECT 'docKind', doc_kind FROM corpus UNION ALL SELECT 'roleHeading', role_heading FROM corpus UNION ALL SELECT 'sourceType', source_type FROM corpus)
    SELECT field, value, count(*) AS count FROM p WHERE value <> '' GROUP BY field, value""")
def taxonomy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.taxonomy(corpus.documents(spark, sf_dir, False))


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_orderpriority <> '' GROUP BY 1 ORDER BY count DESC, value LIMIT 3")
def taxonomy_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.taxonomy(table(spark, sf_dir, "orders").withColumn("doc_kind", F.col("o_orderpriority")), "kind", 3).drop("field")


@query(f"WITH {CORPUS_SQL} SELECT DISTINCT framework AS label, root_slug AS value FROM corpus")
def facet_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.facet(corpus.documents(spark, sf_dir, False), "root_slug", "framework")


@query(f"WITH {ROOTS_SQL}, {PAGES_SQL} SELECT slug, kind, count(*) AS page_count FROM roots JOIN pages_ USING (root_id) WHERE status = 'active' GROUP BY slug, kind")
def framework_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.live_page_counts(corpus.roots(spark, sf_dir), corpus.pages(spark, sf_dir)).select("slug", "kind", "page_count")


@query(f"WITH {ROOTS_SQL}, {PAGES_SQL} SELECT slug, coalesce(n, 0) AS page_count FROM roots LEFT JOIN (SELECT root_id, count(*) AS n FROM pages_ WHERE status = 'active' GROUP BY root_id) USING (root_id)")
def stamp_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.stamp_page_counts(corpus.roots(spark, sf_dir), corpus.pages(spark, sf_dir)).select("slug", "page_count")


@query(f"WITH {CORPUS_SQL} SELECT CAST(json_extract_string(source_metadata, '$.year') AS INT) AS year, count(*) AS count FROM corpus WHERE source_metadata IS NOT NULL GROUP BY 1")
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.year_histogram(corpus.documents(spark, sf_dir, False), F.get_json_object("source_metadata", "$.year").cast("int"))


_PROGRESS = "count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, count(*) AS total, round(count(*) FILTER (status = 'processed') / count(*) * 100)::INT AS percent"


@query(f"WITH {CRAWL_SQL} SELECT root_slug, {_PROGRESS} FROM crawl GROUP BY root_slug")
def crawl_progress_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.crawl_progress(corpus.crawl_state(spark, sf_dir))


@query(f"WITH {CRAWL_SQL} SELECT {_PROGRESS} FROM crawl")
def crawl_progress_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.crawl_progress(corpus.crawl_state(spark, sf_dir), by_root=False)


@query(f"WITH {CRAWL_SQL} SELECT status, count(*) AS count FROM crawl GROUP BY status")
def crawl_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.crawl_counts(corpus.crawl_state(spark, sf_dir))


@query(f"""WITH {LOG_SQL}, l AS (SELECT root_slug, max(timestamp) AS last_update FROM log WHERE root_slug IS NOT NULL GROUP BY root_slug), now_ AS (SELECT max(timestamp) + INTERVAL 10 DAY AS t FROM log)
    SELECT root_slug, last_update, CAST(floor((epoch_us(t) - epoch_us(last_update)) / 86400000000) AS BIGINT) AS days_since, floor((epoch_us(t) - epoch_us(last_update)) / 86400000000) > 14 AS stale FROM l, now_""")
def freshness_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = corpus.update_log(spark, sf_dir)
    now = log.agg((F.max("timestamp") + F.expr("interval 10 days")).alias("t")).first()["t"]
    return corpus_stats.freshness(log, F.lit(now))


@query(f"""WITH {ROOTS_SQL}, {PAGES_SQL} SELECT 'active_pages' AS name, count(*) FILTER (status = 'active') AS value FROM pages_ UNION ALL SELECT 'deleted_pages', count(*) FILTER (status = 'deleted') FROM pages_
    UNION ALL SELECT 'roots', count(*) FROM roots UNION ALL SELECT 'roots:' || kind, count(*) FROM roots GROUP BY kind""")
def corpus_stats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.corpus_stats(corpus.roots(spark, sf_dir), corpus.pages(spark, sf_dir))


@query("SELECT 'documents' AS name, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents UNION ALL SELECT 'pages', count(*), sum(strlen(html) + strlen(url))::BIGINT FROM pages")
def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.storage_stats({"documents": (table(spark, sf_dir, "documents"), ["text"]), "pages": (table(spark, sf_dir, "pages"), ["html", "url"])})


@query(f"WITH {CORPUS_SQL} SELECT coalesce('Year ' || json_extract_string(source_metadata, '$.year'), 'Other') AS label, count(*) AS count, min(title) AS first_title FROM corpus GROUP BY 1")
def scope_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.scope_groups(corpus.documents(spark, sf_dir, False), F.concat(F.lit("Year "), F.get_json_object("source_metadata", "$.year")))


# ---- relationships ---------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES_SQL} SELECT from_key, count(*) AS total, count(*) FILTER (relation_type = 'child') AS children, 0::BIGINT AS \"inheritsFrom\", count(*) FILTER (relation_type = 'conforms_to') AS \"conformsTo\", 0::BIGINT AS \"inheritedBy\", count(*) FILTER (relation_type = 'see_also') AS \"seeAlso\" FROM edges GROUP BY from_key")
def relation_counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relation_counts(corpus.relationships(spark, sf_dir))


_DISTINCT_SQL = "de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_key, to_key, relation_type ORDER BY sort_order, section) AS k FROM edges) WHERE k = 1)"


@query(f"WITH {EDGES_SQL}, {_DISTINCT_SQL} SELECT from_key, to_key, relation_type, section, sort_order FROM de")
def distinct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distinct_edges(corpus.relationships(spark, sf_dir))


@query(f"WITH {EDGES_SQL}, {_DISTINCT_SQL} SELECT from_key, to_key, relation_type, p_name AS target_title FROM de LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) ON to_key = p_partkey")
def children_with_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"))
    return graph.children_with_titles(graph.distinct_edges(corpus.relationships(spark, sf_dir)), docs).select("from_key", "to_key", "relation_type", "target_title")


@query(f"WITH {EDGES_SQL}, docs AS (SELECT o_orderkey AS key FROM orders UNION SELECT p_partkey FROM part) SELECT from_key, to_key, relation_type, section, sort_order FROM edges WHERE relation_type = 'child' AND to_key IN (SELECT key FROM docs) AND from_key IN (SELECT key FROM docs)")
def framework_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order and part as a document."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")).union(table(spark, sf_dir, "part").select("p_partkey")).distinct()
    return graph.framework_tree(corpus.relationships(spark, sf_dir), docs).select("from_key", "to_key", "relation_type", "section", "sort_order")


@query(f"WITH {EDGES_SQL} SELECT missing_from, missing_to, count(*) AS n FROM (SELECT from_key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) AS missing_from, to_key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) AS missing_to FROM edges) WHERE missing_from OR missing_to GROUP BY 1, 2")
def orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"))
    return graph.orphan_edges(corpus.relationships(spark, sf_dir), keys).groupBy("missing_from", "missing_to").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphan_rows(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query(f"""WITH {CORPUS_SQL}, {PAGES_SQL}, {SECTIONS_SQL}, docs AS (SELECT id, id AS key FROM corpus WHERE id % 4 <> 0)
    SELECT 'documents_fulltext' AS name, 0::BIGINT AS found, true AS ok UNION ALL SELECT 'body_fulltext', 0, true
    UNION ALL SELECT 'document_page_consistency', (SELECT count(*) FROM docs) - (SELECT count(*) FROM pages_ WHERE status = 'active'), (SELECT count(*) FROM docs) <= (SELECT count(*) FROM pages_ WHERE status = 'active') + 10
    UNION ALL SELECT 'orphan_sections', count(*), count(*) = 0 FROM sections WHERE document_id NOT IN (SELECT id FROM docs)
    UNION ALL SELECT 'orphan_relationships', count(*), count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT key FROM docs) OR l_partkey NOT IN (SELECT key FROM docs)""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir, False).where("id % 4 <> 0").withColumn("key", F.col("id"))
    return maintenance.integrity_report(docs, corpus.pages(spark, sf_dir), corpus.sections(spark, sf_dir), corpus.relationships(spark, sf_dir))


@query(f"WITH {CORPUS_SQL}, c AS (SELECT key, unnest(range(1, 4)) AS depth FROM corpus), x AS (SELECT key, depth::INT AS depth, array_to_string(string_split(key, '/')[1:depth], '/') AS crumb FROM c) SELECT x.key, x.depth, x.crumb, d.title AS label FROM x LEFT JOIN corpus d ON d.key = x.crumb")
def breadcrumb_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.breadcrumbs(corpus.documents(spark, sf_dir, False))


@query(f"WITH {ROOTS_SQL}, {PAGES_SQL} SELECT path, slug, display_name FROM pages_ JOIN roots USING (root_id) WHERE status = 'active'")
def pages_of_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats.pages_of_root(corpus.pages(spark, sf_dir), corpus.roots(spark, sf_dir)).select("path", "slug", "display_name")


@query(f"WITH {ROOTS_SQL}, {PAGES_SQL} SELECT path, slug, kind AS source_type, status FROM pages_ JOIN roots USING (root_id) WHERE slug <> (SELECT min(slug) FROM roots) AND kind IN (SELECT kind FROM roots GROUP BY kind ORDER BY kind LIMIT 2)")
def requested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all roots but the first one, and of two source types; there are as many names as roots."""
    roots = corpus.roots(spark, sf_dir).withColumnRenamed("kind", "source_type")
    slugs = sorted(r[0] for r in roots.select("slug").distinct().collect())
    kinds = sorted(r[0] for r in roots.select("source_type").distinct().collect())
    return corpus_stats.requested_pages(corpus.pages(spark, sf_dir), roots, slugs[1:], kinds[:2]).select("path", "slug", "source_type", "status")


@query(f"WITH {ROOTS_SQL}, {PAGES_SQL} SELECT path, doc_kind FROM pages_ JOIN roots USING (root_id) WHERE slug = 'nation_3' AND status = 'active' ORDER BY path LIMIT 40")
def browse_root_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.lookup import browse

    return browse(corpus.roots(spark, sf_dir), corpus.pages(spark, sf_dir), "nation_3", limit=40).select("path", "doc_kind")


@query(f"WITH {CORPUS_SQL} SELECT id, key FROM corpus WHERE lower(title) = (SELECT lower(title) FROM corpus WHERE id = 3) ORDER BY role <> 'symbol', length(key), key LIMIT 1")
def lookup_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.lookup import by_title

    docs = corpus.documents(spark, sf_dir, False)
    return by_title(docs, docs.where("id = 3").first()["title"]).select("id", "key")


@query()
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references, each order and part by its own key, under two roots. Recursive SQL would list each key at each depth."""
    key = lambda c: F.concat((F.col(c) % 2).cast("string"), F.lit("/"), F.col(c).cast("string"))
    refs = table(spark, sf_dir, "lineitem").select(key("l_orderkey").alias("from_key"), key("l_partkey").alias("to_key"))
    return graph.crawl_frontier(refs, spark.createDataFrame([("1/11",)], "key string"))


# ---- HTML and links --------------------------------------------------------------------------------------------------

_BLOCK = "|".join(html.BLOCK_TAGS)


def _plain_sql(h: str) -> str:
    s = f"regexp_replace(regexp_replace(regexp_replace({h}, '<\\?[^?]*\\?>', '', 'g'), '<svg.*?</svg>', '', 'gis'), '</?(?:{_BLOCK})\\b[^>]*>', chr(10) || chr(10), 'gi')"
    s = f"regexp_replace({s}, '</?\\w+[^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"array_to_string(list_transform(string_split({s}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10))"
    return f"trim(regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ')"


@query(f"SELECT page_id, {_plain_sql('html')} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.plain_text(F.col("html")).alias("text"))


_TITLE_SQL = "regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')"


@query(f"SELECT page_id, nullif({_plain_sql(_TITLE_SQL)}, '') AS title, length(html) <= 2048 AND regexp_matches(html, '(?i)<title[^>]*>\\s*(Redirecting|Document Has Moved|Moved Permanently)') AS moved FROM pages")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.title(h).alias("title"), html.redirect_target(h).isNotNull().alias("moved"))


_LINKS_SQL = "links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href\\s*=\\s*\"([^\"]+)\"', 1, 'i')) AS href FROM pages)"


@query(f"WITH {_LINKS_SQL} SELECT page_id, href, count(*) AS n FROM links GROUP BY page_id, href")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a parser; tests hold it against handwritten pages."""
    return html.sections(table(spark, sf_dir, "pages"))


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a parser; tests hold it against handwritten pages."""
    return html.markdown(table(spark, sf_dir, "pages"))


def _hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.documents(spark, sf_dir, False)
    k = F.col("id") % 6
    href = F.when(k == 0, F.concat(F.lit("/docs/"), "key", F.lit("/?x=1"))).when(k == 1, F.concat(F.lit("#"), "key")).when(k == 2, F.concat(F.lit("https://developer.apple.com/documentation/"), "key", F.lit("/"))).when(k == 3, F.concat(F.lit("/"), "key")).when(k == 4, F.lit("mailto:a@b.c"))
    return d.select("id", href.otherwise(F.concat(F.lit("https://www.swift.org/migration/"), "key")).alias("href"), F.col("framework").alias("section"))


_HREFS_SQL = f"""{CORPUS_SQL}, hrefs AS (SELECT id, CASE id % 6 WHEN 0 THEN '/docs/' || key || '/?x=1' WHEN 1 THEN '#' || key WHEN 2 THEN 'https://developer.apple.com/documentation/' || key || '/' WHEN 3 THEN '/' || key WHEN 4 THEN 'mailto:a@b.c' ELSE 'https://www.swift.org/migration/' || key END AS href, framework AS section, key FROM corpus),
    classed AS (SELECT id, href, section, CASE id % 6 WHEN 0 THEN CASE WHEN id % 4 <> 0 THEN 'internal_ok' ELSE 'internal_broken' END WHEN 1 THEN 'fragment' WHEN 2 THEN CASE WHEN id % 4 <> 0 THEN 'external_resolvable' ELSE 'external' END WHEN 3 THEN 'relative_broken' ELSE 'external' END AS category,
      CASE WHEN id % 6 = 0 THEN key WHEN id % 6 = 2 AND id % 4 <> 0 THEN key END AS internal_key FROM hrefs)"""


@query(f"WITH {_HREFS_SQL} SELECT id, href, category, internal_key FROM classed")
def link_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.documents(spark, sf_dir, False).where("id % 4 <> 0").select("key")
    return urls.classify_links(_hrefs(spark, sf_dir), known).select("id", "href", "category", "internal_key")


@query(f"WITH {_HREFS_SQL} SELECT 'both' AS level, category, section, count(*) AS count FROM classed GROUP BY category, section UNION ALL SELECT 'section', NULL, section, count(*) FROM classed GROUP BY section UNION ALL SELECT 'category', category, NULL, count(*) FROM classed GROUP BY category")
def link_audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.documents(spark, sf_dir, False).where("id % 4 <> 0").select("key")
    return corpus_stats.link_rollups(urls.classify_links(_hrefs(spark, sf_dir), known))


@query(f"WITH {_LINKS_SQL}, c AS (SELECT href AS value, page_id, count(*) AS n FROM links GROUP BY href, page_id), r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY page_id) AS k FROM c) SELECT value, sum(n)::BIGINT AS count, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) FILTER (k <= 5) AS sources FROM r GROUP BY value ORDER BY count DESC, value LIMIT 50")
def link_top_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = html.links(table(spark, sf_dir, "pages")).withColumn("category", F.lit("all"))
    return corpus_stats.top_links(links, "all", "href", "page_id").withColumn("sources", F.concat_ws(",", F.col("sources").cast("array<string>")))


@query("""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)) AS host, CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path,
    'swift-book/' || page_id || '/x' AS book, 'wwdc/wwdc2021-' || page_id AS session, 'swift-evolution/0' || (100 + page_id % 900) || '-name' AS proposal, 'apple-archive/lib/p' || page_id AS archive FROM pages""")
def url_map_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    key = lambda *parts: urls.map_url_to_key(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    return p.select(
        "page_id", urls.url_host(F.col("url")).alias("host"), urls.url_path(F.col("url")).alias("path"), key("https://docs.swift.org/swift-book/", i, "/x/").alias("book"),
        key("https://developer.apple.com/videos/play/wwdc2021/", i, "/").alias("session"), key("https://github.com/swiftlang/swift-evolution/blob/main/proposals/0", (100 + F.col("page_id") % 900).cast("string"), "-name.md").alias("proposal"),
        key("https://developer.apple.com/library/archive/lib/p", i, "/index.html").alias("archive"),
    )


@query(f"""WITH {CORPUS_SQL} SELECT id, lower(key) AS normal, framework AS root, NULL::VARCHAR AS web,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '\\s+', '-', 'g'), '[^a-z0-9_-]', '', 'g'), '-{{2,}}', '-', 'g'), '^-|-$', '', 'g') AS slug FROM corpus""")
def identifier_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.documents(spark, sf_dir, False)
    ident = identifiers.normalize_identifier(F.concat(F.lit("/documentation/"), F.upper("key"), F.lit("/")))
    return d.select("id", ident.alias("normal"), identifiers.root_slug(F.col("key")).alias("root"), identifiers.normalize_identifier(F.concat(F.lit("https://x/"), "key")).alias("web"), text.slugify(F.col("title")).alias("slug"))


# ---- documents -------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT doc_id AS id, regexp_replace(text, '\\n', chr(10) || '## ') AS body FROM documents), p AS (SELECT id, split_part(body, chr(10) || '## ', 1) AS a, body FROM m)
    SELECT id, 0 AS sort_order, NULL::VARCHAR AS heading, trim(a, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM p WHERE trim(a, ' ' || chr(9) || chr(10) || chr(13)) <> ''
    UNION ALL SELECT id, 1, trim(split_part(substr(body, length(a) + 5), chr(10), 1)), trim(substr(body, length(a) + 5 + length(split_part(substr(body, length(a) + 5), chr(10), 1))), ' ' || chr(9) || chr(10) || chr(13)) FROM p WHERE contains(body, chr(10) || '## ')""")
def sections_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown made of documents: the first line end opens a section."""
    first = F.call_function("instr", F.col("text"), F.lit("\n"))
    body = F.when(first > 0, F.concat(F.substring("text", F.lit(1), first - 1), F.lit("\n## "), F.substr("text", first + 1))).otherwise(F.col("text"))
    return chunks.split_sections(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), body.alias("body")))


_CHUNK_SQL = f"""{CORPUS_SQL}, {SECTIONS_SQL}, s AS (SELECT document_id, sort_order, CASE WHEN heading <> '' THEN heading || '. ' ELSE '' END || trim(content_text) AS t FROM sections WHERE section_kind = 'discussion' AND trim(content_text) <> '' OR (section_kind = 'abstract' AND trim(content_text) <> '' AND document_id IN (SELECT id FROM corpus WHERE coalesce(abstract, '') = ''))),
    w AS (SELECT document_id, sort_order, i, t[i * 720 + 1 : i * 720 + 880] AS text FROM s, range(0, 8) r(i) WHERE i = 0 OR i * 720 + 160 < length(t)),
    k AS (SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY sort_order, i))::INT AS ord, text FROM w)"""


@query(f"WITH {_CHUNK_SQL} SELECT document_id, ord, text FROM k WHERE ord < 8 UNION ALL SELECT id, 0, substr(array_to_string(list_filter([title, abstract, headings], lambda x: x <> ''), '. '), 1, 1200) FROM corpus")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(corpus.documents(spark, sf_dir, False), corpus.sections(spark, sf_dir))


@query(f"""WITH {CORPUS_SQL}, {SECTIONS_SQL}, t AS (SELECT document_id, string_agg(substr(content_text, 1, 500), ' ' ORDER BY sort_order) AS t FROM sections WHERE content_text <> '' GROUP BY document_id)
    SELECT id, key, regexp_replace(lower(substr(framework, 1, 1)), '[^a-z]', '_') AS letter, substr(trim(t), 1, 500) AS preview FROM corpus JOIN t ON id = document_id WHERE trim(t) <> ''""")
def body_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.body_preview(corpus.documents(spark, sf_dir, False), corpus.sections(spark, sf_dir))


@query(f"""WITH {CORPUS_SQL}, {SECTIONS_SQL}, b AS (SELECT document_id, string_agg(trim(CASE WHEN heading <> '' THEN heading || chr(10) ELSE '' END || content_text), chr(10) || chr(10) ORDER BY sort_order) AS t FROM sections WHERE content_text <> '' OR heading <> '' GROUP BY document_id)
    SELECT id, sha256(trim(regexp_replace(array_to_string(list_filter([title, abstract, declaration, headings, t], lambda x: x <> ''), chr(10) || chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'))) AS text_sha256 FROM corpus LEFT JOIN b ON id = document_id""")
def plain_text_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.render_plain(corpus.documents(spark, sf_dir, False), corpus.sections(spark, sf_dir)).select("id", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {SECTIONS_SQL} SELECT document_id, substr(sha256(string_agg(section_kind || '|' || length(content_text) || '|0|' || sort_order, '|' ORDER BY sort_order)), 1, 16) AS digest FROM sections GROUP BY document_id")
def sections_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus.sections(spark, sf_dir).withColumn("content_json", F.lit(None).cast("string"))
    packed = s.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "section_kind", "content_text", "content_json"))).alias("s"))
    return packed.select("document_id", text.sections_digest(F.col("s")).alias("digest"))


@query(f"""WITH {CORPUS_SQL}, h AS (SELECT id, body, list_min(list_filter([instr(lower(body), 'tion'), instr(lower(body), 'ement')], lambda p: p > 0)) AS hit FROM corpus), w AS (SELECT *, greatest(hit - 1 - 77, 0) AS s FROM h)
    SELECT id, CASE WHEN hit IS NULL THEN CASE WHEN length(body) <= 220 THEN body ELSE trim(substr(body, 1, 217)) || '...' END ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(body, s + 1, least(length(body), s + 220) - s)) || CASE WHEN least(length(body), s + 220) < length(body) THEN '...' ELSE '' END END AS snippet FROM w""")
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).select("id", text.snippet(F.col("body"), F.lit("tion! ement")).alias("snippet"))


@query(f"WITH {CORPUS_SQL}, h AS (SELECT id, sha256('{{\"body\":' || to_json(body)::VARCHAR || ',\"language\":' || coalesce('\"' || language || '\"', 'null') || '}}') AS h FROM corpus) SELECT min(id) AS first_id, count(*) AS n FROM h GROUP BY h")
def near_dup_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.documents(spark, sf_dir).select("id", text.content_hash("body", "language").alias("h"))
    return d.groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).drop("h")


@query(f"WITH {SECTIONS_SQL}, r AS (SELECT *, CASE WHEN lower(trim(coalesce(heading, ''))) = 'part 1' THEN 0 WHEN ends_with(lower(trim(coalesce(heading, ''))), 'part 1') THEN 1 WHEN section_kind = 'part 1' THEN 2 WHEN contains(lower(content_text), 'part 1') THEN 3 END AS rank FROM sections) SELECT document_id, sort_order, content_text FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank, sort_order) AS k FROM r WHERE rank IS NOT NULL) WHERE k = 1")
def find_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.find_section(corpus.sections(spark, sf_dir), "Part 1").select("document_id", "sort_order", "content_text")


@query(f"WITH {CORPUS_SQL}, f AS (SELECT framework, (row_number() OVER (ORDER BY framework) - 1)::INT AS fw_index FROM (SELECT DISTINCT framework FROM corpus)) SELECT key, title, substr(coalesce(abstract, ''), 1, 80) AS abstract, fw_index, doc_kind AS kind, role_heading FROM corpus JOIN f USING (framework)")
def title_index_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.title_index(corpus.documents(spark, sf_dir, False))


@query(f"""WITH {CORPUS_SQL}, t AS (SELECT DISTINCT key, title, unnest(list_filter(string_split_regex(lower(regexp_replace(title, '([a-z])([A-Z])', '\\1 \\2', 'g')) || ' ' || lower(regexp_replace(key, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\s._/\\\\]+'), lambda x: x <> '')) AS term FROM corpus),
    h AS (SELECT DISTINCT key, w FROM t, (VALUES ('that'), ('with')) q(w) WHERE term = w), c AS (SELECT key FROM h GROUP BY key HAVING count(*) = 2)
    SELECT key, title, CASE WHEN lower(title) = 'that with' THEN 100.0 WHEN starts_with(lower(title), 'that with') THEN 80.0 WHEN contains(lower(title), 'that') AND contains(lower(title), 'with') THEN 60.0 ELSE 30.0 * (contains(lower(title) || key, 'that')::INT + contains(lower(title) || key, 'with')::INT) / 2 END - 1.0::DOUBLE AS score
    FROM corpus SEMI JOIN c USING (key) ORDER BY score DESC, length(title), key LIMIT 50""")
def client_title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus.documents(spark, sf_dir, False)
    return client_search.search(index, client_search.build(index), "that with")


@query("""WITH c AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations), k AS (SELECT conv_id, turn, i, trim(l) AS l, lag(trim(l)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS p FROM c WHERE trim(l) <> '')
    SELECT conv_id, turn, string_agg(l, chr(10) ORDER BY i) AS text FROM k WHERE l IS DISTINCT FROM p GROUP BY conv_id, turn""")
def transcript_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: a header, a cue before each line, and each line twice."""
    cue = F.concat_ws("\n", F.lit("WEBVTT"), F.lit(""), F.concat_ws("\n", F.transform(F.split("text", "\n"), lambda x, i: F.concat_ws("\n", (i + 1).cast("string"), F.lit("00:00:01.000 --> 00:00:02.000"), F.concat(F.lit("<v A>"), x, F.lit("</v>")), x))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_transcript(cue).alias("text"))
    return rows.where("text <> ''")


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM n WHERE i % greatest(n // 25, 1) = 0 AND i // greatest(n // 25, 1) < 25")
def eval_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 evenly spaced documents: a sample, as evaluation wants one. Rows are numbered within ranges of ids, whose counts come first."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id")
    low, high, n = d.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    d = d.withColumn("cell", F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(max(((high or 0) - (low or 0)) / 4096, 1.0))))
    counts = d.groupBy("cell").agg(F.count("*").alias("n"))
    step = max(n // 25, 1)
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("cell")) - F.col("n"))
    wanted = before.withColumn("first", F.ceil(F.col("before") / step) * step).where((F.col("first") < F.col("before") + F.col("n")) & (F.col("first") < 25 * step))
    i = F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("doc_id")) - 1
    return d.join(F.broadcast(wanted), "cell").withColumn("i", i).where((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < 25)).select("doc_id")


# ---- maintenance -----------------------------------------------------------------------------------------------------


@query("""SELECT coalesce(a.k, b.k) AS key, coalesce(b.title, a.title) AS title, CASE WHEN b.kind <> 'unknown' THEN b.kind ELSE coalesce(a.kind, b.kind) END AS kind FROM
    (SELECT o_orderkey AS k, o_orderpriority AS title, o_orderstatus AS kind FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN
    (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'new' END AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'X' END AS kind FROM orders WHERE o_orderkey % 2 = 0) b ON a.k = b.k""")
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("kind"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 4 != 0, "new").alias("title"), F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise("X").alias("kind"))
    return maintenance.upsert(old, new, "key", keep_unknown=("kind",))


@query(f"WITH {EDGES_SQL}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_key, to_key, relation_type ORDER BY sort_order DESC, section DESC) AS k FROM edges WHERE from_key % 2 = 0 AND sort_order > 2) WHERE k = 1) SELECT relation_type, count(*) AS n, sum(sort_order)::BIGINT AS total FROM (SELECT relation_type, sort_order FROM edges WHERE from_key NOT IN (SELECT from_key FROM edges WHERE from_key % 2 = 0 AND sort_order > 2) UNION ALL SELECT relation_type, sort_order FROM n) GROUP BY relation_type")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.relationships(spark, sf_dir)
    out = maintenance.replace_children(e, e.where("from_key % 2 = 0 and sort_order > 2"), "from_key", ("from_key", "to_key", "relation_type"), "sort_order")
    return out.groupBy("relation_type").agg(F.count("*").alias("n"), F.sum("sort_order").cast("long").alias("total"))


@query(f"WITH {CORPUS_SQL}, {SECTIONS_SQL} SELECT 'documents' AS name, count(*) AS n FROM corpus WHERE id % 3 <> 0 UNION ALL SELECT 'sections', count(*) FROM sections WHERE document_id % 3 <> 0 UNION ALL SELECT 'edges', count(*) FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_orderkey IN (SELECT id FROM corpus)) AND NOT (l_partkey % 3 = 0 AND l_partkey IN (SELECT id FROM corpus))")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir, False).withColumn("key", F.col("id"))
    parts = maintenance.delete_documents(docs, corpus.sections(spark, sf_dir), corpus.relationships(spark, sf_dir), docs.where("id % 3 = 0"))
    out = [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, p in zip(("documents", "sections", "edges"), parts, strict=True)]
    return out[0].union(out[1]).union(out[2])


@query("SELECT o_orderkey AS key, 'stale' AS change FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return maintenance.key_diff(o.where("key % 3 = 0"), o.where("key % 2 = 0"), "key")


@query(f"""WITH {PAGES_SQL}, c AS (SELECT path, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 304 WHEN 2 THEN 500 ELSE 200 END AS http, CASE WHEN page_id % 7 = 0 THEN 'W/new' ELSE etag END AS e2 FROM pages_ WHERE page_id % 9 <> 0),
    a AS (SELECT p.*, http, e2, CASE WHEN http IS NULL THEN 'unchecked' WHEN http = 404 THEN CASE WHEN misses + 1 >= 3 THEN 'deleted' ELSE 'missed' END WHEN http >= 400 THEN 'error' WHEN http = 304 OR e2 IS NOT DISTINCT FROM etag THEN 'unchanged' ELSE 'modified' END AS action FROM pages_ p LEFT JOIN c USING (path))
    SELECT path, action, CASE WHEN action = 'deleted' THEN 'deleted' ELSE status END AS status, CASE WHEN action = 'modified' THEN e2 ELSE etag END AS etag, CASE WHEN action IN ('unchanged', 'modified') THEN 0 WHEN http = 404 THEN misses + 1 ELSE misses END::INT AS misses FROM a""")
def tombstone_404(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.pages(spark, sf_dir)
    http = F.when(F.col("page_id") % 5 == 0, 404).when(F.col("page_id") % 5 == 1, 304).when(F.col("page_id") % 5 == 2, 500).otherwise(200)
    checks = p.where("page_id % 9 <> 0").select("path", http.alias("http"), F.when(F.col("page_id") % 7 == 0, "W/new").otherwise(F.col("etag")).alias("etag"))
    return maintenance.apply_checks(p, checks).select("path", "action", "status", "etag", "misses")


@query(f"WITH {CORPUS_SQL} SELECT framework, count(*) FILTER (source_type IN ('wwdc', 'hig')) AS kept, count(*) FILTER (source_type NOT IN ('wwdc', 'hig')) AS removed FROM corpus GROUP BY framework")
def prune_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.prune_report(corpus.documents(spark, sf_dir, False), filters.in_scope(F.col("source_type"), ("wwdc", "hig")), "framework")


@query("SELECT event_id FROM (SELECT event_id, sum(event_id % 100 + 1) OVER (ORDER BY ts DESC, event_id DESC) AS s FROM events) WHERE s <= 100000")
def evict_to_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("updated_at"), F.col("event_id").alias("cache_key"), (F.col("event_id") % 100 + 1).alias("size_bytes"))
    return maintenance.evict_to_quota(cache, 100_000).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 5 DAY FROM events)")
def evict_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cutoff = e.agg((F.max("ts") - F.expr("interval 5 days")).alias("t")).first()["t"]
    return maintenance.evict_older(e, F.lit(cutoff).cast("timestamp_ntz"), "ts").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-01' AND (o_orderkey % 3 = 0 OR o_orderdate > TIMESTAMP '1996-01-01')")
def incremental_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("indexed", F.when(F.col("o_orderkey") % 3 != 0, F.lit("1996-01-01").cast("timestamp_ntz")))
    return maintenance.changed_since(o, F.lit("1997-06-01").cast("timestamp_ntz"), "o_orderdate", "indexed").select("o_orderkey")


@query("""WITH v AS (SELECT 1 AS version, c_custkey AS k, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0
      UNION ALL SELECT 2, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 ELSE c_acctbal END FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0)
    SELECT version, k, balance FROM v UNION ALL SELECT 3, k, balance FROM v WHERE version = 1""")
def committed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, then an upsert, then back to the first version; a write that was never committed is in none."""
    store = VersionedTables(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    store.commit({"customers": c.where("k % 3 <> 0")}, ("load", 1))
    store.commit({"customers": maintenance.upsert(store.read("customers"), c.where("k % 2 = 0").withColumn("balance", F.col("balance") * 2), "k")}, ("load", 2))
    store._write(c)
    store.rollback(1)
    return reduce(DataFrame.unionByName, [store.read("customers", v).withColumn("version", F.lit(v)) for v in store.versions()])


@query(f"WITH {CORPUS_SQL} SELECT id FROM corpus WHERE id NOT IN (SELECT vec_id // 4 FROM embeddings)")
def documents_without_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("document_id")).distinct()
    return maintenance.without_chunks(corpus.documents(spark, sf_dir, False), e).select("id")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'other source' WHEN 2 THEN 'retry' ELSE 'keep' END AS todo FROM orders""")
def failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    path = F.when(k == 0, F.concat(F.lit("swiftui/#"), F.col("o_orderkey").cast("string"))).when(k == 1, F.concat(F.lit("wwdc/"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("swiftui/"), F.col("o_orderkey").cast("string")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), path.alias("path"), F.lit("failed").alias("status"), F.when(k == 2, "HTTP 503 fetching it").otherwise("HTTP 404").alias("error"))
    roots = spark.createDataFrame([("wwdc", "wwdc"), ("swiftui", "apple-docc")], "slug string, source_type string")
    return maintenance.failed_rows(rows, roots).select("id", "todo")


# ---- streaming -------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def streaming_crawl_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's state after all events, from a memory sink, against the batch result."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    name = f"crawl_{uuid.uuid4().hex}"
    q = incremental.crawl_metrics(events).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))


# ---- catalogues, listings, embeddings --------------------------------------------------------------------------------


@query("""WITH s AS (SELECT p_partkey, p_name, p_size, string_split_regex(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+') AS t FROM part WHERE p_brand = 'Brand#11'), h AS (SELECT *, (len(list_filter(t, lambda x: starts_with(x, 'st'))) > 0)::INT + (len(list_filter(t, lambda x: starts_with(x, 'b'))) > 0)::INT AS hits FROM s)
    SELECT p_partkey, hits::BIGINT AS hits FROM h WHERE hits > 0""")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.catalog import symbol_search as run

    none = F.array().cast("array<string>")
    s = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("scope"), F.split("p_type", " ").alias("keywords"), none.alias("categories"), none.alias("aliases"), F.col("p_size").alias("order_index"))
    return run(s, "ST b", "Brand#11", 1_000_000).select("p_partkey", F.col("hits").cast("long").alias("hits"))


@query("SELECT n_nationkey AS id, count(c_custkey) AS n, coalesce(string_agg(c_name, ',' ORDER BY c_name), '') AS files FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def font_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a file."""
    from .operators.catalog import font_catalog as run

    files = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("family_id"), F.col("c_name").alias("file_name"), F.lit(400).alias("weight"), F.lit(False).alias("italic"))
    out = run(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("display_name")), files)
    return out.select("id", F.size("files").cast("long").alias("n"), F.concat_ws(",", F.col("files.file_name")).alias("files"))


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def dedup_first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.catalog import first_file

    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("family_id"), F.col("l_linenumber").alias("file_name"), F.col("l_partkey").alias("id"))
    return first_file(f).select(F.col("family_id").alias("l_orderkey"), F.col("file_name").alias("l_linenumber"), F.col("id").alias("l_partkey"))


@query(f"WITH {CORPUS_SQL} SELECT id, CASE WHEN source_type = 'wwdc' THEN json_extract_string(source_metadata, '$.year') WHEN source_type = 'swift-evolution' THEN 'Other' WHEN source_type IN ('packages', 'swift-book', 'apple-archive', 'hig') THEN split_part(key, '/', 2) END AS label FROM corpus")
def scope_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.catalog import scope_label as run

    return corpus.documents(spark, sf_dir, False).select("id", run(F.col("source_type"), F.col("key"), F.col("source_metadata")).alias("label"))


@query(f"WITH {SECTIONS_SQL}, l AS (SELECT *, CASE WHEN section_kind = 'declaration' THEN 'Declaration' ELSE coalesce(nullif(heading, ''), 'Overview') END AS label FROM sections WHERE section_kind <> 'abstract' AND trim(content_text) <> '') SELECT document_id, sort_order, replace(lower(label), ' ', '-') AS anchor, label FROM l")
def page_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.catalog import page_toc as run

    return run(corpus.sections(spark, sf_dir))


@query("SELECT doc_id AS document_id FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0)")
def pages_to_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.catalog import pages_to_render as run

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.xxhash64("text").alias("digest"))
    done = d.where("document_id % 2 = 0").select("document_id", F.when(F.col("document_id") % 3 == 0, 0).otherwise(F.col("digest")).alias("digest"), F.when(F.col("document_id") % 5 == 0, "old").otherwise("new").alias("template"))
    return run(d, done, "new").select("document_id")


@query(f"WITH {CORPUS_SQL} SELECT id, key FROM corpus WHERE id > 100 ORDER BY id LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resumable scan's page: ids above the mark, in order."""
    return corpus.documents(spark, sf_dir, False).where("id > 100").orderBy("id").limit(50).select("id", "key")


@query(f"WITH {CORPUS_SQL}, h AS (SELECT id FROM corpus WHERE contains(lower(title), 'the') INTERSECT SELECT id FROM corpus WHERE contains(lower(title), 'and')) SELECT id FROM h")
def posting_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of documents intersected: those that have all."""
    d = corpus.documents(spark, sf_dir, False)
    lists = d.where(F.lower("title").contains("the")).select("id", F.lit("the").alias("term")).union(d.where(F.lower("title").contains("and")).select("id", F.lit("and")))
    return lists.groupBy("id").agg(F.countDistinct("term").alias("n")).where("n = 2").select("id")


@query()
def embed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashing embedder over titles and a search by it; tests hold it against a plain version."""
    from .functions.embedding import embed, hashing_embedder

    d = corpus.documents(spark, sf_dir, False)
    rows = d.select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.lit(0).alias("ord"), embed(F.col("title"), hashing_embedder(), spark).alias("vector"))
    found = semantic.search(semantic.build_chunk_index(rows), hashing_embedder()("the and"), top=20)
    return found.select("document_id", F.round("score", 6).alias("score"))


from . import content_queries, source_queries  # noqa: E402,F401 - they register their queries
