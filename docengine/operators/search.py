"""Search tiers over inverted indexes: exact, full text, substring, fuzzy, body.

Indexes are tables that are built once for each corpus version, stored sorted by term (`store`), and read where a
query's few terms are. Every tier gives (id, tier, rank score); ties go by id.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import trigrams
from ..functions.stemming import porter, stems_of
from ..functions.text import tokens
from ..session import discard, durable, ship

# Weights of the indexed fields
FIELDS = {"title": 10.0, "abstract": 5.0, "declaration": 3.0, "headings": 2.0, "key": 1.0}
K1, B = 1.2, 0.75
TIERS = {0: "exact", 1: "prefix", 2: "contains", 3: "match"}


#: A place of a word: the number of its field times this, and its number in the field. No two fields touch.
FIELD = 1 << 40


@dataclass(frozen=True)
class Group:
    """Alternatives of one word of the query: prefixes and exact terms; or a phrase, whose words follow each other in a field; or
    phrases near each other, with `within` words at most between the end of the one that begins first and the beginning of any other.
    Fields, if any are named, are the only ones it is looked for in."""

    prefixes: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()
    phrase: tuple[str, ...] = ()
    near: tuple[tuple[str, ...], ...] = ()
    within: int = 10
    fields: tuple[str, ...] = ()

    @property
    def placed(self) -> bool:
        """Whether places decide."""
        return bool(self.phrase or self.near or self.fields)


@dataclass(frozen=True)
class Query:
    """Groups that must all match, or any of them; or as `tree` says: a group's place, or (operator, tree, tree)."""

    groups: tuple[Group, ...]
    any: bool = False
    tree: int | tuple | None = None


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def parse(query: str) -> Query:
    """Words to groups: qualified names by segment and joined, camel-case parts exactly.

    Queries with AND, OR, NOT, NEAR or quotes are read as they are written: quoted words are a phrase, a star makes a prefix,
    NEAR(a "b c", 5) wants its words and phrases near each other, `title:` or `{title key}:` before a word, phrase or bracket names its
    fields, words side by side bind closest, then NOT, AND and OR; brackets group. What isn't well-formed is taken as words.
    """
    if re.search(r'\b(AND|OR|NOT)\b|"|\bNEAR\s*\(', query):
        return _boolean(_MARKS.findall(query)) or Query(tuple(Group((), (w,)) for w in words_of(re.sub(r"\b(AND|OR|NOT)\b", " ", query))))
    groups = []
    for word in query.split():
        segments = [s for s in re.split(r"[._:/\\]+", word) if s]
        prefixes = dict.fromkeys(s.lower() for s in segments)
        if len(segments) > 1:
            prefixes["".join(segments).lower()] = None
        split = [re.sub("([a-z0-9])([A-Z])", r"\1 \2", s).split() for s in segments]
        parts = [p for x in split if len(x) > 1 for p in x]
        exact = tuple(dict.fromkeys(p.lower() for p in parts if p.lower() not in prefixes))
        if prefixes:
            groups.append(Group(tuple(prefixes), exact))
    return Query(tuple(groups))


_NAMES = "|".join([*FIELDS, "body"])
_MARKS = re.compile(rf'NEAR\s*\([^()]*\)|\{{(?:\s*(?:{_NAMES}))+\s*\}}\s*:|\b(?:{_NAMES})\s*:|"[^"]*"\*?|[()]|[^\s()"]+')


def _near(mark: str) -> Group:
    """NEAR(words and phrases, distance)."""
    inside, _, distance = mark[mark.index("(") + 1 : -1].partition(",")
    phrases = tuple(tuple(words_of(x)) for x in re.findall(r'"[^"]*"|[^\s"]+', inside))
    if not phrases or not all(phrases) or not re.fullmatch(r"\s*\d*\s*", distance):
        raise ValueError(mark)
    return Group(near=phrases, within=int(distance) if distance.strip() else 10)


def _boolean(marks: list[str]) -> Query | None:
    groups: list[Group] = []
    at = 0

    def see() -> str | None:
        return marks[at] if at < len(marks) else None

    def leaf() -> int | tuple:
        nonlocal at
        mark = see()
        if mark is None or mark in (")", "AND", "OR", "NOT"):
            raise ValueError(mark)
        at += 1
        if mark.endswith(":") and mark.strip("{:} ").split() and set(mark.strip("{:} ").split()) <= {*FIELDS, "body"}:
            begin = len(groups)
            inside = leaf()
            groups[begin:] = [replace(g, fields=tuple(mark.strip("{:} ").split())) for g in groups[begin:]]
            return inside
        if mark.startswith("NEAR") and mark.endswith(")"):
            groups.append(_near(mark))
            return len(groups) - 1
        if mark == "(":
            inside = level(0)
            if see() != ")":
                raise ValueError(mark)
            at += 1
            return inside
        words = words_of(mark)
        if not words:
            raise ValueError(mark)
        groups.append(Group((), (), tuple(words)) if len(words) > 1 else Group(tuple(words)) if mark.endswith("*") else Group((), tuple(words)))
        return len(groups) - 1

    def level(k: int) -> int | tuple:
        """Operators from the loosest to the closest; words side by side last."""
        nonlocal at
        if k == 3:
            out = leaf()
            while see() not in (None, ")", "AND", "OR", "NOT"):
                out = ("AND", out, leaf())
            return out
        out = level(k + 1)
        while see() == ("OR", "AND", "NOT")[k]:
            at += 1
            out = (("OR", "AND", "NOT")[k], out, level(k + 1))
        return out

    try:
        tree = level(0)
    except ValueError:
        return None
    return Query(tuple(groups), set(re.findall(r"\b(?:AND|NOT|OR)\b", str(tree))) == {"OR"}, tree) if at == len(marks) else None


def build_index(docs: DataFrame, fields: dict[str, float] = FIELDS) -> DataFrame:
    """Postings (term, id, tf, length, places): tf weighed by field, length in tokens of all fields, places in order.

    A document is one row, so that its terms are counted where it is read, without a shuffle.
    """
    return counted_terms(listed_tokens(docs, fields), fields)


def _weight(place: Column, fields: dict[str, float]) -> Column:
    """The weight of the field that a place is in."""
    return F.get(F.array(*[F.lit(float(w)) for w in fields.values()]), F.shiftright(place, 40).cast("int"))


def listed_tokens(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(id, t0, t1, ...): the tokens of each field."""
    return docs.select("id", *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t{k}") for k, c in enumerate(fields)])


#: Tokens that a task counts at a time, or those of one document that has more.
COUNTED = 1 << 20


def token_pieces(batches: Iterable[pa.RecordBatch], fields: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Listed tokens in pieces, with the number of tokens of each field; those without any token are left out."""
    for batch in batches:
        lengths = [pc.list_value_length(batch.column(k + 1)).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(fields)]
        upto, a = np.cumsum(sum(lengths)), 0
        while a < batch.num_rows:
            before = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, before + COUNTED, "right")))
            if upto[b - 1] > before:
                yield batch.slice(a, b - a), [n[a:b] for n in lengths]
            a = b


def counted(batch: pa.RecordBatch, lengths: list[np.ndarray], weights: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """A piece's terms, and its postings in order of term and row: number of the term, row, tf, places."""
    terms = pa.concat_arrays([batch.column(k + 1).flatten() for k in range(len(weights))]).dictionary_encode()
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in lengths])
    place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + k * FIELD for k, n in enumerate(lengths)])
    key = terms.indices.to_numpy().astype(np.int64) * batch.num_rows + row
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    places = pa.ListArray.from_arrays(pa.array(np.append(begin, len(key)), pa.int32()), pa.array(place, pa.int64()))
    return terms.dictionary, key[begin] // batch.num_rows, key[begin] % batch.num_rows, np.add.reduceat(weights[place >> 40], begin), places


def counted_terms(listed: DataFrame, fields: dict[str, float]) -> DataFrame:
    """Postings (term, id, tf, length, places) of listed tokens.

    A piece of an Arrow batch at a time is counted as numbers: its postings come by term, so that they take little room in a shuffle.
    """
    ship(listed.sparkSession)
    weights = np.array([float(w) for w in fields.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lengths in token_pieces(batches, len(weights)):
            terms, code, row, tf, places = counted(batch, lengths, weights)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(code)), batch.column(0).take(pa.array(row)), pa.array(tf), pa.array(sum(lengths)[row]), places], names=["term", "id", "tf", "length", "places"])

    kind = listed.schema["id"].dataType.simpleString()
    return listed.mapInArrow(run, f"term string, id {kind}, tf double, length long, places array<bigint>")


#: How indexes are written: the second version of Parquet's pages writes numbers as differences.
DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#places.list.element": "false"}


def observed(listed: DataFrame, fields: dict[str, float]) -> tuple[DataFrame, Observation]:
    """Listed tokens with an observation of n and the mean length."""
    told = Observation()
    size = sum((F.size(f"t{k}") for k in range(len(fields))), F.lit(0))
    return listed.observe(told, F.count("*").alias("n"), F.avg(size).alias("mean")), told


def store(docs: DataFrame, fields: dict[str, float] = FIELDS) -> tuple[DataFrame, tuple[int, float]]:
    """The postings as a table sorted by term, so that a query reads the few row groups of its terms; and (n, mean length) of the same pass.

    A term's postings may fill several files: files are cut by term and id. Places are written as differences, in a column of
    their own that only phrases and the like read.
    """
    listed, told = observed(listed_tokens(docs, fields), fields)
    rows = durable(counted_terms(listed, fields), **DELTAS)
    table = durable(rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), **DELTAS)
    discard(rows)
    return table, (told.get["n"], told.get["mean"] or 1.0)


def stemmed(postings: DataFrame) -> DataFrame:
    """The same postings by stem: stems are worked out for distinct terms, and joined back."""
    stems = postings.select("term").distinct().select("term", porter(F.col("term")).alias("stem"))
    rows = postings.join(stems, "term").groupBy(F.col("stem").alias("term"), "id", "length")
    return rows.agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places")).select("term", "id", "tf", "length", "places")


def store_stemmed(postings: DataFrame) -> DataFrame:
    """The index of stems as a table sorted by stem."""
    return durable(stemmed(postings).repartitionByRange("term", "id").sortWithinPartitions("term", "id"), **DELTAS)


def stemmed_query(query: Query, postings: DataFrame) -> Query:
    """A query for the index of stems."""
    every = [w for g in query.groups for w in (*g.prefixes, *g.exact, *g.phrase, *(w for p in g.near for w in p))]
    stem = stems_of(postings.sparkSession, every)
    of = lambda words: tuple(stem[w] for w in words)
    return replace(query, groups=tuple(replace(g, prefixes=of(g.prefixes), exact=of(g.exact), phrase=of(g.phrase), near=tuple(map(of, g.near))) for g in query.groups))


def index_stats(docs: DataFrame, fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """One row: n documents, mean length."""
    size = sum((F.size(tokens(F.coalesce(F.col(c), F.lit("")))) for c in fields), F.lit(0))
    return docs.agg(F.count("*").alias("n"), F.avg(size).alias("mean"))


def any_of(tests: Sequence[Column]) -> Column:
    """Whether one of the tests holds."""
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def tests_of(group: Group) -> list[Column]:
    """Tests of a posting's term, one for each of a group's alternatives."""
    return [F.startswith("term", F.lit(p)) for p in group.prefixes] + [F.col("term") == e for e in group.exact]


def _reach(places: str, n: int) -> Column:
    """The places from which one of these is no more than n further on."""
    return F.flatten(F.transform(places, lambda y: F.sequence(y - n, y)))


def _placed_hits(postings: DataFrame, fields: dict[str, float], g: int, group: Group) -> DataFrame:
    """(g, id, length, tf) of documents where a group's places fit: places of words are moved to where their phrase begins, and met.

    tf is the weighed number of places where the phrase, or the first phrase of those near each other, begins.
    """
    phrases = group.near or ((group.phrase,) if group.phrase else ())
    if phrases:
        words = sorted({w for p in phrases for w in p})
        rows = postings.where(F.col("term").isin(*words)).groupBy("id", "length").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at")).where(F.size("at") == len(words))
        moved = lambda p, j: F.transform(F.col("at")[p[j]], lambda x: x - j)
        begins = [f"begin{i}" for i in range(len(phrases))]
        rows = rows.select("id", "length", *[reduce(F.array_intersect, [moved(p, j) for j in range(len(p))]).alias(b) for b, p in zip(begins, phrases, strict=True)])
        hits = []
        for i, p in enumerate(phrases):
            others = [_reach(b, len(p) + group.within) for k, b in enumerate(begins) if k != i]
            hits.append(reduce(F.array_intersect, others, F.col(begins[i])))
        hit = reduce(F.array_union, hits)
    else:
        rows = postings.where(any_of(tests_of(group))).groupBy("id", "length").agg(F.flatten(F.collect_list("places")).alias("at"))
        hit = F.col("at")
    if group.fields:
        numbers = [list(fields).index(name) for name in group.fields if name in fields]
        hit = F.filter(hit, lambda x: F.shiftright(x, 40).isin(*numbers) if numbers else F.lit(False))
    tf = F.aggregate(hit, F.lit(0.0), lambda s, x: s + _weight(x, fields))
    return rows.select(F.lit(g).alias("g"), "id", "length", tf.alias("tf")).where("tf > 0")


def match(postings: DataFrame, stats: tuple[int, float], query: Query, fields: dict[str, float] = FIELDS) -> DataFrame:
    """(id, score) of documents that have each group (or any, or as the query's tree says): BM25 over the alternatives of a group as one term.

    Only the query's terms are read from the postings, and their places only for phrases, NEAR and named fields; n and mean come
    with the index.
    """
    n, mean = stats
    if not query.groups:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    loose = [(g, group) for g, group in enumerate(query.groups) if not group.placed]
    per = None
    if loose:
        tests = {g: tests_of(group) for g, group in loose}
        fits = [F.when(any_of(t), F.lit(g)) for g, t in tests.items()]
        rows = postings.where(any_of([x for t in tests.values() for x in t])).withColumn("g", F.explode(F.array_compact(F.array(*fits))))
        per = rows.groupBy("g", "id", "length").agg(F.sum("tf").alias("tf"))
    for g, group in enumerate(query.groups):
        if group.placed:
            hits = _placed_hits(postings, fields, g, group)
            per = hits if per is None else per.unionByName(hits)
    df = per.groupBy("g").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return combine(per.join(F.broadcast(df), "g").withColumn("idf", idf), mean, query)


def share(tf: Column, length: Column, mean: float) -> Column:
    """What a term's frequency in a document of some length brings, of K1 + 1 at most."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def combine(per: DataFrame, mean: float, query: Query) -> DataFrame:
    """(id, score) of documents that the query fits, from rows (g, id, length, tf, idf) of its groups."""
    hits = per.groupBy("id").agg(F.sum(F.col("idf") * share(F.col("tf"), F.col("length"), mean)).alias("score"), F.collect_set("g").alias("groups"))

    def holds(tree: int | tuple) -> Column:
        if isinstance(tree, int):
            return F.array_contains("groups", tree)
        kind, left, right = tree
        left, right = holds(left), holds(right)
        return left & right if kind == "AND" else left | right if kind == "OR" else left & ~right

    need = F.size("groups") >= (1 if query.any else len(query.groups))
    return hits.where(need if query.tree is None else holds(query.tree)).select("id", F.round("score", 6).alias("score"))


def tier_of(query: str) -> F.Column:
    q = query.lower()
    title, key = F.lower("title"), F.lower("key")
    return F.when((title == q) | (key == q), 0).when(title.startswith(q), 1).when(title.contains(q), 2).otherwise(3)


def full_text(docs: DataFrame, postings: DataFrame, stats: tuple[int, float], query: str, limit: int, parsed: Query | None = None) -> DataFrame:
    """Matches by tier, then score; docs are filtered already."""
    hits = match(postings, stats, parsed or parse(query))
    return docs.join(hits, "id").withColumn("tier", tier_of(query)).orderBy("tier", F.col("score").desc(), "id").limit(limit)


def title_exact(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """Titles that equal the query whatever the case: symbols first, then the shortest key."""
    hits = docs.where(F.lower("title") == query.lower())
    return hits.orderBy((F.col("role") != "symbol").cast("int"), F.length("key"), "key").limit(limit)


def substring(docs: DataFrame, query: str, limit: int, grams: DataFrame | None = None) -> DataFrame:
    """Titles that contain the query, of three characters at least. With the trigram index, only titles that have all of its trigrams are read."""
    low = query.lower()
    if len(low) < 3:
        return docs.limit(0)
    if grams is not None:
        own = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        have = grams.where(F.col("gram").isin(*own)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(own))
        docs = docs.join(have.select("id"), "id", "left_semi")
    return docs.where(F.lower("title").contains(low)).orderBy("id").limit(limit)


def build_trigram_index(docs: DataFrame) -> DataFrame:
    """Postings (gram, id) of titles, each once."""
    return docs.select("id", F.explode(trigrams(F.col("title"))).alias("gram"))


def store_trigrams(docs: DataFrame) -> DataFrame:
    """The same as a table sorted by trigram."""
    return durable(build_trigram_index(docs).repartitionByRange("gram").sortWithinPartitions("gram", "id"))


def _parts(length: Column, most: int) -> Column:
    """Where a title of some length is cut into most + 1 parts: (part, begin, size)."""
    at = lambda k: F.floor(length * k / (most + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(k.alias("part"), at(k).alias("begin"), (at(k + 1) - at(k)).alias("size")))


def _part_hash(length: Column, part: Column, text: Column) -> Column:
    return F.xxhash64(length, part, text)


def build_part_index(docs: DataFrame, most: int = 2) -> DataFrame:
    """Postings (part, id) of titles cut into most + 1 parts: `most` edits leave one of them as it is. A part is a hash of its text,
    its number and the title's length; so a title has most + 1 rows, however long it is."""
    low = docs.select("id", F.lower("title").alias("low")).where("low IS NOT NULL").withColumn("length", F.length("low"))
    rows = low.select("id", "low", "length", F.explode(_parts(F.col("length"), most)).alias("p"))
    return rows.select(_part_hash(F.col("length"), F.col("p.part"), F.substring("low", F.col("p.begin") + 1, F.col("p.size"))).alias("part"), "id")


def store_parts(docs: DataFrame, most: int = 2) -> DataFrame:
    """The same as a table sorted by part."""
    return durable(build_part_index(docs, most).repartitionByRange("part", "id").sortWithinPartitions("part", "id"))


def parts_near(spark: SparkSession, query: str, most: int = 2) -> list[int]:
    """What titles within the edit distance have in the index, one of these at least: for each of their lengths, the query's texts around where a part is."""
    low = query.lower()
    asked = set()
    for length in range(max(len(low) - most, 0), len(low) + most + 1):
        cuts = [length * k // (most + 1) for k in range(most + 2)]
        for k in range(most + 1):
            size = cuts[k + 1] - cuts[k]
            asked |= {(length, k, low[b : b + size]) for b in range(max(cuts[k] - most, 0), min(cuts[k] + most, len(low) - size) + 1)}
    rows = spark.createDataFrame(sorted(asked), "length int, part int, text string")
    return sorted({r[0] for r in rows.select(_part_hash(F.col("length"), F.col("part"), F.col("text"))).collect()})


def fuzzy(docs: DataFrame, parts: DataFrame, query: str, limit: int, most: int = 2) -> DataFrame:
    """All titles within the edit distance, nearest first; parts is their index (of the same `most`). Queries of less than four characters have none."""
    if len(query) < 4:
        return docs.withColumn("distance", F.lit(0)).limit(0)
    near = parts.where(F.col("part").isin(*parts_near(docs.sparkSession, query, most))).select("id").distinct()
    hits = docs.where(F.length("title").between(len(query) - most, len(query) + most)).join(near, "id", "left_semi")
    return hits.withColumn("distance", F.levenshtein(F.lower("title"), F.lit(query.lower()), most)).where("distance >= 0").orderBy("distance", "id").limit(limit)


def fuzzy_by_trigrams(docs: DataFrame, grams: DataFrame, query: str, limit: int, most: int = 2) -> DataFrame:
    """Titles within the edit distance among the few that share most trigrams with the query: a smaller search that may miss some."""
    own = {query.lower()[i : i + 3] for i in range(len(query) - 2)}
    if len(query) < 4 or len(own) < 2:
        return docs.withColumn("distance", F.lit(0)).limit(0)
    near = grams.where(F.col("gram").isin(*own)).groupBy("id").agg(F.count("*").alias("shared")).orderBy(F.col("shared").desc(), "id").limit(max(5 * limit, 100))
    hits = docs.join(F.broadcast(near), "id").withColumn("distance", F.levenshtein(F.lower("title"), F.lit(query.lower()), most))
    return hits.where("distance >= 0").orderBy("distance", "id").limit(limit)


def expand_synonyms(synonyms: DataFrame, framework: str) -> DataFrame:
    """Names that mean the same as a framework, both ways; each once."""
    there = synonyms.where(F.col("canonical") == framework).select(F.col("alias").alias("name"))
    back = synonyms.where(F.col("alias") == framework).select(F.col("canonical").alias("name"))
    return there.union(back).distinct()


# Names of frameworks that people use for each other; an alias has one name
SYNONYMS = (
    ("quartzcore", "coreanimation"), ("coreanimation", "quartzcore"), ("quartz2d", "coregraphics"), ("coregraphics", "quartz2d"), ("metalkit", "metal"),
    ("uikitcore", "uikit"), ("appkit", "cocoa"), ("foundation", "nsobject"), ("swiftui", "declarativeui"),
)


def first_wins(tiers: Sequence[tuple[str, DataFrame, Sequence[F.Column]]], most: int) -> DataFrame:
    """The first `most` rows of each of the tiers (label, rows, order), united; a path that several have keeps the first one's row.

    Adds match_quality, tier_seq and position (the place in all results). Each tier is cut to its window before its rows are numbered.
    """
    every = None
    for k, (label, rows, order) in enumerate(tiers):
        ranked = rows.orderBy(*order).limit(most).withColumn("_at", F.row_number().over(Window.orderBy(*order)))
        ranked = ranked.withColumn("tier_seq", F.lit(k)).withColumn("match_quality", F.lit(label) if label != "fts" else F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.col("tier")))
        every = ranked if every is None else every.unionByName(ranked, allowMissingColumns=True)
    best = every.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("tier_seq", "_at"))).where("_k = 1").drop("_k")
    return best.withColumn("position", F.row_number().over(Window.orderBy("tier_seq", "_at"))).drop("_at")


def fan_out(docs: DataFrame, frameworks: Sequence[str], query: str, limit: int) -> DataFrame:
    """A title search in each of the frameworks (a name and those that mean the same), their results one after the other: (place, framework, id, title)."""
    out = None
    for k, name in enumerate(frameworks):
        rows = substring(docs.where(F.lower("framework") == name.lower()), query, limit).select(F.lit(k).alias("place"), "framework", "id", "title")
        out = rows if out is None else out.unionByName(rows)
    return out
