"""URL filtering by association rules that FP-growth mines from labelled URLs, and by given rules.

A URL is a set of tokens. Frequent combinations of tokens that go with a label become rules; those of too
little confidence or support, and those that a shorter rule of no less confidence makes superfluous, are
pruned. Each rule is indexed under its rarest token, so that a URL meets only the rules of its own tokens;
the strongest rule whose tokens it all has decides.

Tokens that the labelled URLs always have together (as all of a long URL that repeats) are mined as one, since each
combination of them says the same: one stands for all, in rules and in the URLs judged. Of the tokens that are left, a URL
brings `widest` at most into FP-growth, its most frequent ones, so that this has never more than 2^widest / support combinations.
Sets with one of the others are grown token by token, as far as larger ones can still say something else (`grown`). No set is left
out: the rules are those of all combinations, however long URLs are and however nearly alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, fresh

#: Share of labelled URLs that have the combination, and share of those with the label.
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Frequent tokens of a URL that FP-growth combines with each other; sets with others of it are grown round by round.
WIDEST = 10
#: Mined rules whose index is broadcast, and tokens with others in their place; more are joined by shuffle.
BROADCAST_RULES = 20_000
#: What FP-growth returns of a rule.
RULE = "antecedent array<string>, consequent array<string>, confidence double, support double"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """A URL's distinct tokens: scheme, host labels, path segments and query keys; numbers are one token.

    Null URLs, and those without any of these, have none.
    """
    u = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    part = lambda prefix, items: F.transform(items, lambda x: F.concat(F.lit(prefix), F.regexp_replace(x, r"^\d+", "#")))
    scheme = F.array(F.regexp_extract(u, r"(?s)^(.*?)://", 1))
    query = F.split(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), "&")
    keys = F.transform(query, lambda x: F.substring_index(x, "=", 1))
    every = F.concat(part("scheme:", scheme), part("host:", F.split(host(url), r"\.")), part("path:", F.split(F.translate(path(url), _UPPER, _LOWER), "/")), part("query:", keys))
    return F.array_distinct(F.filter(every, lambda t: ~F.rlike(t, F.lit(r"^\w+:$"))))


@dataclass(frozen=True)
class Mined:
    """rules (tokens, key, label, confidence, support), and alike (token, stand): tokens for which another one stands."""

    rules: DataFrame
    alike: DataFrame

    @staticmethod
    def none(spark: SparkSession) -> Mined:
        return Mined(spark.createDataFrame([], "tokens array<string>, key string, label string, confidence double, support double"), spark.createDataFrame([], "token string, stand string"))


def standing(sets: DataFrame, alike: DataFrame) -> DataFrame:
    """(row, t): the tokens of each row, with those in whose place others stand; rows without tokens are left out."""
    small = alike.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    each = sets.select("row", F.explode("t").alias("token")).join(F.broadcast(alike) if small else alike, "token", "left")
    return each.groupBy("row").agg(F.collect_set(F.coalesce("stand", "token")).alias("t"))


def combined(baskets: DataFrame, often: DataFrame, support: float, confidence: float, widest: int) -> tuple[DataFrame, DataFrame]:
    """baskets (row, label, t) without the tokens that FP-growth doesn't get, and the rules of all sets that have one of these."""
    own = baskets.select(F.array_sort("t").alias("t")).distinct().withColumn("set", F.monotonically_increasing_id())
    own = own.where(F.size("t") > widest).select("set", F.explode("t").alias("token")).join(often.select("token", "count"), "token")
    ranked = own.groupBy("set").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "token"))).alias("t")).where(F.size("t") > widest)
    late = durable(ranked.select(F.explode(F.slice("t", widest + 1, 1 << 30)).alias("x")).select("x.token").distinct())
    if late.isEmpty():
        return baskets, baskets.sparkSession.createDataFrame([], RULE)
    rules = grown(baskets, often, late, support, confidence)
    rest = baskets.select("row", F.explode("t").alias("token")).join(late, "token", "left_anti").groupBy("row").agg(F.collect_set("token").alias("t"))
    none = F.array().cast("array<string>")
    out = durable(baskets.select("row", "label").join(rest, "row", "left").select("row", "label", F.coalesce("t", none).alias("t")))
    discard(late)
    return out, rules


def grown(baskets: DataFrame, often: DataFrame, late: DataFrame, support: float, confidence: float) -> DataFrame:
    """The rules of all frequent sets with one of the late tokens or more, but for superfluous ones that this shows before they are counted.

    Sets grow by one token in each round, from the late ones on, in an order that has late tokens first, so that each set is reached once.
    A set doesn't grow if all its rows have one label, or if one of its parts has as many rows as itself: each larger set has then a part
    of the same confidence, and is superfluous. So tokens that nearly always come together make few sets, not 2^tokens. Equal
    baskets are counted as one.
    """
    n = baskets.count()
    marked = often.select("token").join(late.withColumn("late", F.lit("0")), "token", "left").select("token", F.concat(F.coalesce("late", F.lit("1")), "token").alias("x"))
    rows = baskets.select("row", "label", F.explode("t").alias("token")).join(marked, "token").groupBy("row", "label").agg(F.array_sort(F.collect_list("x")).alias("t"))
    rows = rows.groupBy("t", "label").agg(F.count("*").alias("w"))
    held = durable(rows.select("t", "label", "w", F.posexplode("t").alias("at", "x")).where("x LIKE '0%'").select("t", "label", "w", "at", F.array("x").alias("set")))
    rules, before = [], None
    while True:
        per = held.groupBy("set", "label").agg(F.sum("w").alias("both"))
        sets = durable(per.groupBy("set").agg(F.sum("both").alias("n"), F.max("both").alias("most")).where(F.col("most") >= support * n))
        if before is not None:
            parts = sets.select(F.col("set").alias("whole"), "n", F.explode(F.transform("set", lambda x: F.array_remove("set", x))).alias("set")).where("set[0] LIKE '0%'")
            over = parts.join(before.select("set", F.col("n").alias("more")), "set", "left").where("more is null or more <= n").select(F.col("whole").alias("set"))
            sets = durable(sets.join(over, "set", "left_anti"))
        found = per.join(sets.select("set", "n"), "set").where((F.col("both") >= support * n) & (F.col("both") / F.col("n") >= confidence))
        names = F.transform("set", lambda x: F.substr(x, F.lit(2)))
        rules.append(durable(found.select(names.alias("antecedent"), F.array("label").alias("consequent"), (F.col("both") / F.col("n")).alias("confidence"), (F.col("both") / n).alias("support"))))
        before = sets.where("most < n")
        if before.isEmpty():
            discard(held)
            return reduce(DataFrame.unionByName, rules)
        more = held.join(before.select("set"), "set", "left_semi")
        more = more.select("t", "label", "w", "set", "at", F.posexplode(F.slice("t", F.col("at") + 2, F.size("t"))).alias("k", "x"))
        wider = durable(more.select("t", "label", "w", (F.col("at") + 1 + F.col("k")).alias("at"), F.array_append("set", F.col("x")).alias("set")))
        discard(held)
        held = wider


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, url_col: str = "url", label_col: str = "label", widest: int = WIDEST) -> Mined:
    """Rules from URLs with labels; rows with null labels don't count, null URLs and those without tokens do.

    key is the rule's rarest token. Repeated rows count each. `widest` tells how many frequent tokens of a URL (those that always come
    together being one) FP-growth gets; the rules are the same whatever it is. No labelled rows: no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = durable(labelled.where(F.col(label_col).isNotNull()).select(tokens(F.col(url_col)).alias("t"), F.col(label_col).alias("label"), F.monotonically_increasing_id().alias("row")))
    spark = rows.sparkSession
    if rows.isEmpty():
        return Mined.none(spark)
    # tokens of the same rows have the same number of them and the same sums of two hashes
    hashes = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]
    often = rows.select("row", F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("count"), *hashes)
    often = durable(often.where(F.col("count") >= support * rows.count()))
    stands = often.groupBy("count", "h0", "h1").agg(F.min("token").alias("stand"))
    alike = durable(often.join(stands, ["count", "h0", "h1"]).where("token <> stand").select("token", "stand"))
    label = F.concat(F.lit("label="), F.col("label"))
    baskets = durable(rows.select("row", label.alias("label")).join(standing(rows, alike), "row", "left").select("row", "label", F.coalesce("t", F.array().cast("array<string>")).alias("t")))
    together, late = combined(baskets, often, support, confidence, widest)
    items_of_urls = together.select(F.array_append("t", F.col("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items_of_urls)
    found = model.associationRules.select("antecedent", "consequent", "confidence", "support").unionByName(late)
    found = found.where(F.element_at("consequent", 1).startswith("label=") & ~F.exists("antecedent", lambda t: t.startswith("label=")))
    found = durable(found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 7, 1 << 20).alias("label"), "confidence", "support"))
    # a rule is superfluous if leaving out one of its tokens gives a rule for the label with no less confidence
    shorter = found.select(F.col("tokens").alias("s"), F.col("label").alias("l"), F.col("confidence").alias("c"))
    less = found.select("tokens", "label", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("s"))
    over = less.join(shorter, (less.s == shorter.s) & (less.label == shorter.l) & (shorter.c >= less.confidence), "left_semi").select("tokens", "label").distinct()
    kept = found.join(over, ["tokens", "label"], "left_anti")
    rare = kept.select("tokens", "label", F.explode("tokens").alias("token")).join(often, "token").groupBy("tokens", "label").agg(F.min(F.struct("count", "token")).getField("token").alias("key"))
    rules = durable(kept.join(rare, ["tokens", "label"]).select("tokens", "key", "label", "confidence", "support"))
    discard(rows, often, baskets, found)
    return Mined(rules, alike)


def given(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest given rule (verdict, host, path) that fits, as a struct of rule and verdict, or null.

    A rule fits its host and all subdomains, if the path starts with the rule's. The list is written into
    the expression; it is configuration, not data.
    """
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    fits = [F.when(((host_ == h) | F.endswith(host_, F.lit(f".{h}"))) & F.startswith(path_, F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(none, *fits))


def judge(pages: DataFrame, mined: Mined, rules: Sequence[tuple[str, str, str]] = (), url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with the columns host, path, rule, verdict and mined (the tokens of the mined rule that decided).

    A given rule decides first; else the mined rule of highest confidence, then support, then in order of
    tokens; else the default. Null URLs get the default. Repeated rows are judged alike; very long URLs are judged by all
    their tokens. The columns get underscores in front where pages has such names. Empty input: empty result.
    """
    names = fresh(pages.columns, "host", "path", "rule", "verdict", "mined")
    numbered = [f"__{i}" for i in range(len(pages.columns))]
    url = F.col(f"__{pages.columns.index(url_col)}")
    rows = durable(pages.toDF(*numbered).withColumns({"host": host(url), "path": path(url), "row": F.monotonically_increasing_id()}))
    rows = rows.withColumn("given", given(F.col("host"), F.col("path"), rules))
    index = mined.rules.select("key", F.col("tokens").alias("need"), "label", "confidence", "support")
    if index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    own = standing(rows.where("given is null").select("row", tokens(url).alias("t")), mined.alike)
    met = own.select("row", "t", F.explode("t").alias("key")).join(index, "key").where(F.size(F.array_except("need", "t")) == 0)
    best = met.groupBy("row").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "need", "label")).alias("best"))
    out = rows.join(best, "row", "left")
    verdict = F.coalesce("given.verdict", "best.label", F.lit(default))
    new = (F.col("host"), F.col("path"), F.col("given.rule"), verdict, F.when(F.col("given").isNull(), F.col("best.need")))
    return out.select(*[F.col(n).alias(c) for n, c in zip(numbered, pages.columns, strict=True)], *[x.alias(n) for x, n in zip(new, names, strict=True)])
