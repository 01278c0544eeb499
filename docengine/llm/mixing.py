"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target number of words. A document of a source with target/size ratio r is
expected r times in the mix (scaled by its importance where a column of that is named): the whole part
are certain copies, the rest is its inclusion probability. Documents are ranked by the odds of their
random number divided by the odds of their inclusion (Rosen 1997), and each one in that order is taken
if it isn't longer than the words still needed, so that the sample's size in words is fixed: what stays
away from the target is less than any document that could still be drawn. That is done in rounds over
all sources at once, the next round with the documents behind those looked at that fit what is left,
until none does. Rows that tie are taken as one, and fit with all their words or not at all.

Words are summed in two levels of buckets of the ranking variable before any row is ordered, so that
no source, however large, is ever sorted in one task. The tables of one row per source are broadcast
after a check of their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, fresh

#: Buckets of the ranking variable on each of the two levels.
BUCKETS = 2048
#: Documents of a source that a round goes through one by one.
RUN = 500
#: Sources whose table is broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of sources: rows (source, source_size) to (source, source_size, target).

    Sources in order of code points, null last, take the weights in turn. All targets together are
    `share` of all sizes, in proportion to weights; none is above `most` times its source's size, and
    what is cut off goes to the others by weight. The fixed point of that is found in one pass: sources
    are capped in order of size per weight. One row per source is gathered in one task; sources are
    named in the mix's configuration, so that they are few.
    """
    everyone = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.coalesce(*[F.when(F.col("_turn") == i, F.lit(float(x))) for i, x in enumerate(weights)])
    s = sizes.withColumn("_turn", turn).withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("_all", F.lit(float(share)) * F.sum("source_size").over(everyone))
    by = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    above = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # words per weight if all sources before this one are capped; the first that stays below its cap sets it
    s = s.withColumn("_level", (F.col("_all") - above) / rest)
    found = F.struct(F.row_number().over(by).alias("i"), F.col("_level").alias("level"))
    s = s.withColumn("_found", F.when(F.col("_level") * F.col("_w") < F.col("_cap"), found))
    s = s.withColumn("_level", F.min("_found").over(everyone).getField("level"))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return s.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float],
    share: float = 1.0,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    importance_col: str | None = None,
    seed: int = 1,
) -> DataFrame:
    """docs with the columns size, source_size, target, copies and taken (words taken, repeats counted).

    Null or empty texts have size 0 and count for nothing; a null source is a source of its own, the
    last; null ids are ids like others. Rows that repeat an id and text tie and are taken together. The
    five columns get underscores in front where docs has such names. An empty input gives an empty
    result. With importance_col (0 or more, null: 1), a source's expected copies are in proportion to
    it, `most` at most. Reruns with one seed agree whatever the partitions.
    """
    size, source_size, target, copies, taken, src = fresh(docs.columns, "size", "source_size", "target", "copies", "taken", "_src")
    # ids may repeat or be null, so that a row's random number comes from its id and text
    tie = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), tie), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    row = [F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), unit.alias("u"), tie.alias("tie")]
    row.append(F.greatest(F.coalesce(F.col(importance_col).cast("double"), F.lit(1.0)), F.lit(0.0)).alias("a") if importance_col else F.lit(1.0).alias("a"))
    # rows that tie are one: "all" has the words of all of them
    slim = docs.select(*row).groupBy("source", "size", "u", "tie", "a").count()
    slim = durable(slim.withColumn("all", F.col("size") * F.col("count")))

    sums = slim.groupBy("source").agg(F.sum("all").alias("source_size"), F.sum(F.col("all") * F.col("a")).alias("weighed"))
    aims = source_targets(sums.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "_s")
    aims = sums.join(aims.drop("source_size"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    aims = aims.withColumn("rate", F.when(F.col("weighed") > 0, F.col("target") / F.col("weighed")).otherwise(0.0))
    aims = durable(aims)
    # tables of one row per source are broadcast if they have been counted and are small, else joined by shuffle
    few = F.broadcast if aims.count() <= BROADCAST_SOURCES else (lambda df: df)

    def ranked(df: DataFrame) -> DataFrame:
        """Adds whole (certain copies) and p (the ranking variable, from 0 to 1; null: never drawn)."""
        rate = F.least(F.col("rate") * F.col("a"), F.lit(float(most)))
        pi = F.col("_rate") - F.col("whole")
        odds = (F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi))
        df = df.withColumn("_rate", rate).withColumn("whole", F.floor("_rate").cast("long"))
        return df.withColumn("p", F.when((pi > 0) & (F.col("size") > 0), odds / (1 + odds))).drop("_rate")

    rows = ranked(slim.join(few(aims.select(F.col("source").alias("_s"), "rate")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    cell = lambda n: F.least(F.floor(F.col("p") * n), F.lit(n - 1)).cast("long")
    certain = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("all")).alias("certain")).withColumnRenamed("source", "_s")
    lowest, step, one = -(1 << 63), "struct<gap:double,from_p:double,from_tie:bigint,to_p:double>", "struct<p:double,tie:bigint>"
    state = durable(
        aims.join(certain, F.col("source").eqNullSafe(F.col("_s"))).select(
            "source", "source_size", "target", "rate", (F.col("target") - F.col("certain")).cast("double").alias("gap"),
            F.lit(-1.0).alias("from_p"), F.lit(lowest).alias("from_tie"), F.lit(True).alias("open"), F.array().cast(f"array<{step}>").alias("steps"), F.array().cast(f"array<{one}>").alias("fill"),
        )
    )
    after = lambda p, tie: (F.col("p") > p) | ((F.col("p") == p) & (F.col("tie") > tie))

    def fitting(at: DataFrame) -> DataFrame:
        """Documents behind the last one looked at that fit the gap."""
        inside = rows.where("p is not null").join(few(at), F.col("source").eqNullSafe(F.col("_s")))
        return inside.where((F.col("all") <= F.col("gap")) & after(F.col("from_p"), F.col("from_tie")))

    fold = (
        f"aggregate(x, named_struct('g', gap - before, 't', cast(array() as array<{one}>)), "
        f"(s, d) -> if(d.all <= s.g, named_struct('g', s.g - d.all, 't', array_append(s.t, cast(struct(d.p, d.tie) as {one}))), s))"
    )
    # each round takes what fits the gap, up to the bucket that overflows it, and from there on goes through RUN documents
    # one by one; the next round goes on behind them
    while not state.where("open").isEmpty():
        at = state.where("open").select(F.col("source").alias("_s"), "gap", "from_p", "from_tie", F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("before"))
        level = 1
        for _ in range(2):
            # the bucket in which the gap is reached, of those within the bucket found before
            finer = level * BUCKETS
            inside = fitting(at).where(F.lit(level == 1) | (cell(level) == F.col("cell")))
            sums = inside.withColumn("c", cell(finer)).groupBy("source", "c").agg(F.sum("all").alias("n"), F.first("gap").alias("gap"), F.first("before").alias("before"))
            upto = F.sum("n").over(Window.partitionBy("source").orderBy("c"))
            sums = sums.withColumn("upto", upto + F.col("before")).where("upto > gap").groupBy("source").agg(F.min_by(F.struct("c", F.expr("upto - n").alias("b")), "c").alias("hit"))
            at = at.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
            at = durable(at.select("_s", "gap", "from_p", "from_tie", F.coalesce("hit.c", F.lit(finer)).cast("long").alias("cell"), F.coalesce("hit.b", "before").cast("long").alias("before")))
            level = finer
        nth = F.row_number().over(Window.partitionBy("source").orderBy("p", "tie"))
        run = fitting(at).where(cell(level) >= F.col("cell")).select("source", "p", "tie", "all").withColumn("nth", nth).where(F.col("nth") <= RUN)
        run = run.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("p", "tie", "all"))).alias("x"))
        ends = at.join(run, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("end", F.expr(fold)).select("_s", "cell", "end", F.when(F.size("x") == RUN, F.element_at("x", -1)).alias("last"))
        took = F.struct("gap", "from_p", "from_tie", F.when(F.col("cell") < level, F.col("cell") / F.lit(float(level))).otherwise(2.0).alias("to_p")).cast(step)
        state = durable(
            state.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "rate", F.coalesce("end.g", "gap").alias("gap"), F.coalesce("last.p", "from_p").alias("from_p"), F.coalesce("last.tie", "from_tie").alias("from_tie"),
                (F.col("open") & F.col("last").isNotNull() & (F.col("end.g") >= 1)).alias("open"), F.when(F.col("open"), F.array_append("steps", took)).otherwise(F.col("steps")).alias("steps"),
                F.when(F.col("end.t").isNotNull(), F.concat("fill", "end.t")).otherwise(F.col("fill")).alias("fill"),
            )
        )

    def drawn(words: str) -> Column:
        bulk = F.exists("steps", lambda x: (F.col(words) <= x["gap"]) & after(x["from_p"], x["from_tie"]) & (F.col("p") < x["to_p"]))
        return bulk | F.array_contains("fill", F.struct("p", "tie").cast(one))

    # rows that would fit by themselves, but not together with those that tie with them
    tied = rows.where("count > 1 and p is not null").join(few(state.select(F.col("source").alias("_s"), "steps", "fill")), F.col("source").eqNullSafe(F.col("_s")))
    tied = durable(tied.where(drawn("size") & ~drawn("all")).select(F.col("source").alias("_s"), F.col("tie").alias("_tie"), F.col("a").alias("_a"), F.lit(True).alias("refused")))
    n_tied = tied.count()

    # the input's columns go by number meanwhile, so that none clashes and those not asked for are never read
    numbered = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])
    out = docs.select(*docs.columns, *row).toDF(*numbered.columns, "source", "size", "u", "tie", "a")
    out = ranked(out.join(few(state.select(F.col("source").alias("_s"), "source_size", "target", "rate", "steps", "fill")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    fits = drawn("size")
    if n_tied:
        tied = F.broadcast(tied) if n_tied <= BROADCAST_SOURCES else tied
        out = out.join(tied, F.col("source").eqNullSafe(F.col("_s")) & (F.col("tie") == F.col("_tie")) & (F.col("a") == F.col("_a")), "left")
        fits = fits & F.col("refused").isNull()
    # a column of its own: names in a lambda would mean the select's aliases first
    out = out.withColumn("n", F.col("whole") + F.when(F.col("p").isNotNull() & fits, 1).otherwise(0))
    new = (F.col("size"), F.col("source_size"), F.col("target"), F.col("n"), F.col("n") * F.col("size"))
    return out.select(*[F.col(x).alias(c) for x, c in zip(numbered.columns, docs.columns, strict=True)], *[x.alias(c) for x, c in zip(new, (size, source_size, target, copies, taken), strict=True)])


def repeat(mixed: DataFrame, columns: Sequence[str], copies_col: str = "copies") -> DataFrame:
    """The mix itself: each row as often as it was taken; columns of any names."""
    (copy,) = fresh(mixed.columns, "_copy")
    return mixed.where(F.col(copies_col) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies_col)))).select(*columns)
