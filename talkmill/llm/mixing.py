"""Mixing sources to target weights by entropy balancing.

Rates r of the documents are sought that stay as close as possible, in relative entropy, to
taking every document once, while the words taken from each source meet its target:

    minimise  sum r log r - r + 1   subject to   sum size * r = target of the source,  r <= cap.

The convex dual has one multiplier a source, and r = min(cap, exp(multiplier * size)):
exponentially tilted rates. Newton iterations find all multipliers at once; each is one
aggregation over the counts of (source, size), bracketed so that the cap's kinks can't throw it.
Rates become copies by hash-dithered rounding, floor(r + u + shift), where u is drawn from the
document's id and the source's shift is searched so that the words taken meet the target as
closely as whole documents allow. Sums are of integers or decimals, so reruns agree.

All of it is DataFrame expressions. Sources are keys of joins and of pre-aggregated sums, never
partitions, so one source may hold most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import saved

CAP = 3
ROUNDS = 80
#: Relative distance of the words from their target at which Newton stops.
CLOSE = 1e-7
GRID, PASSES = 32, 3
WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Words separated by ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(source: Column) -> Column:
    """A source as a key that is never null and orders by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def draw(*columns: str) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.xxhash64(*columns).bitwiseAND((1 << 40) - 1).cast("double") / float(1 << 40)


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("key").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    )


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, the position of ``key`` from 0: by ranges, then inside each."""
    dealt = saved(
        sources.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "source-ranges"
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("range").agg(F.count("*").alias("rows")).select(
        "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    )  # one row a range
    inside = Window.partitionBy("range").orderBy("key")
    return (
        dealt.withColumn("own", F.row_number().over(inside) - 1)
        .join(before, "range")
        .withColumn("place", F.col("before") + F.col("own"))
        .drop("range", "own", "before")
    )


def share_out(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``target`` of each of ``sources (key, source_size, weight)``: all words shared by weight;
    a target stops at ``cap`` times its source, and the rest is shared again until none is above.

    The level (words a unit of weight) only rises, so each round is one aggregate of the sources,
    and rounds end when no further source stops.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weights if weights else 0.0
    while weights:
        full = F.col("weight") * F.lit(float(level)) >= F.col("source_size") * cap
        stopped, free = sources.agg(
            F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        rising = (total - stopped) / free if free else level
        if rising <= level:
            break
        level = rising
    return sources.withColumn(
        "target",
        F.least(F.col("weight") * F.lit(float(level)), (F.col("source_size") * cap).cast("double")),
    )


def rate(tilt: Column, size: Column, scale: Column, cap: int) -> Column:
    """min(cap, exp(tilt * size / scale)), rounded so that it is the same in every run."""
    power = F.least(tilt * size / scale, F.lit(5.0))
    return F.round(F.least(F.lit(float(cap)), F.exp(power)), 9)


def tilts(sized: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``key, tilt, scale`` by Newton's method; ``sources (key, source_size, n, least, target)``."""
    counts = saved(
        sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("docs")), "size-counts"
    )
    scale = F.col("source_size") / F.col("n")
    smallest = F.col("least") / scale
    goal = F.col("target") / F.col("source_size")
    state = saved(
        sources.where("source_size > 0").select(
            "key",
            "target",
            scale.alias("scale"),
            F.when(goal >= cap, F.log(F.lit(cap * 1.0)) / smallest * 1.01).otherwise(0.0).alias("tilt"),
            F.least(F.lit(0.0), F.log(F.greatest(goal, F.lit(1e-300))) / smallest * 1.01 - 1e-6).alias("low"),
            (F.log(F.lit(cap * 1.0)) / smallest * 1.01 + 1e-6).alias("high"),
        ),
        "tilts",
    )
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("scale")
        own = rate(F.col("tilt"), F.col("size"), F.col("scale"), cap)
        words = F.col("docs") * F.col("size") * own
        sums = (
            counts.join(state, "key")
            .groupBy("key", "target", "scale", "tilt", "low", "high")
            .agg(exact(words).alias("words"), exact(F.when(own < cap, words * x).otherwise(0.0)).alias("slope"))
        )
        over = F.col("words") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.try_divide(F.col("words") - F.col("target"), F.col("slope"))
        close = F.abs(F.col("words") - F.col("target")) <= F.col("target") * CLOSE
        state = saved(
            sums.select("key", "target", "scale", low.alias("low"), high.alias("high"), step.alias("step"), "tilt", close.alias("close"))
            .select(
                "key",
                "target",
                "scale",
                F.when(F.col("close"), F.col("tilt"))
                .when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step"))
                .otherwise((F.col("low") + F.col("high")) / 2)
                .alias("tilt"),
                "low",
                "high",
                (F.col("close") | (F.col("high") - F.col("low") < 1e-12)).alias("close"),
            ),
            "tilts",
        )
        if state.where("not close").isEmpty():
            break
        state = state.drop("close")
    return state.select("key", "tilt", "scale")


def copies_of(tilt: Column, size: Column, scale: Column, drawn: Column, shift: Column, cap: int) -> Column:
    whole = F.floor(rate(tilt, size, scale, cap) + drawn + shift)
    return F.when((size > 0) & whole.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(cap), whole))).otherwise(0).cast("long")


def shifts(sized: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``key, shift``: in ``PASSES`` aggregations over the documents, each of ``GRID`` candidates
    at once, the shift whose rounded words come nearest to the target."""
    state = sources.select("key", "tilt", "scale", "target", F.lit(-1.0).alias("low"), F.lit(2.0).alias("width"))
    for number in range(PASSES):
        at = [F.col("low") + F.col("width") * (i / GRID) for i in range(GRID + 1)]
        words = F.array(
            *(
                F.sum(F.col("size") * copies_of(F.col("tilt"), F.col("size"), F.col("scale"), F.col("drawn"), s, cap))
                for s in at
            )
        )
        sums = (
            sized.join(state, "key")
            .groupBy("key", "tilt", "scale", "target", "low", "width")
            .agg(words.alias("words"))
            # words rise with the shift: the last candidate that stays at or under the target
            .withColumn("under", F.greatest(F.lit(1), F.size(F.filter("words", lambda w: w <= F.col("target")))))
            .withColumn("begin", F.col("low") + F.col("width") * ((F.col("under") - 1) / GRID))
        )
        last = number == PASSES - 1
        below = F.abs(F.element_at("words", F.col("under")) - F.col("target"))
        above = F.abs(F.element_at("words", F.least(F.lit(GRID + 1), F.col("under") + 1)) - F.col("target"))
        begin = (
            F.when(above < below, F.col("begin") + F.col("width") / GRID).otherwise(F.col("begin")) if last else F.col("begin")
        )
        state = saved(
            sums.select("key", "tilt", "scale", "target", begin.alias("low"), (F.col("width") / GRID).alias("width")),
            "shifts",
        )
    return state.select("key", F.col("low").alias("shift"))


def plan(docs: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """``sized (doc_id, key, size, drawn)`` of all documents, and of all sources
    ``key, source_size, target, tilt, scale, shift``. Weights are 1, 2, 3, repeating, in the order
    of the sources."""
    sized = saved(
        docs.select("doc_id", key_of(F.col("source")).alias("key"), size_of(F.col("text")).alias("size"))
        .withColumn("drawn", draw("doc_id", "size")),
        "sizes",
    )
    sources = ranked(source_sizes(sized)).withColumn("weight", F.col("place") % 3 + 1).drop("place")
    sources = saved(share_out(saved(sources, "sources"), cap), "targets")
    sources = saved(sources.join(tilts(sized, sources, cap), "key", "left"), "tilted")
    found = sources.join(shifts(sized, sources, cap), "key", "left")
    return sized, saved(found.select("key", "source_size", "target", "tilt", "scale", "shift"), "mix")


def taken(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """``doc_id, size, source_size, target, taken, rate`` of every row of ``docs``.

    Documents of no words are taken no times. A null source is a source of its own. Rows that
    repeat are decided each, alike.
    """
    sized, sources = plan(docs, cap)
    copies = copies_of(F.col("tilt"), F.col("size"), F.col("scale"), F.col("drawn"), F.col("shift"), cap)
    return sized.join(sources, "key").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        F.coalesce(rate(F.col("tilt"), F.col("size"), F.col("scale"), cap), F.lit(0.0)).alias("rate"),
    )


def mixed(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, columns unchanged."""
    _, sources = plan(docs, cap)
    names = docs.columns
    size = size_of(F.col("text"))
    own = docs.withColumn("__key", key_of(F.col("source"))).withColumn("__size", size)
    own = own.withColumn("__drawn", F.xxhash64("doc_id", "__size").bitwiseAND((1 << 40) - 1).cast("double") / float(1 << 40))
    params = sources.select(*(F.col(c).alias(f"__{c}") for c in ("key", "tilt", "scale", "shift")))
    copies = copies_of(F.col("__tilt"), F.col("__size"), F.col("__scale"), F.col("__drawn"), F.col("__shift"), cap)
    return (
        own.join(params, "__key")
        .withColumn("__copies", copies.cast("int"))
        .where("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
        .select(names)
    )
