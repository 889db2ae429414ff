"""Mixing sources to target weights by Pareto order sampling.

1. A source's words are taken at its target over its size on average, longer documents more often: the rate of a document
   is the source's level times LEAD + the bits of its size, at most MOST. The level is such that rates times sizes make the
   target.
2. Every document is taken floor(rate) times for certain; the rest of its rate is the inclusion probability p of one more copy.
3. Pareto sampling (Rosen) ranks the documents of a source by (u / (1 - u)) / (p / (1 - p)), u from a hash of the document, and
   takes the smallest until the words that the certain copies leave open are filled: a sample of fixed size in words, with
   the inclusion probabilities asked for, whatever their differences. Where the source's rest ends within a document, the end
   that is nearer counts. Ranks are found by sums over 2**LEVEL ranges of the order, twice, so that no task holds a source,
   and within the last range by sums over its rows that are equal, in SPLIT pieces, so that no task holds all copies of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store

#: Weights of the sources by code point, repeating, and the most that a document is repeated.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
LEVEL = 12
#: Pieces of rows of equal order, doc_id and size.
SPLIT = 1 << 12
#: What the bits of a size are added to: a document of 2**10 words weighs (LEAD + 10) / LEAD times one of a single word.
LEAD = 4
#: ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Shares of all sizes by weight, but at most ``most`` times a source's size; what is over is shared anew by weight. That is
    least(cap, level * weight) for the level that uses all up: sources in the order of cap / weight are capped as long as the
    level that the rest would get is not below that.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upward = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_ = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upward), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upward), F.lit(0.0))
    s = s.withColumn("level", open_ / free).withColumn("nth", F.row_number().over(order))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))).over(everything)["level"]
    return s.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _ranged(docs: DataFrame, left: DataFrame, depth: int) -> DataFrame:
    """The range of depth ``depth`` of each source in which its rest ends: (source, prefix, open) with what is open at its start."""
    bits = LEVEL * (depth + 1)
    part = docs.withColumn("part", F.shiftrightunsigned("order", 63 - bits))
    if depth:
        part = part.join(left.select(F.col("source").alias("s"), "prefix", "open"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("part", LEVEL) == F.col("prefix")))
    else:
        part = part.join(left.select(F.col("source").alias("s"), "open"), F.col("source").eqNullSafe(F.col("s")))
    sums = part.groupBy("source", "part").agg(F.sum("size").alias("n"), F.first("open").alias("open"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sums.withColumn("open", F.col("open") - before)
    return _store.table(at.where("open > 0").groupBy("source").agg(F.max_by("part", "part").alias("prefix"), F.max_by("open", "part").alias("open")), "range")


def rates(classes: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """(source, bits, words, rate, target) from (source, bits, words): ``words`` of documents whose sizes have ``bits`` bits
    after the first; and from (source, source_size, target). Rates times words make the source's target.

    That is least(most, level * weight) for the level that uses the target up: from the heaviest downwards, classes are at most
    as long as the level that the rest would get lifts them over it.
    """
    c = classes.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    c = c.withColumn("weight", F.col("bits") + float(LEAD)).withColumn("load", F.col("weight") * F.col("words"))
    of = Window.partitionBy("source")
    above = of.orderBy(F.desc("bits")).rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.col("target") - F.lit(most) * F.coalesce(F.sum("words").over(above), F.lit(0))
    free = F.sum("load").over(of) - F.coalesce(F.sum("load").over(above), F.lit(0.0))
    c = c.withColumn("level", open_ / free)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.lit(most), F.struct("bits", "level"))).over(of)["level"]
    rate = F.coalesce(F.least(F.lit(most), level * F.col("weight")), F.lit(most))
    return c.select("source", "bits", "words", rate.alias("rate"), "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``docs`` (doc_id, text, source; others not read).

    ``size``: words of the text, 0 if null. ``taken``: size times copies. Null is a source of its own, the last; documents
    without words have no copies. Copies never exceed ``most`` rounded down, or up where the rate has a rest. The order
    follows from doc_id alone, or the text where that is null, so every run gives the same rows; of rows equal in both, source and
    size, any may be the one that is taken. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    number = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.md5("text"), F.lit("")))
    hashed = F.conv(F.substring(F.md5(number), 1, 13), 16, 10).cast("long")  # 52 bits
    base = docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), hashed.alias("hash"))
    base = base.withColumn("bits", F.when(F.col("size") > 0, F.length(F.bin("size")) - 1)).withColumn("row", F.monotonically_increasing_id())
    base = _store.table(base, "sizes")
    classes = _store.table(base.groupBy("source", "bits").agg(F.sum("size").alias("words")), "classes")
    goals = _store.table(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "targets")
    classes = classes.where("bits is not null")
    shares = rates(classes, goals, most).withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("long"))
    shares = _store.table(shares.withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))), "rates")
    mine = shares.select(F.col("source").alias("s"), F.col("bits").alias("b"), "whole", "p")
    joined = base.where("size > 0").join(mine, F.col("source").eqNullSafe(F.col("s")) & (F.col("bits") == F.col("b"))).drop("s", "b")
    ranked = _rank(joined.where("p > 0"))
    left = shares.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("open")).where("open > 0")
    for depth in (0, 1):
        left = _ranged(ranked, left, depth)
    cut = left.select(F.col("source").alias("c"), "prefix", "open")
    part = F.shiftrightunsigned("order", 63 - 2 * LEVEL)
    at = ranked.join(cut, F.col("source").eqNullSafe(F.col("c")), "left").withColumn("part", part)
    edge = _edge(at.where("part = prefix"))
    rest = at.where("prefix is null or part <> prefix").withColumn("more", F.coalesce(F.col("part") < F.col("prefix"), F.lit(False)))
    drawn = rest.unionByName(edge).select("doc_id", "source", "size", (F.col("whole") + F.col("more").cast("long")).alias("copies"))
    certain = joined.where("p = 0").select("doc_id", "source", "size", F.col("whole").alias("copies"))
    none = base.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copies"))
    out = drawn.unionByName(certain).unionByName(none).join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _edge(at: DataFrame) -> DataFrame:
    """Adds ``more`` to the rows of one range of 2**-24 of each source: in order until the rest is used up, the last by the nearer end."""
    same = ["source", "order", "doc_id", "size"]
    at = at.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(SPLIT)))
    sums = at.groupBy(*same, "piece").agg(F.sum("size").alias("n"))
    upward = Window.partitionBy("source").orderBy("order", "doc_id", "size", "piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(upward), F.lit(0)))
    sums = _store.table(sums.select(*(F.col(c).alias(f"{c}_") for c in (*same, "piece")), "before"), "pieces")
    alike = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*same, "piece")]
    nth = F.row_number().over(Window.partitionBy(*same, "piece").orderBy("row")) - 1
    left = F.col("open") - F.col("before") - nth * F.col("size")
    return at.join(sums, alike).withColumn("more", (left > 0) & (left >= F.col("size") / 2)).drop(*(f"{c}_" for c in (*same, "piece")), "piece", "before")


def _rank(joined: DataFrame) -> DataFrame:
    """Adds ``order``: the Pareto rank as a number of 63 bits, smallest first."""
    u = (F.col("hash").cast("double") + 0.5) / float(1 << 52)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    return joined.withColumn("order", F.floor(F.least(q / (1 + q), F.lit(1 - 2.0**-53)) * float(1 << 53)).cast("long") * 1024)
