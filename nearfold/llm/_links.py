"""Connected components of a link table, joins with sums, and a sieve before joins of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store
from ._store import fresh

#: Keys of at least this share of all rows are hot: there are fewer of them than 1 / HOT, whatever the data.
HOT = 1 / 1_000
#: Bits of a sieve, at most 131,072 rows; it lets through more as the keys grow.
SIEVE_BITS = 1 << 23


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in ``edges`` (a, b long): label is the smallest id that links reach.

    Each round maps an id to its smallest neighbour, or that one's, and replaces links by links between what their ends map
    to, until none is left: links fall away fast, and the smallest id of a component always maps to itself. Every round is
    written to the shared folder; minima are summed before they are shuffled, so a hub is one row per task.
    """
    left = _store.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while True:
        both = left.select(F.col("a").alias("id"), "b").union(left.select("b", "a"))
        near = _store.table(both.groupBy("id").agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "near")
        far = near.select(F.col("id").alias("label"), F.col("label").alias("far"))
        labels = _store.table(near.join(far, "label").select("id", F.col("far").alias("label")), "labels")
        rounds.append(labels)
        a, b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        ends = left.join(a, "a").join(b, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        left = _store.table(ends.distinct(), "links")
        if not left.limit(1).count():
            break
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("id").alias("label"), F.col("label").alias("last"))
        found = rounds.pop().join(later, "label", "left").select("id", F.coalesce("last", "label").alias("label"))
    return _store.table(found, "labels")


def matched(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``sums``, a written table of one row per ``key`` whose column ``rows`` counts the rows that have it.

    A key with more than HOT of the rows counted would land in one task. There are at most 1 / HOT such keys, so these go to all
    executors, and their rows stay where they are; the others are joined by shuffles, in which no key has more than that.
    """
    total = sums.agg(F.sum("rows")).first()[0] or 0
    hot = sums.where(F.col("rows") > HOT * total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(sums.where(F.col("rows") <= HOT * total), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def sifted(rows: DataFrame, keys: DataFrame, on: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows of which a key may be among ``keys``, rows of which none is): ``on`` has a column of ``rows`` for each of ``keys``.

    A bit is set at the hash of each key, so whatever is not at one needs no join, and its text no shuffle. Every row is in one of
    the two. The sieve is of a fixed size, so it goes to all executors.
    """
    word, bit, mask = (fresh(rows, c) for c in ("word", "bit", "mask"))
    place = F.pmod(F.xxhash64(*on), F.lit(SIEVE_BITS))
    set_ = keys.select(place.alias("p")).select(F.shiftright("p", 6).alias(word), F.expr("shiftleft(1L, cast(p & 63 as int))").alias(mask))
    sieve = _store.table(set_.groupBy(word).agg(F.bit_or(mask).alias(mask)), "sieve")
    place = F.pmod(F.xxhash64(*on.values()), F.lit(SIEVE_BITS))
    placed = rows.withColumns({word: F.shiftright(place, 6), bit: place.bitwiseAND(F.lit(63)).cast("int")})
    held = placed.join(F.broadcast(sieve), word, "left").withColumn(bit, F.coalesce(F.expr(f"bit_get({mask}, {bit})") == 1, F.lit(False)))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return held.where(F.col(bit)).select(*own), held.where(~F.col(bit)).select(*own)
