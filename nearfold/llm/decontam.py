"""Benchmark items in documents, by SimHash of item-sized windows.

1. A window that is similar to an item shares shingles with it. Stretches of a text whose shared shingles weigh enough for
   the similarity asked for are found exactly, the rest passed by.
2. In such stretches, windows as long as the items of a size class get fingerprints: signs of the weighted sums of their
   shingles' random signs.
3. Items are indexed by BLOCKS blocks of their fingerprints, each with a radius of its own; the radii and one for each block
   but the first sum up to RADIUS. Two fingerprints that differ by more in every block differ by more than RADIUS in all,
   so blocks within their radius give every item within RADIUS (Qin et al., general pigeonhole principle).
4. Candidates are confirmed by the weighted Jaccard similarity of shingle sets, at every start near the window.

A shingle of n items of N weighs log(1 + N / n), one of no item as much as one of a single item.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._store import fresh
from ._words import LOWER, NOT_ALNUM, U64, blocks, grams, mix, words

SHINGLE, SIMILAR = 5, 0.8
BITS, BLOCKS, RADIUS = 144, 8, 32
#: Bits that a block of an item may differ by: the first blocks by one more, so that they sum up to RADIUS - BLOCKS + 1.
RADII = tuple((RADIUS - BLOCKS + 1) // BLOCKS + (b < (RADIUS - BLOCKS + 1) % BLOCKS) for b in range(BLOCKS))
#: Ratio of the sizes of a class; windows start every 1 / STEPS of their size.
CLASS, STEPS = 1.04, 32
#: Characters of the items that are held against the documents in one pass.
SLICE_CHARS = 32_000_000
#: Blocks that are compared at a time.
AT_ONCE = 1 << 20
#: What sums of weights may be off by: a similarity of SIMILAR but for that counts.
ROUNDING = 1e-9
KIND = pa.list_(pa.struct([("item", pa.int64()), ("similarity", pa.float64())]))
KIND_SQL = "array<struct<item:long,similarity:double>>"
ITEMS = f"items {KIND_SQL}"


def _signs(hashes: np.ndarray) -> np.ndarray:
    """(n, BITS) of -1 and 1."""
    wide = np.stack([mix(hashes + U64(k + 1)) for k in range(-(-BITS // 64))], axis=1)
    return np.unpackbits(wide.view(np.uint8), axis=1, count=BITS).astype(np.int8) * 2 - 1


def _code(sums: np.ndarray) -> np.ndarray:
    """Blocks (..., BLOCKS) of the signs of ``sums`` (..., BITS), as numbers."""
    wide = BITS // BLOCKS
    return (sums.reshape(*sums.shape[:-1], BLOCKS, wide) > 0) @ (1 << np.arange(wide, dtype=np.uint32))


@cache
def _flips(wide: int, bits: int) -> np.ndarray:
    """All numbers of ``wide`` bits of which at most ``bits`` are set."""
    return np.array([sum(1 << p for p in places) for n in range(bits + 1) for places in combinations(range(wide), n)], np.uint32)


class Blocks:
    """An index of fingerprints ``codes`` (n, BLOCKS)."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for b in range(BLOCKS):
            values, place = np.unique(codes[:, b], return_inverse=True)
            self.tables.append((values, np.argsort(place, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(values)))])))

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``codes`` (m, BLOCKS), fingerprint), in order: all of which some block is within its radius."""
        found = []
        for b, ((values, order, start), radius) in enumerate(zip(self.tables, RADII)):
            flips = _flips(BITS // BLOCKS, radius)
            step = max(1, AT_ONCE // min(len(flips), len(values)))
            for lo in range(0, len(codes), step):
                own = codes[lo : lo + step, b, None]
                if len(flips) < len(values):  # the neighbours are looked up
                    at = np.minimum(np.searchsorted(values, own ^ flips), len(values) - 1)
                    which, place = np.nonzero(values[at] == own ^ flips)
                    value = at[which, place]
                else:  # the same by comparing all values, which are fewer
                    which, value = np.nonzero(np.bitwise_count(values ^ own) <= radius)
                size = start[value + 1] - start[value]
                nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                found.append((np.repeat(which, size) + lo) * np.int64(len(self.codes)) + order[np.repeat(start[value], size) + nth])
        both = np.unique(np.concatenate(found))
        return both // len(self.codes), both % len(self.codes)

    def within(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``codes``, fingerprint), in order: all within RADIUS bits."""
        which, near = self.candidates(codes)
        keep = np.bitwise_count(self.codes[near] ^ codes[which]).sum(axis=1) <= RADIUS
        return which[keep], near[keep]


def _hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(data, np.array([0, len(data)]), NOT_ALNUM, LOWER)[0]


def _find(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``known``, whether they hold the hashes)."""
    if not len(known):
        return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return at, known[at] == hashes


class Index:
    """Of ``items``; ``whole`` (number, shingles in order, their holders) counts those of all slices, if these are one of several:
    shingles that are not in it have one holder or none."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, similar: float = SIMILAR, whole: tuple[int, np.ndarray, np.ndarray] | None = None):
        self.shingle, self.similar = shingle, similar
        self.ids, self.sets, self.sizes = [], [], []
        for i, text in items:
            hashes = _hashes(text)
            if len(hashes) >= shingle:
                self.ids.append(i)
                self.sets.append(np.unique(grams(hashes, shingle)))
                self.sizes.append(len(hashes))
        self.known, holders = np.unique(np.concatenate(self.sets) if self.sets else np.empty(0, U64), return_counts=True)
        number, self.counted, holders = whole or (len(self.ids), self.known, holders)
        self.most = log(1 + max(1, number))
        self.weight = np.log(1 + number / np.maximum(1, holders))
        self.total = np.array([self.weigh(s).sum() for s in self.sets])
        sums = [self.weigh(x) @ _signs(x) for x in self.sets]
        codes = _code(np.array(sums).reshape(len(sums), BITS)).astype(np.uint32)
        by: dict[int, list[int]] = defaultdict(list)
        for k, n in enumerate(self.sizes):
            by[ceil(log(n) / log(CLASS))].append(k)
        #: Of each size: the least weight of its items, their numbers and their fingerprints.
        self.classes = {max(self.sizes[k] for k in of): (min(self.total[k] for k in of), np.array(of), Blocks(codes[of])) for of in by.values()}

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        at, hit = _find(self.counted, hashes)
        return np.where(hit, self.weight[at], self.most) if len(self.counted) else np.full(len(hashes), self.most)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.known, hashes)

    def similarity(self, k: int, window: np.ndarray) -> float:
        other = np.unique(window)
        common = self.weigh(np.intersect1d(self.sets[k], other, assume_unique=True)).sum()
        return float(common / (self.total[k] + self.weigh(other).sum() - common))

    def search(self, every: np.ndarray) -> dict[int, float]:
        """Items and their similarity, for the shingles of one text in order."""
        _, hit = self.find(every)
        where = np.flatnonzero(hit)
        if not len(where):
            return {}
        found: dict[int, float] = {}
        tried: set[tuple[int, int]] = set()
        longest = max(self.classes)
        # stretches of hits that a window could hold together
        for part in np.split(where, np.flatnonzero(np.diff(where) > longest) + 1):
            lo, hi = max(0, int(part[0]) - longest), min(len(every), int(part[-1]) + longest + 1)
            piece = every[lo:hi]
            weights, hits = self.weigh(piece), hit[lo:hi]
            got = np.concatenate([[0], np.cumsum(weights * hits)])
            signs = None
            for size, (least, items, index) in self.classes.items():
                n, step = size - self.shingle + 1, max(1, size // STEPS)
                # starts a step apart over the whole stretch, and its end: a window is half a step from one at most
                starts = np.unique(np.append(np.arange(0, max(1, len(piece) - n + 1), step), max(0, len(piece) - n)))
                # what an item's window nearby can have in common, against what its set weighs at least
                a, b = np.maximum(0, starts - step), np.minimum(len(piece), starts + n + step)
                starts = starts[got[b] - got[a] >= self.similar * least - ROUNDING]
                if not len(starts):
                    continue
                if signs is None:
                    signs = np.concatenate([np.zeros((1, BITS)), np.cumsum(_signs(piece) * weights[:, None], axis=0)])
                sums = signs[np.minimum(starts + n, len(piece))] - signs[starts]
                which, near = index.within(_code(sums).astype(np.uint32))
                for start, k in zip(starts[which].tolist(), items[near].tolist()):
                    m = self.sizes[k] - self.shingle + 1
                    for s in range(max(0, start - step), min(start + step + n - m, max(0, len(piece) - m)) + 1):
                        if (k, lo + s) not in tried:
                            tried.add((k, lo + s))
                            found[k] = max(self.similarity(k, piece[s : s + m]), found.get(k, 0.0))
        return {k: x for k, x in found.items() if x >= self.similar - ROUNDING}


def _searched(index: Index, column: pa.Array) -> Iterator[dict[int, float]]:
    for _, _, buf, bounds in blocks(column):
        hashes, _, _, first = words(buf, bounds, NOT_ALNUM, LOWER)
        every = grams(hashes, index.shingle)
        _, hit = index.find(every)
        some = np.concatenate([[0], np.cumsum(hit)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            b = b - index.shingle + 1
            yield index.search(every[a:b]) if b > a and some[b] > some[a] else {}


def indexes(benchmark: DataFrame) -> tuple[int, Iterator[Index]]:
    """(number, indexes) of slices of the items, each small enough to be sent to all executors. They are made one by one, all
    with the weights of the whole benchmark."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, ceil(chars / SLICE_CHARS))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")

    def each() -> Iterator[Index]:
        whole = counts(items) if slices > 1 else None
        for k in range(slices):
            rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).collect()
            yield Index(sorted({(r["item_id"], r["text"]) for r in rows}), whole=whole)

    return slices, each()


def counts(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of items with a shingle, shingles of several items in order, their holders)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if len(hashes := _hashes(text)) >= SHINGLE:
                    own = np.unique(grams(hashes, SHINGLE)).astype(U64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.arange(len(own)) == 0)], ["shingle", "first"])

    spread = _store.table(items.distinct().mapInArrow(run, "shingle long, first boolean"), "shingles")
    number = spread.where("first").count()
    table = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toArrow()
    shared, n = table.column("shingle").to_numpy().view(U64), table.column("n").to_numpy()
    order = np.argsort(shared)
    return number, shared[order], n[order]


def _numbered(docs: DataFrame, indexes: Iterator[Index]) -> tuple[str, DataFrame, DataFrame]:
    """(name of a new column, docs with a number in it, (number, items) of those with leaks): a pass over the documents for each
    slice."""
    row = fresh(docs, "row")
    kept = _store.table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = None
    for index in indexes:
        leaks = _store.table(kept.select(row, "text").mapInArrow(_pass(index, row), f"{row} long, {ITEMS}").where(F.size("items") > 0), "leaks")
        found = leaks if found is None else found.union(leaks)
    return row, kept, found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))


def _pass(index: Index, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(({"item": index.ids[k], "similarity": s} for k, s in found.items()), key=lambda x: x["item"]) for found in _searched(index, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, KIND)], [key, "items"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, items array<struct<item, similarity>>) for every row of ``docs`` (doc_id, text): the items of ``benchmark``
    (item_id, text) that some window of the document resembles by SIMILAR or more, by item.

    Words are runs of ASCII digits, lower-cased letters and other characters from U+0080. Null and empty texts, texts and items
    under SHINGLE words have no shingle and match nothing. Rows that repeat come out as often; an empty table gives an empty
    result; other columns are not read.
    """
    named = docs.select("doc_id", "text")
    slices, every = indexes(benchmark)
    if slices == 1:
        return named.mapInArrow(_pass(next(every), "doc_id"), f"doc_id {dict(named.dtypes)['doc_id']}, {ITEMS}")
    row, kept, found = _numbered(named, every)
    return kept.select(row, "doc_id").join(found, row, "left").select("doc_id", F.coalesce("items", F.array().cast(KIND_SQL)).alias("items"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    slices, every = indexes(benchmark)
    if slices > 1:
        row, kept, found = _numbered(docs, every)
        return kept.join(found, row, "left_anti").select(docs.columns)
    index = next(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.fromiter((not found for found in _searched(index, batch.column("text"))), bool, batch.num_rows)))

    return docs.mapInArrow(run, docs.schema)
