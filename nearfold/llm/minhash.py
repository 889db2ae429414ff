"""Near-duplicate documents by circulant MinHash, exactly confirmed.

Signature (Li & Li, "C-MinHash"): a first permutation scatters the shingles over 2**32 places; coordinate k is the least
value of a second permutation, circularly shifted by k. Two permutations so give every coordinate.

1. Rows with the same shingle set form a class; one of them stands for it.
2. ``BANDS`` bands of ``ROWS`` coordinates. A pair at the threshold shares a band but with probability
   (1 - 0.8**5)**42 < 1e-7.
3. Every class is held against one other: of the first members of its buckets, the one that it meets in most. Confirmed on the
   full sets, these links are joined to components. A bucket of one component is done: a further link changes nothing.
4. Members of the other buckets get sharper bands (``SHARP_BANDS`` of ``SHARP_ROWS``), which again hold every pair at the
   threshold together but with probability (1 - 0.8**10)**130 < 1e-6, and hardly ever pairs below one half. What they
   hold together is a cluster; if it holds several components so far, its sets are intersected exactly, block against block,
   and only links that join something leave a block. So no pairs are written, and no link that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._links import components, matched, sifted
from ._store import fresh
from ._words import LOWER, SPACE, U64, blocks, grams, lists, longs, mix, words

ROWS, BANDS = 5, 42
SHARP_ROWS, SHARP_BANDS = 10, 130
#: Of sets that are intersected with those of another block at a time.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 18
_U32 = np.uint32
#: Shingles whose shifted values are held at a time, so that they stay in the processor's cache.
_AT_ONCE = 256


def shingle_sets(buf: np.ndarray, bounds: np.ndarray, width: int, fold: np.ndarray = LOWER) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of ``width`` words, or of all words where there are fewer."""
    hashes, _, _, first = words(buf, bounds, SPACE, fold)
    every = grams(hashes, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(grams(hashes[a:b], b - a) if b > a else np.empty(0, U64))
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of a non-empty set: ``size`` values of 32 bits."""
    shift = np.arange(size, dtype=_U32)[:, None]
    least = np.full(size, 0xFFFFFFFF, _U32)
    placed = (mix(shingles) >> U64(32)).astype(_U32)  # the first permutation
    for lo in range(0, len(placed), _AT_ONCE):
        x = placed[None, lo : lo + _AT_ONCE] + shift  # circularly shifted
        x *= _U32(0x9E3779B1)  # the second permutation
        x ^= x >> _U32(15)
        x *= _U32(0x85EBCA77)
        x ^= x >> _U32(13)
        x *= _U32(0xC2B2AE3D)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(sets: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each non-empty set."""
    factors = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
    sigs = np.array([signature(s, rows * bands) for s in sets], _U32).reshape(len(sets), bands, rows)
    return mix((sigs.astype(U64) * factors).sum(axis=2, dtype=U64) + mix(np.arange(bands, dtype=U64)))


def _sign(width: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in blocks(batch.column("text")):
                sets = shingle_sets(buf, bounds, width)
                sizes = np.array([len(s) for s in sets])
                low = np.array([int(s.sum(dtype=U64)) for s in map(mix, sets)], U64)
                high = np.array([int(np.bitwise_xor.reduce(s * U64(0xD6E8FEB86659FD93) ^ (s >> U64(17)))) if len(s) else 0 for s in sets], U64)
                full = np.flatnonzero(sizes)
                keys = band_keys([sets[i] for i in full], rows, bands)
                lengths = np.where(sizes > 0, bands, 0)
                own = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "of")]
                yield pa.RecordBatch.from_arrays([*own, longs(sizes), longs(low), longs(high), lists(keys.ravel(), lengths)], ["doc_id", "of", "n_shingles", "low", "high", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in blocks(batch.column("text")):
                sets = shingle_sets(buf, bounds, width)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), lists(np.concatenate(sets), np.array([len(s) for s in sets]))], ["node", "shingles"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    na, nb = F.size("sa").cast("long"), F.size("sb").cast("long")
    near = pairs.join(left, "a").join(right, "b").where(F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
    return near.where(common * 100 >= (na + nb - common) * percent).select("a", "b")


def _sharpen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sets = [s.values.to_numpy().view(U64) for s in part.column("shingles")]
            keys = band_keys(sets, SHARP_ROWS, SHARP_BANDS)
            yield pa.RecordBatch.from_arrays([part.column("node"), lists(keys.ravel(), np.full(len(sets), SHARP_BANDS))], ["node", "keys"])


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the first set that links of 100 * intersection >= percent * union reach."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # what only one set holds is in no intersection
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[place] > 1
    owner, place = owner[shared], column[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, [lo, lo + step])
        x = np.zeros((len(sets), step), np.float32)
        x[owner[a:b], place[a:b] - lo] = 1
        common += x @ x.T
    common = common.astype(np.int64)
    near = common * 100 >= (sizes[:, None] + sizes[None] - common) * percent
    np.fill_diagonal(near, True)
    label = np.arange(len(sets))
    while True:
        least = np.where(near, label[None], len(sets)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _clustered(sets: DataFrame, labels: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that, with those of the components ``known`` (id, label), join all components within each cluster ``labels`` (id,
    label) of ``sets`` (node, shingles). Clusters and pairs of blocks of one known component have nothing to add."""
    small = labels.select(F.col("id").alias("node"), F.col("label").alias("cluster")).join(known.select(F.col("id").alias("node"), F.col("label").alias("known")), "node", "left")
    small = _store.table(small.withColumn("known", F.coalesce("known", "node")), "clusters")
    open_ = small.groupBy("cluster").agg(F.min("known").alias("x"), F.max("known").alias("y")).where("x < y").select("cluster")
    placed = sets.join(small.join(open_, "cluster"), "node").select("node", "shingles", "cluster", "known")
    blocks_ = F.ceil(F.greatest(F.count("node") / BLOCK_SETS, F.sum(F.size("shingles")) / BLOCK_SHINGLES)).cast("int")
    count = _store.table(placed.groupBy("cluster").agg(blocks_.alias("n")), "blocks")
    mine = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least(k, "mine").alias("x"), F.greatest(k, "mine").alias("y")))
    dealt = placed.join(count, "cluster").withColumn("mine", mine).select("node", "shingles", "cluster", "known", F.explode(meet).alias("m")).select("node", "shingles", "cluster", "known", "m.x", "m.y")

    def run(table: pa.Table) -> pa.Table:
        ids, known_ = table.column("node").to_numpy(), table.column("known").to_numpy()
        if (known_ == known_[0]).all():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        order = np.argsort(ids)
        sets_ = [table.column("shingles")[int(i)].values.to_numpy() for i in order]
        label = linked(sets_, percent)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(ids[order][label[other]]), "b": pa.array(ids[order][other])})

    return dealt.groupBy("cluster", "x", "y").applyInArrow(run, "a long, b long")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, of, text): ``of`` is a hash of the text, which tells rows that share a doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), "text")


def _components(docs: DataFrame, width: int, percent: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """minhash_components() with ``of``, the hash of each row's text.

    A node is a class of rows of equal shingle sets, by the number of one of its rows; its ``rep`` is its smallest doc_id.
    """
    docs = _rows(docs)
    signed = docs.mapInArrow(_sign(width, rows, bands), "doc_id long, of long, n_shingles long, low long, high long, bands array<long>")
    signed = _store.table(signed.withColumn("row", F.monotonically_increasing_id()), "signed")  # numbered once, as written
    whole = ["low", "high", "n_shingles"]
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*whole).agg(F.min("doc_id").alias("rep"), F.min("row").alias("node"), F.count(F.lit(1)).alias("rows"))
    classes = _store.table(classes, "classes")
    banded = signed.select(F.col("row").alias("node"), "bands").join(classes.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("key"))
    banded = _store.table(banded, "bands")
    shared = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("key", "pivot")
    shared = _store.table(shared, "shared")  # a join of two tables can be dealt anew where a key is hot, one of a sum's parts not
    members = _store.table(banded.join(shared, "key").select("node", "key", "pivot"), "buckets")
    meets = members.where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = meets.groupBy("node").agg(F.max_by("pivot", F.struct(F.col("n"), -F.col("pivot"))).alias("a"))
    star = _store.table(best.select("a", F.col("node").alias("b")), "pairs")
    wanted = signed.select(F.col("row").alias("node"), "doc_id", "of").join(members.select("node").distinct(), "node", "left_semi")
    wanted = _store.table(wanted, "wanted")
    some, _ = sifted(docs, wanted, {c: F.col(c) for c in ("doc_id", "of")})
    texts = some.join(wanted, ["doc_id", "of"])  # a node's row, and rows equal to it
    sets = _store.table(texts.select("node", "text").mapInArrow(_sets(width), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")
    links = _store.table(_confirm(star, sets, percent), "confirmed")
    labels = components(links)

    labelled = members.select("node", "key").join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "key", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    open_ = members.select("node", "key").join(_store.table(mixed, "mixed"), "key", "left_semi").select("node").distinct()
    several = _store.table(sets.join(open_, "node", "left_semi"), "several")
    sharp = several.mapInArrow(_sharpen, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    sharp = _store.table(sharp, "sharp")
    heads = sharp.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("key", "pivot")
    held_together = sharp.join(_store.table(heads, "heads"), "key").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    more = _store.table(_clustered(several, components(held_together), labels, percent), "confirmed")
    labels = components(links.union(more))

    # the smallest doc_id of each component, which may have many classes
    linked_ = _store.table(labels.join(classes.select(F.col("node").alias("id"), "rep"), "id"), "linked")
    least = _store.table(linked_.groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("rows")), "least")
    named = matched(linked_, least, "label").select(F.col("id").alias("node"), "component")
    of_class = classes.select(*whole, "node", "rep", "rows").join(named, "node", "left").select(*whole, "rows", F.coalesce("component", "rep").alias("component_id"))
    of_class = _store.table(of_class, "components")
    # a class by one number: 64 bits of its sums, enough as a key if all three are compared as well
    keyed = lambda df: df.withColumn("class", F.xxhash64(*whole))
    mine = keyed(signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "of", *whole))
    sums = keyed(of_class).select("class", F.col("low").alias("l"), F.col("high").alias("h"), F.col("n_shingles").alias("n"), "rows", "component_id")
    found = matched(mine, sums, "class").where("low = l and high = h and n_shingles = n")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "of", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.select("doc_id", "of", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def minhash_components(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id long, text string; more columns are not read).

    Null and empty texts and texts without words have no shingles, link with nothing and are kept. Equal texts are linked
    whatever their length. Every row comes out once, by the links of its own text, also where rows share a doc_id;
    ``component_id`` is the smallest doc_id of the rows that links reach. Rows of null doc_id link with nothing and come out with
    null component_id and kept true. An empty table gives an empty result.
    """
    return _components(docs, width, percent, rows, bands).drop("of")


def without_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that minhash_components() keeps, with all their columns."""
    _id, _of = fresh(docs, "id"), fresh(docs, "of")
    gone = _components(docs, width, percent).where("not kept").select(F.col("doc_id").alias(_id), F.col("of").alias(_of)).distinct()
    gone = _store.table(gone, "gone")  # written, so that the join can be dealt anew where many rows are equal
    some, rest = sifted(docs, gone, {_id: F.col("doc_id").cast("long"), _of: F.xxhash64("text")})
    return some.join(gone, (some["doc_id"].cast("long") == F.col(_id)) & (F.xxhash64(some["text"]) == F.col(_of)), "left_anti").union(rest)
