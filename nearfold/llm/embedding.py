"""Near-duplicate vectors by randomised binary codes.

A vector is normalised, turned by random rotations and kept as signs, with the factor <sign code / sqrt(D), turned vector>
that corrects the estimate of an inner product (RaBitQ, Gao & Long). Of two vectors x, y with codes of N bits in all, the
estimate from the code of x and the exact turned y is unbiased, with an error of about sqrt((1 - f**2) / f**2 / N); bounds on
either side of it decide which pairs are computed exactly.

Pairs are looked for within buckets of equal label and equal bits in some table, not among all pairs: vectors at cosine 0.98
differ in a bit with probability acos(0.98) / pi = 0.064, and so share one of TABLES tables of BITS bits but with
probability (1 - 0.936**BITS)**TABLES. Every bit of every table is the sign along a Gaussian direction of its own, not one of
the code's: tables that share bits fail together. A pair counts in the first table that holds it. Equal vectors form one class
first, so that copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._links import components, matched

ROTATIONS = 4
#: Bits of a table at least, chance to miss a pair at the threshold, standard errors of a bound.
LEAST_BITS, MISS, ERRORS = 4, 1e-6, 6.0
#: Vectors of a block; buckets above that are held block against block.
BLOCK = 1_024
PER_BUCKET = 256


def rotations(dim: int, count: int = ROTATIONS) -> np.ndarray:
    r = np.random.default_rng(7)
    return np.stack([np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(count)])


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as bool (n, count * dim), correction factor (n)) of unit vectors."""
    turned = np.einsum("nd,kde->nke", unit, turn)
    factor = np.abs(turned).mean(axis=(1, 2)) * sqrt(unit.shape[1])
    return turned.reshape(len(unit), -1) > 0, factor


def table_planes(rows: int, dim: int, threshold: float) -> np.ndarray:
    """Directions (table, dim, bit): enough bits that random vectors fill buckets of about PER_BUCKET, and enough tables."""
    width = max(LEAST_BITS, ceil(log2(max(2, rows) / PER_BUCKET)))
    same = (1 - acos(threshold) / pi) ** width
    count = ceil(np.log(MISS) / np.log(1 - same))
    return np.random.default_rng(13).standard_normal((count, dim, width))


def _keys(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return np.stack([(x @ t > 0) @ (1 << np.arange(t.shape[1], dtype=np.int64)) for t in tables], axis=1)


def near(x: np.ndarray, turn: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of rows of ``x`` (unit vectors) with cosine >= threshold, as a symmetric matrix without its diagonal: those that
    the bounds of the estimate leave open are computed exactly."""
    code, factor = encode(x, turn)
    turned = np.einsum("nd,kde->nke", x, turn).reshape(len(x), -1).astype(np.float32)
    signs = np.where(code, np.float32(1), np.float32(-1))
    # <code, y> / (sqrt(D) N / D) is f <x, y> on average
    estimate = (signs @ turned.T) / (len(turn) * sqrt(x.shape[1])) / factor[:, None]
    error = ERRORS * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / (code.shape[1] - 1))
    open_ = estimate + error[:, None] >= threshold
    out = np.zeros((len(x), len(x)), bool)
    i, j = np.nonzero(np.triu(open_ | open_.T, 1))
    for lo in range(0, len(i), 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        good = np.einsum("nd,nd->n", x[a], x[b]) >= threshold
        out[a[good], b[good]] = out[b[good], a[good]] = True
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def link_embeddings(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id long, embedding array of numbers, label).

    Rows are linked if their labels are equal and not null and their cosine in double precision is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite parts, and rows of null label, have no links and are their own
    component. Vectors of different lengths are not linked. A vec_id that occurs twice counts as two rows that are linked if
    the vectors are. Rows of null vec_id link as others do; they are never the smallest, and are kept only where no row of their
    component has an id (component_id is then null). An empty table gives an empty result; other columns are not read.
    """
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    named = named.withColumn("sound", F.coalesce(F.col("label").isNotNull() & sound, F.lit(False)))
    classes = named.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # classes go by a number of their own, as written: their smallest vec_id may be null, or that of another class
    classes = _store.table(classes.withColumn("dim", F.size("v")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    links, counts = None, None
    dims = [r["dim"] for r in classes.select("dim").distinct().collect()]
    for dim in dims:
        a, b = _linked(classes.where(F.col("dim") == dim), dim, threshold)
        links, counts = (a, b) if links is None else (links.union(a), counts.union(b))
    found = classes.select("label", "v", "id", "rep", "copies")
    if links is not None:
        linked = _store.table(components(links).join(classes.select("id", "rep"), "id"), "linked")
        least = _store.table(linked.groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("rows")), "least")
        labels = matched(linked, least, "label").select("id", "component")
        total = counts.groupBy("id").agg(F.sum("n").alias("n"))
        found = found.join(labels, "id", "left").join(total, "id", "left")
    else:
        found = found.withColumn("component", F.lit(None).cast("long")).withColumn("n", F.lit(0).cast("long"))
    n_links = F.col("copies") - 1 + F.coalesce("n", F.lit(0))
    # all that is known of a class, once for each, before its rows are met: a join of a table can be dealt anew where a class is hot
    found = _store.table(found.select("label", "v", n_links.alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "found")
    held = named.where("sound").join(found, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = named.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return held.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(classes: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) that join all components, counts (id, n) to be summed) of classes of vectors of ``dim`` parts."""
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    turn = rotations(dim)
    tables = table_planes(most, dim, threshold)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(unit(_matrix(pa.chunked_array([batch.column("v")]), dim)), tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * len(tables)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["label", "id", "keys"])

    label = dict(classes.dtypes)["label"]
    coded = classes.select("label", "id", "v").mapInArrow(code, f"label {label}, id long, keys array<long>")
    spread = coded.select("label", "id", F.posexplode("keys").alias("t", "key"))
    size = _store.table(spread.groupBy("label", "t", "key").agg(F.count("id").alias("size")).where("size > 1"), "buckets")
    spread = spread.join(size.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), ["label", "t", "key"])
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "mine").alias("x"), F.greatest(k, "mine").alias("y")))
    dealt = spread.withColumn("mine", mine).select("label", "t", "key", "id", "mine", "blocks", F.explode(meet).alias("m"))
    dealt = dealt.select("label", "t", "key", "id", "mine", "m.x", "m.y").join(classes.select("id", "v", "copies"), "id")

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy())
        ids, copies, side = (table.column(c).to_numpy()[order] for c in ("id", "copies", "mine"))
        t = table.column("t")[0].as_py()
        x = unit(_matrix(table.column("v"), dim)[order])
        close = near(x, turn, threshold)
        if table.column("x")[0].as_py() != table.column("y")[0].as_py():  # pairs within a block belong to another group
            close &= side[:, None] != side[None]
        if t:
            earlier = _keys(x, tables[:t])
            i, j = np.nonzero(np.triu(close, 1))
            seen = (earlier[i] == earlier[j]).any(axis=1)
            close[i[seen], j[seen]] = close[j[seen], i[seen]] = False
        n = close @ copies
        some = np.flatnonzero(n > 0)
        tree = _forest(close)
        child = np.flatnonzero(tree != np.arange(len(tree)))
        return pa.table({"id": pa.array(np.concatenate([ids[some], ids[child]])), "n": pa.array(np.concatenate([n[some], np.zeros(len(child), np.int64)])), "to": pa.array(np.concatenate([ids[some], ids[tree[child]]]))})

    found = _store.table(dealt.groupBy("label", "t", "key", "x", "y").applyInArrow(run, "id long, n long, to long"), "near")
    return found.where("id <> to").select(F.col("to").alias("a"), F.col("id").alias("b")), found.where("n > 0").select("id", "n")


def _forest(close: np.ndarray) -> np.ndarray:
    """For each row the first row that links reach."""
    label = np.arange(len(close))
    both = close | np.eye(len(close), dtype=bool)
    while True:
        least = np.where(both, label[None], len(close)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least
