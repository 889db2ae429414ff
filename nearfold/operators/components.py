"""Connected components, their ranks, and connectivity for every k at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut, written

#: Edges up to which one task joins them all; above, rounds over the whole table.
ONE_TASK = 2_000_000
#: Share of the edges that spanning forests have to leave at most, for another round of them.
LEAST_LOSS = 0.8


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of 0..n-1 reaches: minima over edges and jumps to the label's label, on whole arrays."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def components(edges: DataFrame, nodes: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, label): label is the smallest node of the component; nodes without edges are their own."""
    few = edges.limit(one_task + 1).count() <= one_task
    found = _joined(edges) if few else _rounds(edges)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _joined(edges: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        return pa.table({"node": ids, "label": ids[_roots(place[: len(u)], place[len(u) :], len(ids))]})

    return edges.select("u", "v", F.lit(0).alias("all")).groupBy("all").applyInArrow(lambda t: run(t), "node long, label long")


def _rounds(edges: DataFrame) -> DataFrame:
    """Each round maps a node to its smallest neighbour, or that one's, and replaces edges by edges between what their ends map
    to, until none is left."""
    left = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while True:
        both = left.select(F.col("u").alias("node"), "v").union(left.select("v", "u"))
        near = cut(both.groupBy("node").agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
        far = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = cut(near.join(far, "label").select("node", F.col("far").alias("label")))
        rounds.append(labels)
        u, v = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "uv")
        ends = left.join(u, "u").join(v, "v").where("lu <> lv")
        left = cut(ends.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct())
        if left.isEmpty():
            break
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
        found = rounds.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return cut(found)


def sizes(labels: DataFrame) -> DataFrame:
    """(label, size)."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def ranking(labels: DataFrame) -> DataFrame:
    """(label, size, component_rank) from 1: by size downwards, then by smallest member."""
    return sizes(labels).withColumn("component_rank", F.row_number().over(Window.orderBy(F.desc("size"), "label")))


def ranked_nodes(labels: DataFrame) -> DataFrame:
    return labels.join(ranking(labels), "label").select("node", "label", "component_rank")


def summary(labels: DataFrame) -> DataFrame:
    """(n_nodes, n_components, largest_component_size, largest_component_fraction)."""
    s = sizes(labels).agg(F.sum("size").alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest_component_size"))
    return s.withColumn("largest_component_fraction", F.col("largest_component_size") / F.col("n_nodes"))


def _forest(a: np.ndarray, b: np.ndarray, birth: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a spanning forest of 0..n-1 with the earliest births: whatever the k, the edges born until then have the
    components that all edges born until then have. Each part takes its first edge to another, until there is none."""
    order = np.argsort(birth, kind="stable")
    a, b, label, left, taken = a[order], b[order], np.arange(n), np.arange(len(order)), [np.empty(0, np.int64)]
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return order[np.concatenate(taken)]
        least = np.full(n, len(order))
        np.minimum.at(least, label[a[left]], left)
        np.minimum.at(least, label[b[left]], left)
        taken.append(np.unique(least[least < len(order)]))
        label = _roots(label[a[taken[-1]]], label[b[taken[-1]]], n)[label]


def _forests(births: DataFrame, parts: int) -> DataFrame:
    """The edges of a spanning forest of each of ``parts`` parts of the edges; those left out change no component of any k."""

    def run(table: pa.Table) -> pa.Table:
        u, v, birth = (table.column(c).to_numpy() for c in ("u", "v", "birth"))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        keep = _forest(place[: len(u)], place[len(u) :], birth, len(ids))
        return pa.table({"u": u[keep], "v": v[keep], "birth": pa.array(birth[keep], pa.int32())})

    part = F.pmod(F.xxhash64("u", "v"), F.lit(parts)).alias("part")
    return births.select("u", "v", F.col("birth").cast("int").alias("birth"), part).groupBy("part").applyInArrow(run, "u long, v long, birth int")


def sweep(births: DataFrame, nodes: DataFrame, k_max: int, one_task: int = ONE_TASK) -> DataFrame:
    """(k, n_components, largest_component_size) for k = 1..k_max. Each round joins the labels of k - 1 by the edges born at k.

    More edges than a task takes are first replaced by spanning forests of parts of them; only if those are too many as well, as
    there are so many nodes, rounds go over the whole table."""
    n, left = nodes.count(), births.count()
    while left > one_task:
        births = written(_forests(births, max(2, 4 * left // max(1, one_task))))
        before, left = left, births.count()
        if left > one_task and left > LEAST_LOSS * before:
            return _sweep_rounds(births, nodes, k_max)

    def run(table: pa.Table) -> pa.Table:
        u, v, birth = (table.column(c).to_numpy() for c in ("u", "v", "birth"))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, label, out = place[: len(u)], place[len(u) :], np.arange(len(ids)), []
        for k in range(1, k_max + 1):
            new = birth == k
            label = _roots(label[a[new]], label[b[new]], len(ids))[label]
            count = np.bincount(label)
            out.append((k, int((count > 0).sum()) + n - len(ids), int(max(count.max(), 1))))
        k, c, m = zip(*out)
        return pa.table({"k": pa.array(k, pa.int32()), "n_components": pa.array(c, pa.int64()), "largest_component_size": pa.array(m, pa.int64())})

    return births.select("u", "v", "birth", F.lit(0).alias("all")).groupBy("all").applyInArrow(lambda t: run(t), "k int, n_components long, largest_component_size long")


def _sweep_rounds(births: DataFrame, nodes: DataFrame, k_max: int) -> DataFrame:
    """sweep() for any number of edges: the labels of k - 1, joined by the edges of birth k between them."""
    labels, rows, last = cut(nodes.select("node", F.col("node").alias("label"))), [], None
    for k in range(1, k_max + 1):
        u, v = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "uv")
        new = births.where(F.col("birth") == k).join(u, "u").join(v, "v").where("lu <> lv")
        new = cut(new.select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct())
        if last is None or not new.isEmpty():
            joined = _rounds(new).select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = cut(labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
            last = summary(labels).select("n_components", "largest_component_size").first()
        rows.append((k, *last))
    return nodes.sparkSession.createDataFrame(rows, "k int, n_components long, largest_component_size long")


def threshold(sweep: DataFrame) -> DataFrame:
    """(k_c): the smallest k with one component, null if there is none."""
    return sweep.agg(F.min(F.when(F.col("n_components") == 1, F.col("k"))).alias("k_c"))


def same_partition(a: DataFrame, b: DataFrame) -> DataFrame:
    """(split, merged): groups of ``a`` that fall into several of ``b``, and the reverse; both 0 for equal partitions."""
    both = a.select("node", F.col("label").alias("x")).join(b.select("node", F.col("label").alias("y")), "node")
    split = both.groupBy("x").agg(F.count_distinct("y").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split"))
    return split.crossJoin(both.groupBy("y").agg(F.count_distinct("x").alias("n")).agg(F.count_if(F.col("n") > 1).alias("merged")))


def parts_within(edges: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., parts): components that the edges (by..., u, v) within a group, which are one task, leave of its nodes (by..., size)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        roots = len(np.unique(_roots(place[: len(u)], place[len(u) :], len(ids))))
        return pa.table({c: pa.array([x.as_py()], table.schema.field(c).type) for c, x in zip(by, key)} | {"less": [len(ids) - roots]})

    kinds = dict(edges.dtypes)
    joined = edges.groupBy(*by).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", less long")
    return sizes.join(joined, by, "left").select(*by, (F.col("size") - F.coalesce("less", F.lit(0))).alias("parts"))


def group_connectivity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, parts): components of the graph that each group induces."""
    u, v = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "uv")
    within = edges.join(u, "u").join(v, "v").where("lu = lv").select("u", "v")
    return components(within, labels).withColumnRenamed("label", "part").join(labels, "node").groupBy("label").agg(F.count_distinct("part").alias("parts"))
