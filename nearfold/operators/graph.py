"""Union nearest-neighbour graphs. Edges are (u, v, w, dist) with u < v."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_edges(neighbors: DataFrame, k: int) -> DataFrame:
    """An edge where either end is among the k nearest of the other; no self-join."""
    near = neighbors.where(F.col("rank") <= k)
    ends = near.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "w", "dist")
    return ends.groupBy("u", "v").agg(F.max("w").alias("w"), F.min("dist").alias("dist"))


def union_graphs(neighbors: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(u, v, w, graph): union_edges() of each k, put together at once."""
    ends = neighbors.where(F.col("rank") <= max(ks)).select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "rank", "w")
    e = ends.groupBy("u", "v").agg(*(F.max(F.when(F.col("rank") <= k, F.col("w"))).alias(f"w{k}") for k in ks))
    each = F.filter(F.array(*(F.struct(F.col(f"w{k}").alias("w"), F.lit(k).alias("graph")) for k in ks)), lambda x: x["w"].isNotNull())
    return e.select("u", "v", F.inline(each))


def births(neighbors: DataFrame) -> DataFrame:
    """(u, v, birth): the smallest k whose graph has the edge. The graphs are nested, so this is all of them at once."""
    return neighbors.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "rank").groupBy("u", "v").agg(F.min("rank").alias("birth"))


def edge_counts(births: DataFrame, k_max: int) -> DataFrame:
    """(k, edges) for k = 1..k_max."""
    per = births.groupBy("birth").agg(F.count(F.lit(1)).alias("n"))
    ks = per.sparkSession.range(1, k_max + 1).select(F.col("id").cast("int").alias("k"))
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return ks.join(per, F.col("k") == F.col("birth"), "left").select("k", running.alias("edges"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w): both directions."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").unionAll(edges.select("v", "u", "w"))


def binary(edges: DataFrame) -> DataFrame:
    """The topology: stored zeros go, weights are 1."""
    return edges.where("w <> 0").withColumn("w", F.lit(1.0))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength) of the nodes with edges."""
    return adjacency(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between nodes of ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi").select(edges.columns)


def laplacian(edges: DataFrame) -> DataFrame:
    """(row, col, value) of D - A."""
    off = adjacency(edges).select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.col("w")).alias("value"))
    return off.unionAll(degrees(edges).select("node", F.col("node"), "strength"))


def normalized_laplacian(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row, col, value) of I - D^-1/2 A D^-1/2 with weighted degrees; 0 on the diagonal of nodes without edges."""
    d = degrees(edges).select("node", "strength")
    off = adjacency(edges).join(d.select(F.col("node").alias("src"), F.col("strength").alias("s1")), "src").join(d.select(F.col("node").alias("dst"), F.col("strength").alias("s2")), "dst")
    off = off.select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.col("w") / F.sqrt(F.col("s1") * F.col("s2"))).alias("value"))
    own = nodes.select("node").join(d, "node", "left").select(F.col("node").alias("row"), F.col("node").alias("col"), F.when(F.col("strength") > 0, 1.0).otherwise(0.0).alias("value"))
    return off.unionAll(own)


def nullspace_residual(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rows, largest): of the normalised Laplacian times the roots of the strengths, which is 0."""
    d = degrees(edges).select(F.col("node").alias("col"), F.sqrt("strength").alias("root"))
    sums = normalized_laplacian(edges, nodes).join(d, "col", "left").groupBy("row").agg(F.sum(F.col("value") * F.coalesce("root", F.lit(0.0))).alias("s"))
    return sums.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs("s")).alias("largest"))


def invariants(edges: DataFrame) -> DataFrame:
    """One row of counts, all 0 in a sound graph."""
    sound = (F.col("w") > 0) & (F.abs("w") < float("inf"))
    twice = edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return edges.agg(F.count_if(F.col("u") == F.col("v")).alias("loops"), F.count_if(F.col("u") > F.col("v")).alias("unordered"), F.count_if(~sound).alias("unsound")).crossJoin(twice)  # one row and one row


def topology_difference(edges: DataFrame, neighbors: DataFrame, k: int) -> DataFrame:
    """(missing, extra) edges of ``edges`` against the union of the first k neighbours."""
    want = births(neighbors).where(F.col("birth") <= k).select("u", "v")
    have = edges.select("u", "v")
    return want.exceptAll(have).agg(F.count(F.lit(1)).alias("missing")).crossJoin(have.exceptAll(want).agg(F.count(F.lit(1)).alias("extra")))


def export(edges: DataFrame) -> DataFrame:
    """(source, target, weight, distance) with source < target."""
    return edges.select(F.col("u").alias("source"), F.col("v").alias("target"), F.col("w").alias("weight"), F.col("dist").alias("distance"))


def fingerprint(edges: DataFrame) -> DataFrame:
    """A checksum of the topology that does not hang on row order: sums of a hash of each edge, hashed."""
    edge = F.sha2(F.concat_ws("-", "u", "v"), 256)
    parts = [F.sum(F.conv(F.substring(edge, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.sha2(F.concat_ws("-", *(p.cast("string") for p in parts)), 256).alias("sha256"))
