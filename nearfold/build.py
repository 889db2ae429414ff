"""From a file of track records to the tables of all graphs: ``python -m nearfold.build --data tracks.jsonl.gz --output out``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import components as C
from .operators import features as P
from .operators import graph as G
from .operators import neighbors as K
from .plans.session import cut
from .sources import sinks
from .sources import tracks as S


def build(spark: SparkSession, data: str, output: str, dimensions: int = P.DIMENSIONS, k_min: int = 2, k_max: int = K.K_MAX, save_graphs: bool = False) -> DataFrame:
    """Writes features, nodes, neighbours, the connectivity of every k and, if asked for, the edges of every k, to folders in
    ``output``; each is an error if it exists. Returns the connectivity: (k, edges, n_components, largest_component_size)."""
    if dimensions < 1 or not 1 <= k_min <= k_max:
        raise ValueError("dimensions must be at least 1, and 1 <= k_min <= k_max")
    output = output.rstrip("/")
    records = S.indexed(S.checked_keys(S.read_tracks(spark, data)))
    raw = S.strict(S.extract_features(records)).join(records.select(F.col("node.track_id").alias("track_id"), "node_index"), "track_id")
    x = cut(raw.select(F.col("node_index").alias("node"), "f"))
    K.check_k(k_max, x.count())
    sinks.write_table(raw, f"{output}/raw")
    sinks.write_jsonl(records.select("node_index", "node.*"), f"{output}/nodes")
    reduced = P.fit(x, S.GROUP_BORDERS, dimensions).apply(x)
    sinks.write_table(reduced, f"{output}/features")
    near = cut(K.neighbors(spark.read.parquet(f"{output}/features"), k_max))
    weighted = K.weighted(near, K.bandwidth(near, K.pairs(reduced)) if near.where(f"rank = {K.BANDWIDTH_RANK} and dist > 0").isEmpty() else K.bandwidth(near))
    sinks.write_table(weighted, f"{output}/neighbors")
    births = cut(G.births(near.where(F.col("rank") <= k_max)))
    curve = C.sweep(births, x.select("node"), k_max).join(G.edge_counts(births, k_max), "k").where(F.col("k") >= k_min)
    curve = cut(curve.select("k", "edges", "n_components", "largest_component_size"))
    sinks.write_csv(curve.orderBy("k").coalesce(1), f"{output}/connectivity")
    if save_graphs:
        edges = births.join(G.union_edges(spark.read.parquet(f"{output}/neighbors"), k_max).select("u", "v", "w"), ["u", "v"])
        sinks.write_table(edges, f"{output}/edges")  # the graph of k: birth <= k
    return curve


def main(argv: list[str]) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--dimensions", type=int, default=P.DIMENSIONS)
    parser.add_argument("--k-min", type=int, default=2)
    parser.add_argument("--k-max", type=int, default=K.K_MAX)
    parser.add_argument("--save-graphs", action="store_true", help="also write the edges of all graphs, with the k that they begin at")
    a = parser.parse_args(argv)
    build(SparkSession.builder.appName("nearfold").getOrCreate(), a.data, a.output, a.dimensions, a.k_min, a.k_max, a.save_graphs).orderBy("k").show(100)


if __name__ == "__main__":
    main(sys.argv[1:])
