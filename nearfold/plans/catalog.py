"""Queries over the test tables, one or more for each operator, and SQL that gives the same rows.

Vectors of ``embeddings`` are nodes and features; ``part`` (by p_partkey = vec_id) gives tags (the words of p_name), the artist
(p_brand), bpm (p_size) and onset rate (p_retailprice); ``labels`` a second, partial family of tags. Fractions are rounded to
six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import features as P
from ..operators import graph as G
from ..operators import leiden as M
from ..operators import neighbors as K
from ..operators import partition as I
from ..operators import spectral as L
from ..operators import structure as D
from ..sources import sinks
from ..sources import tracks as S
from .oracles import sql
from .session import cut, folder, shared, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Borders of unequal groups of 64 features.
BORDERS = [17, 62]


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"))


def given(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").cast("long").alias("label"))


def halves(spark: SparkSession, sf: str) -> DataFrame:
    """A second partition of the nodes: 1 or 2 by the sign of the first feature."""
    return features(spark, sf).select("node", F.when(F.get("f", F.lit(0)) < 0, 1).otherwise(2).cast("long").alias("label"))


def near(spark: SparkSession, sf: str, k: int = K.K_MAX) -> DataFrame:
    """The nearest max(k, 10) of every node, from one table for all queries of a session on the same files."""
    x = features(spark, sf)
    n = x.count()
    K.check_k(k, n)
    full = shared(spark, f"{sf}/embeddings.parquet", "near", lambda: K.neighbors(x, min(K.K_MAX, n - 1)))
    return full.where(F.col("rank") <= max(k, K.BANDWIDTH_RANK))


def weighted(spark: SparkSession, sf: str, k: int = K.K_MAX) -> DataFrame:
    found = near(spark, sf, k)
    return K.weighted(found, K.bandwidth(found))


def edges(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return cut(G.union_edges(weighted(spark, sf, max(k, K.BANDWIDTH_RANK)), k))


def tags(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.split("p_name", " ").alias("tags"))
    return nodes(spark, sf).join(part, "node", "left").select("node", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def flags(spark: SparkSession, sf: str) -> DataFrame:
    named = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    t = table(spark, sf, "labels").select(F.col("doc_id").alias("node"), named.alias("tags"))
    return nodes(spark, sf).join(t, "node", "left").select("node", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def artists(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("artist")), "node")


def rhythm(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("bpm"), F.col("p_retailprice").alias("onset_rate")), "node")


def shown(df: DataFrame, places: int = 6) -> DataFrame:
    """Fractions rounded, whole numbers long."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c, places) + 0.0).alias(name) if kind == "double" else c.cast("long").alias(name) if kind in ("int", "smallint", "tinyint", "bigint") else c)
    return df.select(*out)


# --- records ---

_RECORDS = """
select named_struct(
    'node', named_struct('track_id', concat('t', lpad(cast(p_partkey as string), greatest(6, length(cast(p_partkey as string))), '0')), 'artist_id', p_brand, 'genre', split(p_name, ' '), 'mood/theme', array(p_type), 'instrument', cast(array() as array<string>)) as node,
    named_struct(
      'lowlevel', named_struct('mfcc', named_struct(
        'mean', transform(sequence(0, 12), i -> cast(p_size + i as double)),
        'cov', transform(sequence(0, 12), i -> transform(sequence(0, 12), j -> case when i = j then case when i = p_size % 13 then -1e-12D else cast(i * i as double) end else 0D end)))),
      'tonal', named_struct('hpcp', named_struct('mean', transform(sequence(0, 35), i -> cast(i as double) / 4), 'var', transform(sequence(0, 35), i -> cast(i as double)))),
      'rhythm', named_struct('bpm', cast(p_size as double), 'onset_rate', case when p_partkey % 7 = 0 then cast('NaN' as double) else p_retailprice end)) as acoustic
"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Track records made of ``part``; every seventh is bad, most have a small negative variance."""
    expr = _RECORDS.replace("select named_struct(\n    'node', ", "").rsplit(" as acoustic", 1)[0]
    node, acoustic = expr.split(" as node,", 1)
    return table(spark, sf, "part").select(F.expr(node).alias("node"), F.expr(acoustic).alias("acoustic"))


def shown_id() -> Column:
    """A track_id as SQL writes it: its lpad cuts keys of a million and more to six digits, so only the records' own ids are unique."""
    return F.substring("track_id", 1, 7).alias("track_id")


def shown_error() -> Column:
    return F.concat(F.substring("track_id", 1, 7), F.expr("substring(error, length(track_id) + 1)")).alias("error")


@query("tracks_json_features", "tracks_json_features")
def _(spark, sf):
    e = S.extract_features(S.checked_keys(records(spark, sf)))
    total = F.aggregate("f", F.lit(0.0), lambda s, x: s + x)
    return shown(e.select(shown_id(), F.coalesce("clipped", F.lit(-1)).alias("clipped"), shown_error(), F.when(F.col("f").isNull(), 0).otherwise(F.size("f")).alias("n"), total.alias("total"), F.get("f", F.lit(14)).alias("std_01")))


@query("tracks_negative_variance", "tracks_negative_variance")
def _(spark, sf):
    """Records whose covariances are large beside a variance of -1e-9: rounding is told by the variances alone, so with small ones
    it is an error, and with large ones it is clipped."""
    by = lambda i, j: F.when(F.lit(i) == F.lit(j), F.lit(-1e-9) if i == 0 else F.when(F.col("p_size") > 25, 1000.0).otherwise(1.0)).otherwise(1000.0)
    cov = F.array(*(F.array(*(by(i, j) for j in range(13))) for i in range(13)))
    r = records(spark, sf)
    size = F.col("acoustic.rhythm.bpm").alias("p_size")
    r = r.select("node", "acoustic", size).withColumn("acoustic", F.col("acoustic").withField("lowlevel.mfcc.cov", cov))
    return S.extract_features(r.drop("p_size")).select(shown_id(), F.coalesce("clipped", F.lit(-1)).cast("long").alias("clipped"), shown_error())


@query("tracks_dense_index", "tracks_dense_index")
def _(spark, sf):
    """In the order of the ids as SQL writes them; of records that it writes alike, in that of their keys as numbers, as DuckDB on
    one thread gives them from a table in that order."""
    key = F.substring("node.track_id", 2, 20).cast("long")
    placed = S.indexed(S.checked_keys(records(spark, sf).select("node")), F.substring("node.track_id", 1, 7), key).withColumn("track_id", F.col("node.track_id"))
    return placed.select(shown_id(), "node_index", F.array_join("node.genre", "|").alias("genre"))


# --- features ---


@query("feature_stats", "feature_stats")
def _(spark, sf):
    return shown(P.feature_stats(features(spark, sf)))


@query("constant_columns", "constant_columns")
def _(spark, sf):
    wide = features(spark, sf).select("node", F.concat("f", F.array(F.lit(3.0), F.lit(0.0))).alias("f"))
    return P.kept_columns(P.feature_stats(wide)).where("not kept").select(F.col("feature").cast("long").alias("feature"))


@query("group_weights", "group_weights")
def _(spark, sf):
    return shown(P.group_weights(P.feature_stats(features(spark, sf)), BORDERS).select("feature", "grp", "weight"))


@query("weighted_zscore", "weighted_zscore")
def _(spark, sf):
    x = features(spark, sf)
    return shown(P.weighted_zscore(x, P.group_weights(P.feature_stats(x), BORDERS)))


@query("distinct_vectors", "distinct_vectors")
def _(spark, sf):
    return P.distinct_vectors(features(spark, sf))


@query("pca_explained_variance")
def _(spark, sf):
    m = P.fit(features(spark, sf), BORDERS)
    rows = [(k + 1, float(x)) for k, x in enumerate(m.variance_ratio)]
    return P.explained_variance(spark.createDataFrame(rows, "component int, explained_variance_ratio double"), len(m.components))


@query("pca_project")
def _(spark, sf):
    x = features(spark, sf)
    return P.fit(x, BORDERS).apply(x)


# --- neighbours ---


@query("knn_neighbors_k10", "knn_neighbors_k10")
def _(spark, sf):
    return shown(near(spark, sf, 10))


@query("knn_bandwidth", "knn_bandwidth")
def _(spark, sf):
    return shown(K.bandwidth(near(spark, sf, 10)))


@query("bandwidth_fallback_given", "bandwidth_fallback_given")
def _(spark, sf):
    """Most tenth distances 0: the median of the positive ones. Distances by supplier, in place of neighbours."""
    d = F.when(F.col("s_suppkey") % 3 == 0, F.abs("s_acctbal")).otherwise(0.0)
    return shown(K.bandwidth(table(spark, sf, "supplier").select(F.lit(K.BANDWIDTH_RANK).alias("rank"), d.alias("dist"))))


@query("knn_gaussian_weights", "knn_gaussian_weights")
def _(spark, sf):
    return shown(weighted(spark, sf, 10).select("i", "j", "w"))


@query("pair_quantiles", "pair_quantiles")
def _(spark, sf):
    return shown(K.pair_quantiles(features(spark, sf)))


@query("similarity_quantiles", "similarity_quantiles")
def _(spark, sf):
    return shown(K.pair_quantiles(features(spark, sf), K.bandwidth(near(spark, sf, 10)).first()["sigma"]))


# --- graphs ---


@query("union_knn_edges_k3", "union_knn_edges_k3")
def _(spark, sf):
    return shown(edges(spark, sf, 3))


@query("edge_export_k3", "edge_export_k3")
def _(spark, sf):
    return shown(G.export(edges(spark, sf, 3)))


@query("edge_fingerprint_k3", "edge_fingerprint_k3")
def _(spark, sf):
    return G.fingerprint(edges(spark, sf, 3))


@query("edge_count_by_k", "edge_count_by_k")
def _(spark, sf):
    return shown(G.edge_counts(G.births(near(spark, sf)), 64))


@query("graph_invariants", "graph_invariants")
def _(spark, sf):
    return G.invariants(edges(spark, sf, 3))


@query("topology_check", "topology_check")
def _(spark, sf):
    w = cut(weighted(spark, sf, 10))
    return G.topology_difference(G.binary(G.union_edges(w, 3)), w, 3)


@query("degree_strength", "degree_strength")
def _(spark, sf):
    return shown(G.degrees(edges(spark, sf, 3)))


@query("laplacian_entries", "laplacian_entries")
def _(spark, sf):
    return shown(G.laplacian(edges(spark, sf, 3)))


@query("normalized_laplacian_entries", "normalized_laplacian_entries")
def _(spark, sf):
    return shown(G.normalized_laplacian(edges(spark, sf, 3), nodes(spark, sf)))


@query("laplacian_nullspace_check", "laplacian_nullspace_check")
def _(spark, sf):
    return shown(G.nullspace_residual(edges(spark, sf, 3), nodes(spark, sf)))


# --- connectivity ---


@query("components_k1", "components_k1")
def _(spark, sf):
    return C.components(edges(spark, sf, 1), nodes(spark, sf))


@query("components_rounds_k1", "components_k1")
def _(spark, sf):
    return C.components(edges(spark, sf, 1), nodes(spark, sf), one_task=0)


@query("component_sizes", "component_sizes")
def _(spark, sf):
    return shown(C.summary(C.components(edges(spark, sf, 1), nodes(spark, sf))))


@query("component_ranking", "component_ranking")
def _(spark, sf):
    return shown(C.ranking(C.components(edges(spark, sf, 1), nodes(spark, sf))))


@query("component_equivalence", "component_equivalence")
def _(spark, sf):
    e, n = edges(spark, sf, 1), nodes(spark, sf)
    return C.same_partition(C.components(e, n), C.components(e, n, one_task=0))


@query("group_connectivity", "group_connectivity")
def _(spark, sf):
    return C.group_connectivity(edges(spark, sf, 3), given(spark, sf))


@query("connectivity_sweep", "connectivity_sweep")
def _(spark, sf):
    return shown(C.sweep(G.births(near(spark, sf, 10)), nodes(spark, sf), 4))


@query("connectivity_sweep_k64", "connectivity_sweep_k64")
def _(spark, sf):
    return shown(C.sweep(G.births(near(spark, sf)), nodes(spark, sf), 64))


@query("connectivity_threshold", "connectivity_threshold")
def _(spark, sf):
    most = min(K.K_MAX, nodes(spark, sf).count() - 1)
    return shown(C.threshold(C.sweep(G.births(near(spark, sf, most)), nodes(spark, sf), most)))


@query("induced_largest_component", "induced_largest_component")
def _(spark, sf):
    e = edges(spark, sf, 1)
    largest = C.ranked_nodes(C.components(e, nodes(spark, sf))).where("component_rank = 1")
    return shown(G.induced(e, largest))


# --- structure ---


def metrics(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return D.node_metrics(edges(spark, sf, k), nodes(spark, sf))


@query("triangles_per_node", "triangles_per_node")
def _(spark, sf):
    return metrics(spark, sf).select("node", "triangles")


@query("clustering_coefficients", "clustering_coefficients")
def _(spark, sf):
    return shown(metrics(spark, sf).select("node", "clustering", D.fraction_text(F.col("num"), F.col("den")).alias("exact_fraction")))


@query("clustering_exact_pmf", "clustering_exact_pmf")
def _(spark, sf):
    return shown(D.clustering_pmf(metrics(spark, sf)))


@query("clustering_histogram", "clustering_histogram")
def _(spark, sf):
    return shown(D.clustering_histogram(metrics(spark, sf)))


@query("degree_pmf_dense", "degree_pmf_dense")
def _(spark, sf):
    return shown(D.degree_pmf(metrics(spark, sf, 3)))


@query("degree_distribution", "degree_distribution")
def _(spark, sf):
    return shown(D.degree_distribution(metrics(spark, sf, 3)))


@query("degree_summary", "degree_summary")
def _(spark, sf):
    return shown(D.summary(metrics(spark, sf)))


@query("transitivity", "transitivity")
def _(spark, sf):
    return shown(D.summary(metrics(spark, sf)).select("triangle_count", "transitivity"))


@query("structure_checks", "structure_checks")
def _(spark, sf):
    e = edges(spark, sf, 10)
    return D.checks(D.node_metrics(e, nodes(spark, sf)), e)


@query("node_metrics", "node_metrics")
def _(spark, sf):
    return shown(metrics(spark, sf).select("node", "degree", "strength", "triangles", "clustering"))


@query("copurchase_components_whole", "copurchase_components_whole")
def _(spark, sf):
    """Parts and suppliers joined by lines of orders: a larger graph of other data."""
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 10_000_000).alias("v")).distinct()
    ends = line.select(F.col("u").alias("node")).union(line.select("v")).distinct()
    return shown(C.summary(C.components(line, ends)))


# --- partitions ---


@query("domain_feature_means", "domain_feature_means")
def _(spark, sf):
    return shown(I.feature_means(features(spark, sf), given(spark, sf)).select("label", "feature", "raw_mean", "raw_std"))


@query("domain_zscores", "domain_zscores")
def _(spark, sf):
    return shown(I.feature_means(features(spark, sf), given(spark, sf)).select("label", "feature", "zscore_mean"))


@query("eta_squared", "eta_squared")
def _(spark, sf):
    return shown(I.eta_squared(features(spark, sf), given(spark, sf)))


@query("eta_squared_top10", "eta_squared_top10")
def _(spark, sf):
    return shown(I.ranked(I.eta_squared(features(spark, sf), given(spark, sf))))


@query("tag_prevalence", "tag_prevalence")
def _(spark, sf):
    return shown(I.tag_prevalence(tags(spark, sf), given(spark, sf)).drop("whole_hits"))


@query("tag_differences_topk", "tag_differences_topk")
def _(spark, sf):
    return shown(I.largest_differences(I.tag_prevalence(tags(spark, sf), given(spark, sf))).select("label", "tag", "difference"))


@query("tag_enrichment_lift", "tag_enrichment_lift")
def _(spark, sf):
    return shown(I.tag_enrichment(flags(spark, sf), given(spark, sf)))


@query("display_tags", "display_tags")
def _(spark, sf):
    return shown(I.display_tags(I.tag_universe(tags(spark, sf), given(spark, sf))))


@query("artist_concentration", "artist_concentration")
def _(spark, sf):
    top = F.array_join(F.transform("top", lambda s: F.concat_ws(":", s["artist"], s["count"])), ",")
    return shown(I.artist_concentration(artists(spark, sf), given(spark, sf)).withColumn("top", top))


@query("rhythm_summary", "rhythm_summary")
def _(spark, sf):
    return shown(I.rhythm_summary(rhythm(spark, sf), given(spark, sf)))


@query("tag_state", "tag_state")
def _(spark, sf):
    return flags(spark, sf).select("node", I.tag_state(F.col("tags"), "toxic").cast("long").alias("state"))


@query("tag_one_hot", "tag_one_hot")
def _(spark, sf):
    return I.one_hot(flags(spark, sf), ["quality", "toxic"])


@query("label_coverage", "label_coverage")
def _(spark, sf):
    return I.label_coverage(flags(spark, sf))


@query("distinct_artists", "distinct_artists")
def _(spark, sf):
    return artists(spark, sf).agg(F.count_distinct("artist").alias("artists"))


@query("normalized_cut", "normalized_cut")
def _(spark, sf):
    return shown(L.cut_metrics(edges(spark, sf, 3), halves(spark, sf).withColumnRenamed("label", "domain")))


@query("modularity", "modularity")
def _(spark, sf):
    return shown(I.modularity(I.community_table(edges(spark, sf, 3), given(spark, sf))))


@query("community_table", "community_table")
def _(spark, sf):
    return shown(I.community_table(edges(spark, sf, 3), given(spark, sf)))


@query("community_profile", "community_profile")
def _(spark, sf):
    return shown(I.community_profile(edges(spark, sf, 3), given(spark, sf), artists(spark, sf), halves(spark, sf).withColumnRenamed("label", "domain")))


@query("community_volume_check", "community_volume_check")
def _(spark, sf):
    return shown(I.volume_check(edges(spark, sf, 3), given(spark, sf)))


@query("community_ids", "community_ids")
def _(spark, sf):
    return shown(I.canonical(given(spark, sf)))


@query("community_overlap", "community_overlap")
def _(spark, sf):
    return shown(I.overlap(given(spark, sf), halves(spark, sf)))


@query("edge_label_agreement", "edge_label_agreement")
def _(spark, sf):
    return shown(I.label_agreement(edges(spark, sf, 3), given(spark, sf), tags(spark, sf)))


@query("cross_community_fractions", "cross_community_fractions")
def _(spark, sf):
    return shown(I.cross_fractions(edges(spark, sf, 3), given(spark, sf)))


@query("community_sizes", "community_sizes")
def _(spark, sf):
    return shown(I.size_summary(given(spark, sf)).withColumn("largest", F.array_join(F.transform("largest", lambda x: x.cast("string")), ",")))


@query("adjusted_rand", "adjusted_rand")
def _(spark, sf):
    return shown(I.adjusted_rand(I.contingency(given(spark, sf), halves(spark, sf))))


@query("nmi", "nmi")
def _(spark, sf):
    return shown(I.nmi(I.contingency(given(spark, sf), halves(spark, sf))))


@query("partition_agreement", "partition_agreement")
def _(spark, sf):
    value = rhythm(spark, sf).select("node", F.col("onset_rate").alias("value"))
    other = given(spark, sf).select("node", (F.col("label") % 2 + 1).alias("label"))
    return shown(I.agreement(I.low_high(halves(spark, sf), value), I.low_high(other, value)))


@query("node_assignment", "node_assignment")
def _(spark, sf):
    n = artists(spark, sf).join(tags(spark, sf), "node").select("node", F.concat(F.lit("t"), F.col("node")).alias("track_id"), F.col("artist").alias("artist_id"), "tags")
    return shown(I.node_assignment(n, I.canonical(given(spark, sf)), halves(spark, sf).withColumnRenamed("label", "domain")))


# --- what follows from given spectra, curves and vectors ---


def given_values(spark: SparkSession, sf: str) -> DataFrame:
    """Rising numbers in place of eigenvalues: running sums of the balances of each nation's customers."""
    first = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    c = table(spark, sf, "customer").withColumn("idx", F.row_number().over(first))
    total = F.sum(F.floor(F.abs("c_acctbal")) / 16384).over(first.rowsBetween(Window.unboundedPreceding, 0))
    return c.select(F.col("c_nationkey").alias("graph"), "idx", total.alias("value"))


@query("eigen_gaps_whole", "eigen_gaps_whole")
def _(spark, sf):
    return shown(L.gaps(given_values(spark, sf)))


@query("gap_selection_whole", "gap_selection_whole")
def _(spark, sf):
    g = L.gaps(given_values(spark, sf), 1e-6)
    return shown(L.select_qualified(L.qualified(g, 1e-10)).join(L.select_most_isolated(g).withColumnRenamed("selected", "most_isolated"), "graph"))


@query("fiedler_decreases_whole", "fiedler_decreases_whole")
def _(spark, sf):
    """Orders in place of a curve: every fifth customer's are of graphs that are not connected."""
    curve = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 5 == 0, 2).otherwise(1).alias("components"), (F.floor("o_totalprice") / 1024).alias("lambda2"))
    return shown(L.decreases(curve))


@query("nodal_domains_given", "nodal_domains_given")
def _(spark, sf):
    q = features(spark, sf).select("node", F.get("f", F.lit(0)).alias("q"))
    return shown(L.nodal_domains(edges(spark, sf, 3), q))


@query("nodal_domains_by_size_given", "nodal_domains_by_size_given")
def _(spark, sf):
    near_zero = F.get("f", F.lit(0))
    q = features(spark, sf).select("node", F.when(F.col("node") % 50 == 0, 0.0).otherwise(near_zero).alias("q"))
    return shown(L.nodal_domains(edges(spark, sf, 3), q, 1e-8, signs_first=False))


@query("best_restart_given", "best_restart_given")
def _(spark, sf):
    r = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("graph"), F.col("s_suppkey").alias("seed"), F.floor(F.col("s_acctbal") / 1000).cast("double").alias("weighted_modularity"))
    return shown(M.best(r))


@query("stability_given", "stability_given")
def _(spark, sf):
    runs = given(spark, sf).withColumn("run", F.lit(1)).unionByName(halves(spark, sf).withColumn("run", F.lit(2)))
    runs = runs.unionByName(given(spark, sf).select("node", (F.col("label") % 3).alias("label"), F.lit(3).alias("run")))
    return shown(I.stability(runs))


@query("variance_given", "variance_given")
def _(spark, sf):
    total = F.sum("s_acctbal").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = table(spark, sf, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") + 1).alias("component"), (F.col("s_acctbal") / total).alias("explained_variance_ratio"))
    return shown(P.explained_variance(r, 32))


# --- spectra and communities, whose proof is in their own columns ---


def largest(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    e = edges(spark, sf, k)
    top = C.ranked_nodes(C.components(e, nodes(spark, sf))).where("component_rank = 1")
    return cut(G.induced(e, top).withColumn("graph", F.lit(k)))


def solved(spark: SparkSession, sf: str, k: int = 3) -> tuple[DataFrame, DataFrame]:
    e = largest(spark, sf, k)
    return e, cut(L.spectrum(e))


@query("low_spectrum")
def _(spark, sf):
    return L.eigenvalues(solved(spark, sf)[1])


@query("fiedler_values")
def _(spark, sf):
    return L.eigenvalues(solved(spark, sf)[1]).where("idx = 2")


@query("spectral_sanity")
def _(spark, sf):
    e, s = solved(spark, sf)
    return L.sanity(s, e).join(L.subspace_residual(s), "graph")


@query("lanczos_fiedler")
def _(spark, sf):
    return L.lanczos(largest(spark, sf))


@query("spectral_embedding")
def _(spark, sf):
    return L.embedding(solved(spark, sf)[1])


@query("nodal_domains")
def _(spark, sf):
    e, s = solved(spark, sf)
    return L.nodal_domains(e, s.select("node", F.get("q", F.lit(1)).alias("q")))


@query("nodal_domains_by_size")
def _(spark, sf):
    e, s = solved(spark, sf)
    return L.nodal_domains(e, s.select("node", F.get("q", F.lit(1)).alias("q")), 1e-8, signs_first=False)


@query("eigen_gaps")
def _(spark, sf):
    return L.gaps(L.eigenvalues(solved(spark, sf)[1]))


@query("eigen_gap_selection")
def _(spark, sf):
    e = L.eigenvalues(solved(spark, sf)[1])
    most = e.agg(F.max("residual")).first()[0]
    return L.select_qualified(L.qualified(L.gaps(e, 1e-6), float(most))).join(L.select_most_isolated(L.gaps(e)).withColumnRenamed("selected", "most_isolated"), "graph")


@query("fiedler_sweep")
def _(spark, sf):
    w = cut(weighted(spark, sf))
    b = G.births(w).join(G.union_edges(w, 64).select("u", "v", "w"), ["u", "v"])
    return L.fiedler_sweep(b, nodes(spark, sf), 2, 64)


@query("fiedler_decreases")
def _(spark, sf):
    return L.decreases(QUERIES["fiedler_sweep"](spark, sf))


@query("spectrum_agreement", "spectrum_agreement")
def _(spark, sf):
    """(graph, idx, agree) of 33 pairs by Lanczos steps and by the dense solution: values within 1e-8, residuals at most 1e-8."""
    e = largest(spark, sf, 3).unionByName(largest(spark, sf, 64))
    a, b = (L.eigenvalues(cut(L.spectrum(e, dense=d))) for d in (L.DENSE, 0))
    b = b.select("graph", "idx", F.col("value").alias("other"), F.col("residual").alias("rest"))
    good = (F.abs(F.col("value") - F.col("other")) < 1e-8) & (F.col("residual") <= 1e-8) & (F.col("rest") <= 1e-8)
    return shown(a.join(b, ["graph", "idx"]).select("graph", "idx", good.alias("agree")))


@query("spectrum_checks", "spectrum_checks")
def _(spark, sf):
    """What must hold of any connected graph's 33 pairs: first value 0 along the roots of the strengths, the second above it, all
    in [0, 2], orthogonal, small residuals; the second as lanczos() finds it."""
    e, s = solved(spark, sf)
    x = L.sanity(s, e).join(L.subspace_residual(s), "graph")
    lanczos = L.lanczos(e).where("idx = 2").select(F.col("value").alias("other"))
    worst = L.eigenvalues(s).groupBy("graph").agg(F.max("orthogonality").alias("o"))
    x = x.join(worst, "graph").crossJoin(lanczos)  # one row and one row
    zero = (F.abs("first") < 1e-9) & (F.abs(F.col("cosine") - 1) < 1e-9)
    return x.select(zero.alias("first_is_zero"), (F.col("second") > 1e-8).alias("second_is_not"), "in_range", (F.col("residual") < 1e-8).alias("residual_is_small"), (F.col("o") < 1e-8).alias("orthogonal"), (F.abs(F.col("second") - F.col("other")) < 1e-8).alias("lanczos_agrees"))


@query("pca_checks", "pca_checks")
def _(spark, sf):
    """(component, unit, uncorrelated, variance_agrees, falls) of the components: unit vectors, coordinates of mean 0 and without
    correlation, their variances in the ratios that are reported, which fall."""
    x = features(spark, sf)
    m = P.fit(x, BORDERS)
    d = len(m.components)
    z = P.long_form(m.apply(x)).select("node", F.col("feature").alias("c"), "value")
    own = z.groupBy("c").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    other = z.select("node", F.col("c").alias("c2"), F.col("value").alias("value2"))
    most = z.join(other, "node").where("c <> c2").groupBy("c", "c2").agg(F.abs(F.covar_pop("value", "value2")).alias("v")).groupBy("c").agg(F.max("v").alias("v"))
    fixed = [(k, float(np.linalg.norm(m.components[k])), float(m.variance_ratio[k]), bool(k == 0 or m.variance_ratio[k] <= m.variance_ratio[k - 1])) for k in range(d)]
    t = spark.createDataFrame(fixed, "c int, norm double, ratio double, falls boolean").join(own, "c").join(most, "c")
    whole = F.sum("variance").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row per component
    part = float(sum(m.variance_ratio[:d]))
    agrees = F.abs(F.col("variance") / whole * part - F.col("ratio")) < 1e-9
    return t.select((F.col("c") + 1).cast("long").alias("component"), (F.abs(F.col("norm") - 1) < 1e-9).alias("unit"), ((F.abs("mean") < 1e-9) & (F.col("v") < 1e-9)).alias("uncorrelated"), agrees.alias("variance_agrees"), "falls")


@query("leiden_checks", "leiden_checks")
def _(spark, sf):
    """(graph, seed, ...) of every restart: all nodes have a community, each is connected, and the modularity is that of its table and
    above that of single nodes."""
    e, m = found(spark, sf)
    n = nodes(spark, sf).count()
    run = ["graph", "seed"]
    # a node's labels of all seeds together, so that edges are joined once
    labels = m.groupBy("graph", "node").agg(F.array(*(F.max(F.when(F.col("seed") == s, F.col("label"))) for s in M.SEEDS)).alias("of"))
    u, v = (labels.select("graph", F.col("node").alias(c), F.col("of").alias(f"l{c}")) for c in "uv")
    ends = e.join(u, ["graph", "u"]).join(v, ["graph", "v"]).select("graph", "u", "v", "w", F.explode(F.arrays_zip(F.array(*map(F.lit, M.SEEDS)).alias("seed"), "lu", "lv")).alias("x"))
    ends = written(ends.select("graph", "u", "v", "w", "x.*"))
    size = m.groupBy(*run, "label").agg(F.count(F.lit(1)).alias("size"))
    parts = C.parts_within(ends.where("lu = lv").select(*run, F.col("lu").alias("label"), "u", "v"), size, [*run, "label"])
    parts = parts.groupBy(run).agg(F.max("parts").alias("parts"))
    x = M.restarts(m).join(parts, run).join(I.modularities(ends, run), run).join(m.groupBy(run).agg(F.count("node").alias("nodes")), run)
    return x.select(F.col("graph").cast("long").alias("graph"), F.col("seed").cast("long").alias("seed"), (F.col("nodes") == n).alias("whole"), (F.col("parts") == 1).alias("connected"), (F.abs(F.col("modularity") - F.col("weighted_modularity")) < 1e-9).alias("modularity_agrees"), (F.col("modularity") > 0).alias("gains"))


@query("sinks_round_trip", "sinks_round_trip")
def _(spark, sf):
    """Rows of ``supplier`` that come back equal from every kind of file, in the shared folder."""
    t = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))
    schema, out = ", ".join(f"{c} {k}" for c, k in t.dtypes), []
    base = f"{folder(spark)}/nearfold-sinks-{uuid.uuid4().hex}"
    ways = {
        "parquet": (sinks.write_table, lambda p: spark.read.parquet(p)),
        "jsonl": (sinks.write_jsonl, lambda p: spark.read.schema(schema).json(p)),
        "csv": (sinks.write_csv, lambda p: sinks.read_csv(spark, p, schema)),
        "csv_bom": (sinks.write_csv_bom, lambda p: sinks.read_csv(spark, p, schema)),
    }
    for name, (write, read) in ways.items():
        write(t, f"{base}/{name}")
        out.append(read(f"{base}/{name}").intersectAll(t).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("equal_rows")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("fiedler_cross_check")
def _(spark, sf):
    """The second eigenvalue at k = 3 and 64 by the sweep and by the whole solution."""
    one = [L.eigenvalues(solved(spark, sf, k)[1]).where("idx = 2").select(F.lit(k).alias("k"), F.col("value").alias("lambda2")) for k in (3, 64)]
    w = cut(weighted(spark, sf))
    b = G.births(w).join(G.union_edges(w, 64).select("u", "v", "w"), ["u", "v"])
    both = L.fiedler_sweep(b, nodes(spark, sf), 3, 3).unionByName(L.fiedler_sweep(b, nodes(spark, sf), 64, 64))
    return I.largest_difference(one[0].unionByName(one[1]), both, "k", "lambda2")


def found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The graphs of k = 3 and 64 and their communities, from one table each for all queries of a session on the same files."""
    path = f"{sf}/embeddings.parquet"
    e = shared(spark, path, "graphs", lambda: G.union_graphs(weighted(spark, sf), (3, 64)))
    return e, shared(spark, path, "communities", lambda: M.communities(e))


@query("leiden_restarts")
def _(spark, sf):
    return M.restarts(found(spark, sf)[1])


@query("leiden_communities")
def _(spark, sf):
    _, m = found(spark, sf)
    best = m.join(F.broadcast(M.best(M.restarts(m))), ["graph", "seed"], "left_semi")  # a row per graph
    one = [I.canonical(best.where(F.col("graph") == g)).withColumn("graph", F.lit(g)) for g in (3, 64)]
    return one[0].unionByName(one[1])


@query("restart_stability")
def _(spark, sf):
    _, m = found(spark, sf)
    one = [I.stability(m.where(F.col("graph") == g).select(F.col("seed").alias("run"), "node", "label")).withColumn("graph", F.lit(g)) for g in (3, 64)]
    return one[0].unionByName(one[1])


@query("cross_k_comparison")
def _(spark, sf):
    """The best restart of k = 3 against that of k = 64."""
    _, m = found(spark, sf)
    best = dict(M.best(M.restarts(m)).collect())  # a row per graph
    a, b = (m.where((F.col("graph") == g) & (F.col("seed") == best[g])).select("node", "label") for g in (3, 64))
    t = I.contingency(a, b)
    return I.adjusted_rand(t).crossJoin(I.nmi(t))


@query("comparison_by_k")
def _(spark, sf):
    """A row for each k: structure, spectrum and cut of the largest component."""
    rows = []
    for k in (2, 3, 64):
        e, s = solved(spark, sf, k)
        one = D.summary(D.node_metrics(e, e.select(F.col("u").alias("node")).union(e.select("v")).distinct())).select("nodes", "edges", "degree_mean", "clustering_mean", "triangle_count", "transitivity")
        value = L.eigenvalues(s).where("idx = 2").select(F.col("value").alias("lambda2"))
        domains = L.nodal_domains(e, s.select("node", F.get("q", F.lit(1)).alias("q")), 1e-8, signs_first=False)
        rows.append(one.crossJoin(value).crossJoin(L.cut_metrics(e, domains)).withColumn("k", F.lit(k)))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


