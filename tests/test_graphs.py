"""Planted graphs, brute force on small ones, and published numbers."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfold import build
from nearfold.operators import components as C
from nearfold.operators import features as P
from nearfold.operators import graph as G
from nearfold.operators import leiden as M
from nearfold.operators import leiden_arrays as A
from nearfold.operators import neighbors as K
from nearfold.operators import partition as I
from nearfold.operators import spectral as L
from nearfold.operators import structure as D
from nearfold.plans import catalog
from nearfold.sources import sinks
from nearfold.sources import tracks as S


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "node long, f array<double>")


def graph(spark, pairs, weight=lambda u, v: 1.0):
    e = spark.createDataFrame([(min(u, v), max(u, v), float(weight(u, v)), 0.0) for u, v in pairs], "u long, v long, w double, dist double")
    n = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "node long")
    return e, n


def clique(nodes):
    nodes = list(nodes)
    return [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]


RING = [p for k in range(4) for p in clique(range(4 * k, 4 * k + 4))] + [(4 * k + 3, (4 * k + 4) % 16) for k in range(4)]
BRIDGE = clique(range(5)) + clique(range(5, 10)) + [(4, 5)]


def test_neighbours_against_numpy_with_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAST_BLOCK", 8)
    r = np.random.default_rng(1)
    x = r.integers(0, 3, (40, 3)).astype(float)
    got = {(t.i, t["rank"]): (t.j, t.dist) for t in K.neighbors(vectors(spark, x), 12).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(40):
        for rank, j in enumerate(np.argsort(d[i], kind="stable")[:12], 1):
            assert got[i, rank] == (j, d[i, j])
    assert K.pairs(vectors(spark, x)).count() == 40 * 39 // 2


@pytest.mark.parametrize("shift, scale", [(0, 1), (1e4, 1), (3e7, 1e-2), (0, 1e-18), (0, 1e18)])
def test_neighbours_far_from_the_origin_and_of_any_size(shift, scale):
    """Single precision must not lose one: near copies and equal vectors, moved and scaled, tile after tile."""
    r = np.random.default_rng(2)
    x = r.standard_normal((1500, 6))
    x[200:400] = x[:200] + r.standard_normal((200, 6)) * 1e-4
    x[400:600], x[600:1500:9] = x[:200], x[7]
    x = (x + shift) * scale
    x[1100, 2], x[1200] = np.nan, np.inf
    ids = np.arange(1500) * 3
    got = {}
    for i, j, d in K._nearest((ids[:700], x[:700]), (ids, x), 12):
        for a, b, c in zip(i.tolist(), j.tolist(), d.tolist()):
            got.setdefault(a, []).append((c, b))
    with np.errstate(all="ignore"):
        for a in range(700):
            d = np.sqrt(((x[a] - x) ** 2).sum(axis=1))
            want = sorted((c, b) for c, b in zip(d.tolist(), ids.tolist()) if b != 3 * a and np.isfinite(c))[:12]
            assert got[3 * a] == want


def test_groups_are_partitions_of_their_own_or_in_order(spark, monkeypatch):
    """Dealt by a hash, groups met in one partition."""
    x = np.random.default_rng(3).standard_normal((64, 3))
    want = sorted(K.neighbors(vectors(spark, x), 12).collect())
    rows = spark.range(900).select("id", (F.col("id") % 9).cast("int").alias("group"))
    sums = lambda t: pa.table({"g": t.column("group")[:1], "n": [t.num_rows], "s": [sum(t.column("id").to_pylist())]})
    for most in (512, 2):
        monkeypatch.setattr(K, "MOST_PARTS", most)
        monkeypatch.setattr(K, "LEAST_BLOCK", 16)
        got = K._by_group(rows, 9, sums, "g int, n long, s long").withColumn("part", F.spark_partition_id()).collect()
        assert sorted((r.g, r.n, r.s) for r in got) == [(g, 100, 100 * g + 9 * 4950) for g in range(9)]
        assert len({r.part for r in got}) == min(9, most)
        assert sorted(K.neighbors(vectors(spark, x), 12).collect()) == want
        assert K.pairs(vectors(spark, x)).distinct().count() == 64 * 63 // 2


@pytest.mark.parametrize("k", [True, 0, 40, 1.5])
def test_bad_k(k):
    with pytest.raises(ValueError):
        K.check_k(k, 40)


def test_bandwidth_fallbacks(spark):
    at = lambda *d: spark.createDataFrame([(i, 0, 10, float(x)) for i, x in enumerate(d)], "i long, j long, rank int, dist double")
    assert K.bandwidth(at(1, 2, 9)).collect()[0] == (2.0, None)
    assert K.bandwidth(at(0, 0, 4)).collect()[0] == (4.0, "positive_10th")
    pairs = spark.createDataFrame([(0, 1, 0.0), (0, 2, 3.0), (1, 2, 5.0)], "i long, j long, dist double")
    assert K.bandwidth(at(0, 0, 0), pairs).collect()[0] == (4.0, "positive_pairwise")
    with pytest.raises(Exception, match="all distances are zero"):
        K.bandwidth(at(0, 0, 0), pairs.where("dist = 0")).collect()


def test_order_statistics_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAST_BLOCK", 8)
    x = np.random.default_rng(3).integers(0, 4, (50, 3)).astype(float)
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(50, 1)])
    assert K.order_statistics(vectors(spark, x), [0, 7, 600, 1224]) == d[[0, 7, 600, 1224]].tolist()
    assert np.allclose(K.pair_quantiles(vectors(spark, x)).first()[1:], np.quantile(d, K.QUARTERS))
    assert np.allclose(K.pair_quantiles(vectors(spark, x), 1.5).first()[1:], np.quantile(np.exp(-0.5 * (d / 1.5) ** 2), K.QUARTERS))
    assert K.pair_quantiles(vectors(spark, x[:1])).first()[0] == 0


def test_neighbours_over_stripes_and_tiles(spark, monkeypatch):
    """One list for each stripe of candidates, not for each pair of blocks; many equal rows among them."""
    for name, value in (("LEAST_BLOCK", 8), ("STRIPE", 30), ("ROWS", 4), ("TILE", 7)):
        monkeypatch.setattr(K, name, value)
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(0, 3, (60, 3)), np.ones((40, 3))]).astype(float)
    got = {(t.i, t["rank"]): (t.j, t.dist) for t in K.neighbors(vectors(spark, x), 12).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, rank): (j, d[i, j]) for i in range(100) for rank, j in enumerate(np.argsort(d[i], kind="stable")[:12].tolist(), 1)}


def test_neighbours_of_one_stripe_are_ranked_where_they_are_found(spark, monkeypatch):
    """No window over the lists of all nodes; rows travel as bytes, in single precision only where that holds them."""
    x = np.random.default_rng(6).standard_normal((60, 5))
    for rows in (x, x.astype(np.float32)):
        whole = K.neighbors(vectors(spark, rows), 12)
        assert "Window" not in whole._jdf.queryExecution().toString()
        with monkeypatch.context() as m:
            m.setattr(K, "STRIPE", 25)
            parts = K.neighbors(vectors(spark, rows), 12)
            assert "Window" in parts._jdf.queryExecution().toString()
            assert sorted(whole.collect()) == sorted(parts.collect())
    rows = pa.RecordBatch.from_pydict({"node": pa.array([5, 3, 4]), "f": pa.array([[0.1], [0.5], [2.0]]), "x": pa.array([0, 1, 0]), "y": pa.array([0, 0, 0])})
    for batch, single in ((rows, False), (rows.slice(1), True)):
        packs = pa.Table.from_batches(K._packs(iter([batch])))
        assert set(packs.column("single").to_pylist()) == {single}
        nodes, f = K._unpacked(packs)[1]
        assert sorted(zip(nodes.tolist(), f.tolist())) == sorted(zip(batch.column("node").to_pylist(), batch.column("f").to_pylist()))


def test_graphs_of_several_ks_are_put_together_at_once(spark):
    near = K.neighbors(vectors(spark, np.random.default_rng(8).standard_normal((50, 3))), 12)
    w = K.weighted(near, K.bandwidth(near))
    got = G.union_graphs(w, (3, 12))
    for k in (3, 12):
        assert sorted(got.where(F.col("graph") == k).select("u", "v", "w").collect()) == sorted(G.union_edges(w, k).select("u", "v", "w").collect())
    assert sorted(r.graph for r in got.select("graph").distinct().collect()) == [3, 12]


def test_candidates_of_equal_rows_are_pruned_tile_by_tile(monkeypatch):
    seen = []
    exact = K._exact
    monkeypatch.setattr(K, "TILE", 64)
    monkeypatch.setattr(K, "_exact", lambda a, b, r, c: seen.append(len(r)) or exact(a, b, r, c))
    ids, x = np.arange(1024), np.ones((1024, 4))
    (i, j, dist), = K._nearest((ids[:8], x[:8]), (ids, x), 3)
    assert max(seen) <= 8 * (24 * 3 + 64) and not dist.any() and j[:3].tolist() == [1, 2, 3] and j[-3:].tolist() == [0, 1, 2]


@pytest.mark.parametrize("few, bins", [(1 << 18, 1 << 16), (20, 8), (0, 4)])
def test_order_statistics_work_out_few_exact_distances(spark, monkeypatch, few, bins):
    """Bins of matrix products say where the wanted ones are: with copies, with one vector far from all, and by all ways."""
    monkeypatch.setattr(K, "LEAST_BLOCK", 16)
    monkeypatch.setattr(K, "ROWS", 8)
    monkeypatch.setattr(K, "TILE", 16)
    monkeypatch.setattr(K, "FEW", few)
    monkeypatch.setattr(K, "BINS", bins)
    r = np.random.default_rng(7)
    x = np.concatenate([r.standard_normal((70, 5)), np.full((20, 5), 0.25), np.full((1, 5), 1e4)])
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(91, 1)])
    places = [0, 100, 189, 190, 2000, 4000, 4094]
    assert K.order_statistics(vectors(spark, x), places) == d[places].tolist()
    assert K.order_statistics(vectors(spark, np.zeros((30, 2))), [0, 434]) == [0.0, 0.0]
    with pytest.raises(ValueError, match="finite"):
        K.order_statistics(vectors(spark, [[0.0], [float("nan")]]), [0])


def test_order_statistics_far_from_the_origin_take_two_passes(spark, monkeypatch):
    """Squares of vectors from their middle: from the origin all pairs were in one bin, and were binned anew."""
    x = np.random.default_rng(9).standard_normal((800, 4)) + 1000
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(800, 1)])
    passes, own = [], K._by_group
    monkeypatch.setattr(K, "_by_group", lambda *a: passes.append(1) or own(*a))
    places = [0, 80_000, 160_000, len(d) - 1]
    assert K.order_statistics(vectors(spark, x), places) == d[places].tolist() and len(passes) == 2


def test_neighbour_table_is_shared_until_files_change(spark, tmp_path):
    save = lambda seed: spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(np.random.default_rng(seed).standard_normal((30, 4)))], "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    save(1)
    one = catalog.near(spark, str(tmp_path), 3)
    first = one.orderBy("i", "rank").collect()
    assert catalog.near(spark, str(tmp_path), 3).orderBy("i", "rank").collect() == first
    save(2)
    assert catalog.near(spark, str(tmp_path), 3).orderBy("i", "rank").collect() != first


def test_anchor_counts(spark):
    """Edge counts, components and bandwidth of the smallest embeddings, measured independently."""
    near = catalog.near(spark, "/root/testdata/sf0.001")
    counts = {r.k: r.edges for r in G.edge_counts(G.births(near), 64).collect()}
    assert [counts[k] for k in (1, 2, 3, 5, 10, 64)] == [387, 690, 985, 1547, 2924, 16992]
    assert abs(K.bandwidth(near).first().sigma - 1.2188458271847957) < 1e-12
    e = catalog.edges(spark, "/root/testdata/sf0.001", 1)
    n = catalog.nodes(spark, "/root/testdata/sf0.001")
    one, rounds = C.components(e, n), C.components(e, n, one_task=0)
    assert C.summary(one).first()[1:3] == (113, 15)
    assert C.same_partition(one, rounds).first() == (0, 0)


def test_sweep_over_rounds_equals_one_task(spark):
    e, n = graph(spark, RING)
    births = e.select("u", "v", (F.col("u") % 3 + 1).cast("int").alias("birth"))
    assert C.sweep(births, n, 3).orderBy("k").collect() == C.sweep(births, n, 3, one_task=0).orderBy("k").collect()


def test_sweep_by_forests_equals_one_task(spark, monkeypatch):
    """More edges than a task takes: forests of parts of them, no rounds over the table."""
    monkeypatch.setattr(C, "_sweep_rounds", None)
    r = np.random.default_rng(9)
    pairs = {(int(min(p)), int(max(p))) for p in r.integers(0, 200, (3000, 2)) if p[0] != p[1]}
    births = spark.createDataFrame([(u, v, int(r.integers(1, 40))) for u, v in sorted(pairs)], "u long, v long, birth int")
    nodes = spark.range(210).withColumnRenamed("id", "node")
    assert C.sweep(births, nodes, 40, one_task=1500).orderBy("k").collect() == C.sweep(births, nodes, 40).orderBy("k").collect()


def test_threshold_by_forests(spark, monkeypatch):
    monkeypatch.setattr(C, "_sweep_rounds", None)
    rows = [(u, v, 7 if v == 59 else 1 + (u + v) % 4) for u in range(60) for v in range(u + 1, 60)]
    births = spark.createDataFrame(rows, "u long, v long, birth int")
    assert C.threshold(C.sweep(births, spark.range(60).withColumnRenamed("id", "node"), 9, one_task=900)).first().k_c == 7


@pytest.mark.parametrize("pairs, triangles, transitivity", [(clique(range(3)), 1, 1.0), ([(0, 1), (1, 2), (2, 3)], 0, 0.0), ([(0, k) for k in range(1, 6)], 0, 0.0), (BRIDGE, 20, 120 / 136)])
def test_planted_triangles(spark, pairs, triangles, transitivity):
    e, n = graph(spark, pairs)
    m = D.node_metrics(e, n)
    s = D.summary(m).first()
    assert s.triangle_count == triangles and abs(s.transitivity - transitivity) < 1e-12
    assert D.checks(m, e).first() == (0, 0, 0, 0)


def test_dense_pmf_and_fractions(spark):
    e, n = graph(spark, BRIDGE + [(0, 20)])
    m = D.node_metrics(e, n)
    assert [(r.degree, r["count"]) for r in D.degree_pmf(m).orderBy("degree").collect()] == [(1, 1), (2, 0), (3, 0), (4, 7), (5, 3)]
    assert {r.exact_fraction: r["count"] for r in D.clustering_pmf(m).collect()} == {"0": 1, "1": 7, "3/5": 3}


def test_published_skewness(spark):
    """Population skewness 2.361141 of 1997 degrees is 2.362917 when corrected."""
    n = 1997
    assert abs(2.361141 * (n * (n - 1)) ** 0.5 / (n - 2) - 2.362917) < 2e-6
    r = np.random.default_rng(2).integers(1, 9, 200).astype(float)
    got = spark.createDataFrame([(float(x),) for x in r], "degree double").agg(D.skewness("degree")).first()[0]
    g = ((r - r.mean()) ** 3).mean() / r.std() ** 3
    assert abs(got - g * (200 * 199) ** 0.5 / 198) < 1e-9
    assert spark.createDataFrame([(1.0,)] * 5, "degree double").agg(D.skewness("degree")).first()[0] is None


def test_laplacians(spark):
    e, n = graph(spark, RING, lambda u, v: 1 + (u * v) % 3)
    s = G.nullspace_residual(e, n).first()
    assert s["rows"] == 16 and s.largest < 1e-12
    assert G.laplacian(e).groupBy("row").agg(F.sum("value").alias("s")).where("abs(s) > 1e-12").count() == 0
    assert G.invariants(e).first() == (0, 0, 0, 0)
    assert G.invariants(e.union(e.limit(1)).union(e.limit(1).select("u", F.col("u"), F.lit(-1.0), "dist"))).first() == (1, 0, 1, 1)


def test_spectra(spark):
    e, n = graph(spark, [(k, (k + 1) % 6) for k in range(6)])
    solved = L.spectrum(e.withColumn("graph", F.lit(1)))
    values = [r.value for r in L.eigenvalues(solved).orderBy("idx").collect()]
    assert np.allclose(values, sorted(1 - np.cos(2 * np.pi * k / 6) for k in range(6)))
    assert max(r.residual for r in L.eigenvalues(solved).collect()) < 1e-12
    s = L.sanity(solved, e.withColumn("graph", F.lit(1))).first()
    assert abs(s["first"]) < 1e-12 and s.in_range and abs(s.cosine - 1) < 1e-12


def test_weighted_triangle(spark):
    e, _ = graph(spark, clique(range(3)), lambda u, v: 1 + u + v)
    values = [r.value for r in L.eigenvalues(L.spectrum(e.withColumn("graph", F.lit(1)))).orderBy("idx").collect()]
    assert abs(sum(values) - 3) < 1e-12 and values[1] < 1.5 < values[2]


def test_lanczos_finds_the_dense_value(spark):
    e, _ = graph(spark, BRIDGE, lambda u, v: 1 + (u + v) % 2)
    dense = L.eigenvalues(L.spectrum(e.withColumn("graph", F.lit(1)))).where("idx = 2").first().value
    assert abs(L.lanczos(e, steps=9).where("idx = 2").first().value - dense) < 1e-8


@pytest.mark.parametrize("one_task", [0, 1_000])
def test_lanczos_goes_on_until_the_pairs_have_converged(spark, one_task):
    e, _ = graph(spark, [(i, i + 1) for i in range(15)])  # 12 steps are not enough
    got = {r.idx: r for r in L.lanczos(e, one_task=one_task).collect()}
    assert abs(got[1].value) < 1e-8 and abs(got[2].value - (1 - np.cos(np.pi / 15))) < 1e-8
    assert max(r.residual for r in got.values()) <= 1e-8


def test_graphs_above_the_dense_limit(spark):
    e, n = graph(spark, [(i, (i + 1) % 300) for i in range(300)])  # every value but the first and last is double
    got = L.spectrum(e.withColumn("graph", F.lit(1)), 9, dense=100)
    want = np.sort(1 - np.cos(2 * np.pi * np.arange(300) / 300))[:9]
    rows = L.eigenvalues(got).orderBy("idx").collect()
    assert np.allclose([r.value for r in rows], want, atol=1e-10) and max(r.residual for r in rows) < 1e-9
    curve = L.fiedler_sweep(e.withColumn("birth", F.lit(1)), n, 1, 1, dense=100).first()
    assert curve.components == 1 and abs(curve.lambda2 - want[1]) < 1e-10


def test_nodal_domains_of_two_cliques(spark):
    e, n = graph(spark, BRIDGE)
    v = L.spectrum(e.withColumn("graph", F.lit(1))).select("node", F.get("q", F.lit(1)).alias("q"))
    found = L.nodal_domains(e, v)
    assert sorted(x[0] for x in found.groupBy("domain").agg(F.sort_array(F.collect_list("node"))).select(F.col("sort_array(collect_list(node), true)")).collect()) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]
    cut = L.cut_metrics(e, found).first()
    assert cut.crossing_edges == 1 and abs(cut.normalized_cut - 2 / 21) < 1e-12
    with pytest.raises(Exception, match="zero"):
        L.nodal_domains(e, v.withColumn("q", F.when(F.col("node") == 4, 1e-8).otherwise(F.col("q")))).collect()
    zero = v.withColumn("q", F.when(F.col("node") == 4, 0.0).otherwise(F.col("q")))
    with pytest.raises(Exception, match="zero"):
        L.nodal_domains(e, zero).collect()
    assert L.nodal_domains(e, zero, 1e-8, signs_first=False).where("domain = -1").select("node").collect() == [(4,)]
    assert L.cut_metrics(e, L.nodal_domains(e, zero, 1e-8, signs_first=False)).first().normalized_cut is None


def test_selection_statuses(spark):
    def status(*values):
        e = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(values, 1)], "graph int, idx int, value double")
        g = L.gaps(e)
        return L.select_qualified(L.qualified(g, 1e-12)).select("selected", "status").first(), L.select_most_isolated(g).first().selected

    assert status(0, 0.1, 0.2, 0.4, 0.41) == ((2, "second"), 2)
    assert status(0, 0.0005, 0.1, 0.3, 0.31) == ((3, "later"), 3)
    assert status(0, 1e-4, 2e-4, 3e-4, 4e-4)[0] == (None, "none")


def test_published_normalised_cut():
    assert abs(114.5888 * (1 / 1997.168 + 1 / 2411.025) - 0.104903) < 1e-6


def test_decreases(spark):
    c = spark.createDataFrame([(2, 1, 0.3), (3, 1, 0.2), (4, 2, 0.0), (5, 1, 0.4)], "k int, components long, lambda2 double")
    assert [(r.k, r.next_k, round(r.change, 9)) for r in L.decreases(c).collect()] == [(2, 3, -0.1)]


@pytest.mark.parametrize("pairs, groups", [(RING, [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12, 13, 14, 15]]), (BRIDGE, [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]])])
def test_leiden_on_planted_groups(spark, pairs, groups):
    e, n = graph(spark, pairs)
    found = M.communities(e.withColumn("graph", F.lit(1)), (521, 522)).toPandas()
    for seed, part in found.groupby("seed"):
        assert sorted(sorted(g) for g in part.groupby("label").node.apply(list)) == groups
    labels = spark.createDataFrame(found[found.seed == 521][["node", "label"]])
    assert abs(I.modularity(I.community_table(e, labels)).first()[0] - found[found.seed == 521].quality.iloc[0]) < 1e-12
    assert C.group_connectivity(e, labels).where("parts <> 1").count() == 0


@pytest.mark.parametrize("pairs, groups", [(RING, 4), (BRIDGE, 2)])
def test_leiden_on_arrays_finds_planted_groups(spark, monkeypatch, pairs, groups):
    monkeypatch.setattr(M, "NODE_BY_NODE", 0)
    monkeypatch.setattr(M, "leiden", None)
    e, _ = graph(spark, pairs)
    found = M.communities(e.withColumn("graph", F.lit(1)), (521, 522))
    assert [(r.community_count, r.min_size == r.max_size) for r in M.restarts(found).collect()] == [(groups, True)] * 2


def test_leiden_on_arrays_is_near_that_by_nodes():
    r = np.random.default_rng(8)
    pairs = np.array(sorted({(min(u, v), max(u, v)) for u in range(400) for v in r.integers(0, 400, 12).tolist() if u != v and (u // 20 == v // 20 or r.random() < 0.3)}))
    u, v, w = pairs[:, 0], pairs[:, 1], r.random(len(pairs)) + 0.5
    nodes = [{} for _ in range(400)]
    for a, b, x in zip(u.tolist(), v.tolist(), w.tolist()):
        nodes[a][b] = nodes[b][a] = x
    labels = [A.leiden(u, v, w, 400, s) for s in M.SEEDS]
    values = [A.quality(u, v, w, x) for x in labels]
    assert abs(values[0] - M.quality(nodes, labels[0].tolist())) < 1e-12 and (A.leiden(u, v, w, 400, 521) == labels[0]).all()
    assert max(values) >= 0.97 * max(M.quality(nodes, M.leiden(nodes, s)) for s in M.SEEDS)
    assert all((A.connected(u, v, x) == x).all() for x in labels)


def test_nodes_are_numbered_alike_by_a_table_and_by_search(monkeypatch):
    u, v = np.array([-3, 7, 7, 20]), np.array([7, 9, 20, 30])
    both = []
    for dense in (100, 0):
        monkeypatch.setattr(M, "DENSE_IDS", dense)
        both.append([x.tolist() for x in M._numbered(u, v)])
    assert both[0] == both[1] == [[-3, 7, 9, 20, 30], [0, 1, 1, 3], [1, 2, 3, 4]]


def test_leiden_parts_are_connected():
    r = np.random.default_rng(3)
    u, v = np.triu_indices(60, 1)
    keep = r.random(len(u)) < 0.08
    u, v = u[keep], v[keep]
    g = A.links(u, v, np.ones(len(u)), np.bincount(u, minlength=60) + np.bincount(v, minlength=60) + 0.0, float(len(u)))
    groups = np.arange(60) % 2
    parts = A._refine(g, groups, r)
    same = parts[u] == parts[v]
    assert len(np.unique(C._roots(u[same], v[same], 60))) == len(np.unique(parts)) < 60 and (groups[parts] == groups).all()


def test_each_leiden_run_is_a_partition(spark, monkeypatch):
    """Dealt by a hash of (graph, seed), several runs met in one of four partitions."""
    monkeypatch.setattr(M, "NODE_BY_NODE", 20)
    both = graph(spark, RING)[0].withColumn("graph", F.lit(7)).unionByName(graph(spark, BRIDGE)[0].withColumn("graph", F.lit(3)))
    found = M.communities(both).withColumn("part", F.spark_partition_id()).toPandas()
    assert found.groupby(["graph", "seed"]).part.nunique().max() == 1 and found.part.nunique() == 10
    assert len(found) == 5 * (16 + 10) and set(found[found.graph == 3].label) == {0, 5}
    assert M.communities(both.where("graph > 9")).count() == 0


def test_order_of_keys_that_do_and_do_not_fit_a_number_with_their_places():
    key = np.random.default_rng(5).integers(0, 9, 1000)
    for bound in (9, 1 << 60):
        assert (A.order_of(key, bound) == np.argsort(key, kind="stable")).all()
    assert len(A.order_of(key[:0], 9)) == 0


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_links_into_groups_by_sorting_and_by_a_table(monkeypatch, few):
    monkeypatch.setattr(A, "FEW_CELLS", few)
    r = np.random.default_rng(5)
    u, v = np.triu_indices(30, 1)
    w, labels, nodes = r.random(len(u)), r.integers(0, 30, 30), np.array([4, 0, 29])
    g = A.links(u, v, w, np.bincount(u, w, 30) + np.bincount(v, w, 30), w.sum())
    want = {}
    for x, y, z in [*zip(u, v, w), *zip(v, u, w)]:
        for k in np.flatnonzero(nodes == x):
            want[k, labels[y]] = want.get((k, labels[y]), 0) + z
    row, c, into = A._into(g, labels, nodes)
    assert list(zip(row, c)) == sorted(want) and np.allclose(into, [want[x] for x in sorted(want)])


def test_links_of_a_batch_are_a_row_for_each_graph():
    rows = [(3, 1, 2, 0.5), (64, 1, 2, 0.25), (3, 4, 9, 1.0)]
    batch = pa.RecordBatch.from_pylist([dict(zip(["graph", "u", "v", "w"], r)) for r in rows])
    got = []
    for b in M._packed(iter([batch])):
        for x in b.to_pylist():
            got += [(x["graph"], *y) for y in zip(np.frombuffer(x["u"], np.int64), np.frombuffer(x["v"], np.int64), np.frombuffer(x["w"]))]
    assert got == sorted(rows)


def test_table_of_groups_follows_moves(monkeypatch):
    r = np.random.default_rng(6)
    u, v = np.triu_indices(40, 1)
    w, labels = r.random(len(u)), r.integers(0, 5, 40)
    monkeypatch.setattr(A, "AT_ONCE", 100)
    g = A.links(u, v, w, np.bincount(u, w, 40) + np.bincount(v, w, 40), w.sum())
    table, nodes = A._Table(g, labels, np.unique(labels)), np.arange(40)
    for _ in range(20):
        go = r.choice(40, 7, replace=False)
        goal, was = r.integers(0, 5, 7), labels[go]
        labels[go] = goal
        row, at = A._at(g, go)
        assert table.moved(g.to[at], g.w[at], was[row], goal[row])
        for x, y in zip(table.into(nodes[::-1]), A._into(g, labels, nodes[::-1])):
            assert np.allclose(x, y)
    assert not table.moved(np.array([1]), np.array([1.0]), np.array([0]), np.array([39]))


def test_best_groups_are_alike_by_table_and_by_links(monkeypatch):
    """Equal gains, nodes without links and groups that a node has none in, cell by cell; components are alike by parts and by nodes."""
    r = np.random.default_rng(9)
    u, v = np.triu_indices(40, 1)
    keep = (r.random(len(u)) < 0.2) & (v < 38)
    u, v = u[keep].astype(np.int32), v[keep].astype(np.int32)
    w, labels = r.integers(1, 3, len(u)) + 0.0, r.integers(0, 6, 40)
    monkeypatch.setattr(A, "AT_ONCE", 50)
    g = A.links(u, v, w, np.bincount(u, w, 40) + np.bincount(v, w, 40), w.sum())
    nodes = r.permutation(40)
    args = nodes, g.strength[nodes], labels[nodes], np.bincount(labels, g.strength, 40), 2 * g.total
    for x, y in zip(A._Table(g, labels, np.unique(labels)).best(*args), A._best(g, labels, *args)):
        assert np.allclose(x, y)
    want = A.connected(u, v, labels)
    parts, groups, place = A._merged(g, A.connected(u, v, labels * 2 + (np.arange(40) % 2)), labels)
    for graph_, at, of in ((g, labels, np.arange(40)), (parts, groups, place)):
        assert (A._connected_by(graph_, at, of) == want).all()


def test_moves_look_at_links_of_few_groups_once(monkeypatch):
    r = np.random.default_rng(7)
    u, v = np.triu_indices(400, 1)
    keep = r.random(len(u)) < np.where(u // 100 == v // 100, 0.5, 0.2)
    u, v = u[keep], v[keep]
    g = A.links(u, v, np.ones(len(u)), np.bincount(u, minlength=400) + np.bincount(v, minlength=400) + 0.0, float(len(u)))
    looks, into = [], A._into
    monkeypatch.setattr(A, "_into", lambda g, labels, nodes: (looks.append(len(nodes)), into(g, labels, nodes))[1])
    labels = r.integers(0, 4, 400)
    assert A._move(g, labels, np.random.default_rng(1))
    assert sum(looks) < 400  # less than one round of all nodes


def test_restarts_are_checked_together(spark):
    e, _ = graph(spark, BRIDGE + [(20, 21)], lambda u, v: 1 + (u + v) % 3)
    labels = {1: lambda x: x // 5, 2: lambda x: x % 2}
    rows = [(s, r.u, r.v, f(r.u), f(r.v), r.w) for r in e.collect() for s, f in labels.items()]
    ends = spark.createDataFrame(rows, "seed int, u long, v long, lu long, lv long, w double")
    got = {r.seed: r.modularity for r in I.modularities(ends, ["seed"]).collect()}
    for s, f in labels.items():
        own = spark.createDataFrame([(x, f(x)) for x in [*range(10), 20, 21]], "node long, label long")
        assert abs(got[s] - I.modularity(I.community_table(e, own)).first()[0]) < 1e-12
        size = own.groupBy("label").agg(F.count("node").alias("size"))
        parts = C.parts_within(ends.where(f"seed = {s} and lu = lv").select(F.col("lu").alias("label"), "u", "v"), size, ["label"])
        assert sorted(parts.collect()) == sorted(C.group_connectivity(e, own).collect())


def test_communities_are_found_once_for_a_session(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(11).standard_normal((90, 4))
    spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    calls, own = [], M.communities
    monkeypatch.setattr(M, "communities", lambda e: calls.append(1) or own(e))
    rows = {n: catalog.QUERIES[n](spark, str(tmp_path)).count() for n in ("leiden_restarts", "leiden_communities", "restart_stability", "cross_k_comparison", "leiden_checks")}
    assert list(rows.values()) == [10, 180, 2, 1, 10] and len(calls) == 1


def test_leiden_of_graphs_that_do_not_fit_a_task(spark):
    """Made smaller by joins first: connected communities, their quality, and nearly that of one task."""
    r = np.random.default_rng(8)
    pairs = {(min(u, v), max(u, v)) for u in range(120) for v in r.integers(0, 120, 9).tolist() if u != v and (u // 20 == v // 20 or r.random() < 0.08)}
    e, n = graph(spark, sorted(pairs), lambda u, v: 1 + (u * v) % 2)
    both = e.withColumn("graph", F.lit(3)).unionByName(graph(spark, RING)[0].withColumn("graph", F.lit(7)))
    found = M.communities(both, (521,), one_task=40).toPandas()
    one = M.communities(both, (521,)).toPandas()
    assert sorted(found[found.graph == 3].node) == sorted(x.node for x in n.collect())
    labels = spark.createDataFrame(found[found.graph == 3][["node", "label"]])
    q = found[found.graph == 3].quality.iloc[0]
    assert abs(I.modularity(I.community_table(e, labels)).first()[0] - q) < 1e-9
    assert C.group_connectivity(e, labels).where("parts <> 1").count() == 0
    assert q >= 0.95 * one[one.graph == 3].quality.iloc[0] and (found.label == found.groupby(["graph", "label"]).node.transform("min")).all()
    assert found[found.graph == 7].sort_values("node").label.tolist() == [0] * 4 + [4] * 4 + [8] * 4 + [12] * 4
    assert found.equals(M.communities(both, (521,), one_task=40).toPandas().set_index(["graph", "node"]).loc[list(zip(found.graph, found.node))].reset_index()[found.columns])


def test_stability_of_restarts_does_not_depend_on_the_size_of_the_input(spark, tmp_path, monkeypatch):
    """The rows of graphs that are large for a task, and of graphs that are not."""
    x, own = np.random.default_rng(12).standard_normal((90, 4)), M.communities
    rows = []
    for edges_ in (40, 10**9):
        spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{edges_}/embeddings.parquet")
        monkeypatch.setattr(M, "communities", lambda e: own(e, one_task=edges_))
        rows.append([sorted(map(tuple, catalog.QUERIES[n](spark, f"{tmp_path}/{edges_}").collect())) for n in ("restart_stability", "leiden_restarts")])
    assert rows[0] == rows[1] and [len(r) for r in rows[0]] == [2, 10]


def some_links(n, groups, seed):
    r = np.random.default_rng(seed)
    u, v = np.triu_indices(n, 1)
    keep = r.random(len(u)) < np.where(u % groups == v % groups, 0.4, 0.05)
    return u[keep], v[keep], r.integers(1, 5, int(keep.sum())) + 0.0


def test_leiden_rows_do_not_depend_on_the_size_of_the_input(spark):
    """A graph that is large for a task, and a small one, have the rows of the same steps on arrays."""
    u, v, w = some_links(150, 6, 2)
    e = spark.createDataFrame([(3, int(x), int(y), float(z)) for x, y, z in zip(u, v, w)], "graph int, u long, v long, w double").repartition(3)
    rows = [sorted(map(tuple, M.communities(e, (521, 524), one_task=m).collect())) for m in (40, len(u), 10**9)]
    assert rows[0] == rows[1] == rows[2]
    for seed in (521, 524):
        labels = A.leiden(u, v, w, 150, seed)
        assert [r[2:] for r in rows[0] if r[1] == seed] == [(x, int(labels[x]), A.quality(u, v, w, labels)) for x in range(150)]


@pytest.mark.parametrize("piece", [50, 1 << 20])
def test_leiden_on_files_and_pieces_is_that_in_memory(monkeypatch, tmp_path, piece):
    u, v, w = some_links(200, 8, 3)
    u, v, w = np.append(u, [7, 9]), np.append(v, [7, 9]), np.append(w, [2.0, 1.0])  # loops too
    want = [A.leiden(u, v, w, 200, s) for s in M.SEEDS]
    monkeypatch.setattr(A, "PIECE", piece)
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    made = []
    make = lambda n, dtype: (made.append(n), A.in_file(n, dtype))[1]
    mixed = np.random.default_rng(1).permutation(len(u))
    a, b, x = A.ordered(u[mixed], v[mixed], w[mixed], 200, make)
    order = np.argsort(u * 200 + v)
    assert all((got == of[order]).all() for got, of in zip((a, b, x), (u, v, w)))
    for seed, labels in zip(M.SEEDS, want):
        assert (A.leiden(a, b, x, 200, seed, make) == A.leiden(u[order], v[order], w[order], 200, seed)).all()
        assert (A.leiden(u, v, w, 200, seed, make) == labels).all()
        assert (A.connected(u, v, labels) == labels).all()
    assert made and not list(tmp_path.iterdir())


def test_links_in_order_are_summed_by_pairs(monkeypatch):
    monkeypatch.setattr(A, "PIECE", 7)
    r = np.random.default_rng(4)
    u, v, w = r.integers(3, 9, 60), r.integers(0, 9, 60), r.integers(1, 9, 60) + 0.0
    a, b, x = A.ordered(u, v, w, 12, summed=True)
    key = u * 12 + v
    assert (a * 12 + b == np.unique(key)).all() and (x == [w[key == k].sum() for k in np.unique(key)]).all()
    assert [len(y) for y in A.ordered(u[:0], v[:0], w[:0], 12, summed=True)] == [0, 0, 0]


def test_leiden_is_the_same_for_a_seed_and_near_the_best():
    r = np.random.default_rng(4)
    graph_ = [{} for _ in range(9)]
    for u in range(9):
        for v in range(u):
            if r.random() < 0.45:
                graph_[u][v] = graph_[v][u] = float(r.integers(1, 4))

    def partitions(k):
        if k == 0:
            yield []
            return
        for p in partitions(k - 1):
            for c in range(max(p, default=-1) + 2):
                yield [*p, c]

    best = max(M.quality(graph_, p) for p in partitions(9))
    found = [M.quality(graph_, M.leiden(graph_, s)) for s in M.SEEDS]
    assert M.leiden(graph_, 521) == M.leiden(graph_, 521)
    assert max(found) >= best * 0.99


def test_published_rand_and_nmi(spark):
    """ARI of aligned two-way partitions is 1 for equal ones, and 0 about for independent ones; NMI likewise."""
    t = spark.createDataFrame([(1, 1, 30), (2, 2, 70)], "a int, b int, n long")
    assert I.adjusted_rand(t).first()[0] == 1.0 and abs(I.nmi(t).first()[0] - 1) < 1e-12
    t = spark.createDataFrame([(1, 1, 25), (1, 2, 25), (2, 1, 25), (2, 2, 25)], "a int, b int, n long")
    assert abs(I.nmi(t).first()[0]) < 1e-12 and abs(I.adjusted_rand(t).first()[0]) < 0.011
    assert I.adjusted_rand(spark.createDataFrame([(1, 1, 9)], "a int, b int, n long")).first()[0] == 1.0


def test_features_pca(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((200, 5)) @ r.standard_normal((5, 8))
    x[:, 3] = 2.5
    df = vectors(spark, x).repartition(4)
    m = P.fit(df, [3, 6], dimensions=3)
    keep = np.array([k != 3 for k in range(8)])
    w = np.array([1 / np.sqrt(3)] * 3 + [1 / np.sqrt(2)] * 3 + [1 / np.sqrt(2)] * 2)
    z = ((x - x.mean(axis=0)) / np.where(keep, x.std(axis=0), 1) * w)[:, keep]
    s = np.linalg.svd(z - z.mean(axis=0), compute_uv=False)
    assert np.allclose(m.singular, s, atol=1e-9) and m.components.shape == (3, 7)
    got = np.array([t.f for t in m.apply(df).orderBy("node").collect()])
    full = (z - z.mean(axis=0)) @ np.linalg.svd(z - z.mean(axis=0))[2][:3].T
    assert np.allclose(np.abs(got), np.abs(full), atol=1e-9)
    assert np.allclose(got, np.array([t.f for t in m.apply(df).orderBy("node").collect()]), atol=0)
    with pytest.raises(ValueError):
        P.fit(vectors(spark, np.ones((5, 4))), [2, 3])


def record(i, **changes):
    cov = [[0.0] * 13 for _ in range(13)]
    for k in range(13):
        cov[k][k] = float(k)
    base = {"mean": [1.0] * 13, "cov": cov, "hmean": [0.5] * 36, "var": [4.0] * 36, "bpm": 120.0}
    base |= changes
    return {"node": {"track_id": i, "artist_id": "a", "genre": ["x", "y"], "mood/theme": [], "instrument": []}, "acoustic": {"lowlevel": {"mfcc": {"mean": base["mean"], "cov": base["cov"]}}, "tonal": {"hpcp": {"mean": base["hmean"], "var": base["var"]}}, "rhythm": {"bpm": base["bpm"], "onset_rate": 2.0}}}


def test_track_records(spark, tmp_path):
    small = [r[:] for r in record("x")["acoustic"]["lowlevel"]["mfcc"]["cov"]]
    small[0][0] = -1e-12
    rows = [record("c"), record("a", cov=small), record("b", mean=[1.0] * 12), record("d", var=[-1.0] + [4.0] * 35), record("e", bpm=None)]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(r) for r in rows[:2]) + "\n\n" + "\n".join(json.dumps(r) for r in rows[2:]) + "\n")
    t = S.checked_keys(S.read_tracks(spark, str(tmp_path / "t.jsonl")))
    got = {r.track_id: r for r in S.extract_features(t).collect()}
    assert len(got["c"].f) == 100 == len(S.feature_names()) and got["c"].f[13:16] == [0.0, 1.0, 2**0.5] and got["c"].clipped == 0
    assert got["a"].clipped == 1 and got["a"].f[13] == 0.0
    assert got["b"].f is None and got["b"].error.startswith("b: mfcc.mean") and "negative" in got["d"].error and got["e"].error == "e: rhythm: value"
    assert [(r.node.track_id, r.node_index) for r in S.indexed(t).orderBy("node_index").collect()] == [(x, k) for k, x in enumerate("abcde")]
    wide = [[1000.0] * 13 for _ in range(13)]
    for k in range(13):
        wide[k][k] = 1.0 if k else -1e-9  # large covariances do not make a variance rounding
    (tmp_path / "w.jsonl").write_text(json.dumps(record("w", cov=wide)))
    assert "negative variance" in S.extract_features(S.read_tracks(spark, str(tmp_path / "w.jsonl"))).first().error
    (tmp_path / "none.jsonl").write_text("\n\n")
    with pytest.raises(ValueError, match="no records"):
        S.read_tracks(spark, str(tmp_path / "none.jsonl"))
    with pytest.raises(Exception, match="repeated"):
        S.checked_keys(t.union(t)).collect()
    with pytest.raises(Exception, match="mfcc.mean"):
        S.strict(S.extract_features(t)).collect()


def parts_of_a_million(spark, path):
    """SQL cuts keys to six digits, so part 1,000,000 is shown with the id of part 100,000."""
    rows = [(k, f"a{k} b", "Brand#1", "t", 1 + k % 50, 0.5) for k in (5, 100_000, 100_001, 1_000_000, 1_000_001)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")


def test_dense_index_of_a_million_parts(spark, tmp_path):
    parts_of_a_million(spark, tmp_path)
    got = catalog.QUERIES["tracks_dense_index"](spark, str(tmp_path)).orderBy("node_index").collect()
    assert [tuple(r) for r in got] == [("t000005", 0, "a5|b"), ("t100000", 1, "a100000|b"), ("t100000", 2, "a1000000|b"), ("t100000", 3, "a1000001|b"), ("t100001", 4, "a100001|b")]


def test_dense_index_of_parts_that_sql_writes_alike(spark, tmp_path):
    """Keys of six to eight digits with one shown id come in the order of the keys, as SQL has them, not of their digits."""
    rows = [(k, f"a{k} b", "Brand#1", "t", 1, 0.5) for k in (100_000, 100_001, 1_000_000, 1_000_001, 10_000_000, 10_000_010)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["tracks_dense_index"]).fetchall()
    got = catalog.QUERIES["tracks_dense_index"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and [x for x in sorted(want) if x[2] == "a10000000|b"] == [("t100000", 3, "a10000000|b")]


def test_features_of_a_million_parts(spark, tmp_path):
    parts_of_a_million(spark, tmp_path)
    got = catalog.QUERIES["tracks_json_features"](spark, str(tmp_path)).collect()
    assert sorted(r.track_id for r in got) == ["t000005", "t100000", "t100000", "t100000", "t100001"]
    assert {(r.n, r.clipped, r.error) for r in got} == {(100, 1, None)}
    assert len({r.total for r in got}) == 3  # sizes 6, 1, 2, 1, 2


def test_build(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = []
    for k in range(40):
        cov = np.diag(r.random(13) + 0.1).tolist()
        rows.append(record(f"t{k:02d}", mean=r.standard_normal(13).tolist(), cov=cov, hmean=r.random(36).tolist(), var=r.random(36).tolist(), bpm=float(r.integers(60, 180))))
    (tmp_path / "tracks.jsonl").write_text("\n".join(json.dumps(x) for x in rows))
    curve = {x.k: x for x in build.build(spark, str(tmp_path / "tracks.jsonl"), str(tmp_path / "out"), dimensions=8, k_max=12, save_graphs=True).collect()}
    assert sorted(curve) == list(range(2, 13)) and curve[12].n_components == 1
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert len(read("features").first().f) == 8 and len(read("raw").first().f) == 100 and read("neighbors").count() == 40 * 12
    assert read("edges").where("birth <= 3").count() == curve[3].edges
    csv = sinks.read_csv(spark, str(tmp_path / "out" / "connectivity"), "k int, edges long, n_components long, largest_component_size long")
    assert {x.k: x.edges for x in csv.collect()} == {k: x.edges for k, x in curve.items()}
    assert spark.read.json(str(tmp_path / "out" / "nodes")).count() == 40
    with pytest.raises(Exception, match="(?i)exists"):
        build.build(spark, str(tmp_path / "tracks.jsonl"), str(tmp_path / "out"), dimensions=8, k_max=12)
    with pytest.raises(ValueError):
        build.build(spark, "x", "y", k_min=5, k_max=4)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "k long, x double")
    sinks.write_csv_bom(df, str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("part-*.csv")).read_bytes().startswith("﻿".encode())
    assert sorted(sinks.read_csv(spark, str(tmp_path / "c"), "k long, x double").collect(), key=str) == sorted(df.collect(), key=str)
    assert sinks.json_text(df.where("k = 2")).first()[0] == '{"k":2,"x":null}'
    with pytest.raises(Exception, match="NaN"):
        sinks.json_text(spark.createDataFrame([(float("nan"),)], "x double")).collect()
    sinks.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        sinks.write_table(df, str(tmp_path / "t"))


def test_catalog_has_sql_for_all_but_solvers():
    rows_only = {n for n in catalog.QUERIES if n not in catalog.ORACLES}
    assert len(catalog.ORACLES) >= 65 and not any(n.startswith(("knn", "tag", "degree", "clustering")) for n in rows_only)


def test_threshold_above_four(spark, tmp_path):
    # twelve equal groups of eight equal vectors: none sees beyond its own before k = 8
    rows = [(8 * g + i, [float(g), float(g * g)], 0) for g in range(12) for i in range(8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.QUERIES["connectivity_threshold"](spark, str(tmp_path)).first().k_c >= 8


def test_comparison_has_every_k(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((80, 4))
    spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.k for r in catalog.QUERIES["comparison_by_k"](spark, str(tmp_path)).select("k").collect()} == {2, 3, 64}


def test_whole_tables(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    save("lineitem", [(1, 1, 50.0), (1, 2, 1.0), (2, 2, 1.0), (3, 3, 1.0)], "l_suppkey long, l_partkey long, l_quantity double")
    save("orders", [(k, 1, 1024.0 * (200 - k)) for k in range(62, 67)], "o_orderkey long, o_custkey long, o_totalprice double")
    save("customer", [(i, 0, 16384.0 * (9 if i == 14 else 1)) for i in range(1, 16)], "c_custkey long, c_nationkey long, c_acctbal double")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    one = run("copurchase_components_whole")[0]
    assert (one.n_nodes, one.n_components, one.largest_component_size) == (6, 2, 4)
    assert [(r.k, r.change) for r in run("fiedler_decreases_whole")] == [(k, -1.0) for k in range(62, 66)]
    assert {r.idx: r.right_gap for r in run("eigen_gaps_whole")} == {i: 9.0 if i == 13 else 1.0 for i in range(2, 15)}
    assert len(run("gap_selection_whole")) == 1
