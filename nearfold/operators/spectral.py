"""Low spectrum of the normalised Laplacian, nodal domains and cuts.

Graphs of up to DENSE nodes are solved densely, one task per graph, so a sweep over k runs side by side; larger ones by
Lanczos steps, in one task too, with restarts that keep the vectors few; lanczos() above ONE_TASK edges by products that are
joins.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut
from . import components as C
from .graph import adjacency, degrees

PAIRS, DENSE, SEED = 33, 5_000, 521
#: Largest residual of a pair that Lanczos steps give; entries of a vector that are too near 0 to have a sign, by the largest.
TOLERANCE, ROBUST = 1e-10, 1e-7


def _matrix(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, normalised Laplacian, strengths)."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a = np.zeros((len(ids), len(ids)))
    a[place[: len(u)], place[len(u) :]] = w
    a += a.T
    s = a.sum(axis=1)
    root = 1 / np.sqrt(s)
    return ids, np.eye(len(ids)) - a * root[:, None] * root[None], s


def _solve(u: np.ndarray, v: np.ndarray, w: np.ndarray, pairs: int, dense: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, ...]:
    """(nodes, values, vectors, residuals) of the smallest eigenpairs."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    if len(ids) <= dense:
        ids, lap, _ = _matrix(u, v, w)
        values, vectors = np.linalg.eigh(lap)
        values, vectors = values[:pairs], vectors[:, :pairs]
        return ids, values, vectors, np.linalg.norm(lap @ vectors - vectors * values, axis=0)
    n, a, b = len(ids), place[: len(u)], place[len(u) :]
    s = np.bincount(a, w, n) + np.bincount(b, w, n)
    m = w / np.sqrt(s[a] * s[b])

    def lap_of(x: np.ndarray) -> np.ndarray:
        return x - np.bincount(a, m * x[b], n) - np.bincount(b, m * x[a], n)

    values, vectors = _lowest(lap_of, n, min(pairs, n), tolerance)
    return ids, values, vectors, np.array([np.linalg.norm(lap_of(q) - x * q) for x, q in zip(values, vectors.T)])


def _lowest(product, n: int, pairs: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Smallest eigenpairs of a symmetric matrix given by its product, by Lanczos steps with thick restarts.

    One start never meets the second vector of an equal pair of values. So when all have converged a random direction is put
    in and the steps go on; they end when the same values converge again, with one pair more.
    """
    want, size = min(pairs + 1, n), min(n, 3 * pairs + 60)
    r = np.random.default_rng(SEED)
    basis, image = np.empty((n, size)), np.empty((n, size))
    held, settled, new = 0, None, r.standard_normal(n)
    while True:
        for j in range(held, size):
            before = np.linalg.norm(new)
            for _ in range(2):  # twice is enough
                new = new - basis[:, :j] @ (basis[:, :j].T @ new)
            if np.linalg.norm(new) <= 1e-12 * max(before, 1.0):  # an invariant subspace
                new = r.standard_normal(n)
                for _ in range(2):
                    new = new - basis[:, :j] @ (basis[:, :j].T @ new)
            basis[:, j] = new / np.linalg.norm(new)
            image[:, j] = new = product(basis[:, j])
        values, small = np.linalg.eigh((lambda h: (h + h.T) / 2)(basis.T @ image))
        few = small[:, :want]
        residual = np.linalg.norm(image @ few - (basis @ few) * values[:want], axis=0)
        if residual.max() <= tolerance:
            if size == n or settled is not None and np.abs(values[:pairs] - settled).max() <= 10 * tolerance:
                return values[:pairs], basis @ small[:, :pairs]
            settled, new = values[:pairs], r.standard_normal(n)
        for _ in range(2):  # of all directions so far, those that are dropped too
            new = new - basis @ (basis.T @ new)
        held = min(size - 1, want + (size - want) // 3)
        basis[:, :held], image[:, :held] = basis @ small[:, :held], image @ small[:, :held]


def spectrum(edges: DataFrame, pairs: int = PAIRS, dense: int = DENSE) -> DataFrame:
    """(graph, node, q array, values array, residuals array, orthogonality) of the smallest eigenpairs of each connected graph of
    ``edges`` (graph, u, v, w); all pairs of graphs of fewer nodes. Of each vector the entry of largest size is positive."""

    def run(table: pa.Table) -> pa.Table:
        graph = table.column("graph")[0].as_py()
        ids, values, vectors, residual = _solve(*(table.column(c).to_numpy() for c in ("u", "v", "w")), pairs, dense)
        top = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)
        orthogonality = float(np.abs(vectors.T @ vectors - np.eye(len(values))).max())
        n = len(ids)
        return pa.table(
            {
                "graph": pa.array([graph] * n, pa.int32()),
                "node": pa.array(ids, pa.int64()),
                "q": pa.array(list(vectors), pa.list_(pa.float64())),
                "values": pa.array([values.tolist()] * n, pa.list_(pa.float64())),
                "residuals": pa.array([residual.tolist()] * n, pa.list_(pa.float64())),
                "orthogonality": pa.array([orthogonality] * n),
            }
        )

    schema = "graph int, node long, q array<double>, values array<double>, residuals array<double>, orthogonality double"
    return edges.select(F.col("graph").cast("int").alias("graph"), "u", "v", "w").groupBy("graph").applyInArrow(run, schema)


def eigenvalues(solved: DataFrame) -> DataFrame:
    """(graph, idx from 1, value, residual, orthogonality) of spectrum()."""
    one = solved.groupBy("graph").agg(F.first(F.struct("values", "residuals", "orthogonality")).alias("s"))
    z = F.arrays_zip(F.col("s.values").alias("value"), F.col("s.residuals").alias("residual"))
    return one.select("graph", F.posexplode(z).alias("i", "x"), F.col("s.orthogonality").alias("orthogonality")).select("graph", (F.col("i") + 1).alias("idx"), "x.value", "x.residual", "orthogonality")


def sanity(solved: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, first, second, in_range, cosine): the first eigenvalue is 0, the second is not, all lie in [0, 2], and the first
    vector is along the roots of the strengths (cosine 1)."""
    e = eigenvalues(solved).groupBy("graph").agg(F.min("value").alias("first"), F.min(F.when(F.col("idx") == 2, F.col("value"))).alias("second"), F.bool_and(F.col("value").between(-1e-9, 2 + 1e-9)).alias("in_range"))
    both = edges.select("graph", "u", "v", "w").unionAll(edges.select("graph", "v", "u", "w")).groupBy("graph", F.col("u").alias("node")).agg(F.sum("w").alias("s"))
    c = solved.join(both, ["graph", "node"]).groupBy("graph").agg((F.abs(F.sum(F.get("q", F.lit(0)) * F.sqrt("s"))) / F.sqrt(F.sum("s"))).alias("cosine"))
    return e.join(c, "graph")


def lanczos(edges: DataFrame, steps: int | None = None, pairs: int = 2, seed: int = SEED, tolerance: float = 1e-8, one_task: int = C.ONE_TASK) -> DataFrame:
    """(idx, value, residual) of the smallest eigenpairs of one connected graph, for any number of nodes: steps until all residuals
    are at most ``tolerance``, or exactly ``steps`` of them, whose residuals may be larger.

    Lanczos steps for 2 I - L, whose largest eigenvalues these are. A product is a join and a sum; the vectors so far are an
    array beside each node, so orthogonalising against all of them is one more sum. ``residual`` is the usual bound, the last
    off-diagonal times the last entry of the small matrix's vector. Up to ``one_task`` edges one task takes all the steps.
    """
    if steps is None and edges.limit(one_task + 1).count() <= one_task:

        def run(table: pa.Table) -> pa.Table:
            _, values, _, residuals = _solve(*(table.column(c).to_numpy() for c in ("u", "v", "w")), pairs, 0, tolerance)
            return pa.table({"idx": pa.array(range(1, len(values) + 1), pa.int32()), "value": values, "residual": residuals})

        return edges.select("u", "v", "w", F.lit(0).alias("all")).groupBy("all").applyInArrow(lambda t: run(t), "idx int, value double, residual double")
    s = degrees(edges).select("node", "strength")
    link = adjacency(edges).join(s.select(F.col("node").alias("src"), F.col("strength").alias("s1")), "src").join(s.select(F.col("node").alias("dst"), F.col("strength").alias("s2")), "dst")
    link = cut(link.select("src", "dst", (F.col("w") / F.sqrt(F.col("s1") * F.col("s2"))).alias("m")))
    start = s.select("node", (F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5).alias("x"))
    norm = start.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
    basis = cut(start.select("node", F.array(F.col("x") / norm).alias("h")))
    alpha: list[float] = []
    beta: list[float] = []
    for j in count() if steps is None else range(steps):
        last = basis.select(F.col("node").alias("dst"), F.element_at("h", -1).alias("x"))
        product = link.join(last, "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("m") * F.col("x")).alias("p"))
        w = basis.join(product, "node", "left").select("node", "h", (F.element_at("h", -1) + F.coalesce("p", F.lit(0.0))).alias("y"))
        for again in range(2):  # twice is enough
            dots = {r["i"]: r["d"] for r in w.select(F.posexplode("h").alias("i", "x"), "y").groupBy("i").agg(F.sum(F.col("x") * F.col("y")).alias("d")).collect()}  # j + 1 numbers
            if not again:
                alpha.append(dots[j])
            c = F.array(*(F.lit(float(dots[i])) for i in range(j + 1)))
            w = w.select("node", "h", (F.col("y") - F.aggregate(F.zip_with("h", c, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)).alias("y"))
        w = cut(w)
        size = float(w.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0])
        beta.append(size)
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
        if size < 1e-10 or steps is None and j + 1 >= pairs and size * np.abs(vectors[-1, -pairs:]).max() <= tolerance:
            break
        basis = cut(w.select("node", F.concat("h", F.array(F.col("y") / size)).alias("h")))
    rows = [(k + 1, float(2 - values[-1 - k]), float(beta[-1] * abs(vectors[-1, -1 - k]))) for k in range(min(pairs, len(values)))]
    return edges.sparkSession.createDataFrame(rows, "idx int, value double, residual double")


def gaps(values: DataFrame, floor: float = 0.0) -> DataFrame:
    """(graph, idx, value, left_gap, right_gap, isolation, relative) for idx with both neighbours; relative is to
    max(value, floor)."""
    w = Window.partitionBy("graph").orderBy("idx")
    g = values.select("graph", "idx", "value", (F.col("value") - F.lag("value").over(w)).alias("left_gap"), (F.lead("value").over(w) - F.col("value")).alias("right_gap"))
    g = g.where("left_gap is not null and right_gap is not null").withColumn("isolation", F.least("left_gap", "right_gap"))
    return g.withColumn("relative", F.col("isolation") / F.greatest(F.abs("value"), F.lit(floor)))


def select_most_isolated(gaps: DataFrame) -> DataFrame:
    """(graph, selected): the eigenvalue farthest from its neighbours; of equal ones the first."""
    return gaps.groupBy("graph").agg(F.max_by("idx", F.struct(F.col("isolation"), -F.col("idx"))).alias("selected"))


def qualified(gaps: DataFrame, residual: Column | float) -> DataFrame:
    """``gaps`` with ``qualified``: value and gaps above max(1e-8, 10 residuals), isolation 1e-3, relative isolation 0.05."""
    limit = F.greatest(F.lit(1e-8), (F.lit(residual) if isinstance(residual, float) else residual) * 10)
    good = (F.least("value", "left_gap", "right_gap") > limit) & (F.col("isolation") >= 1e-3) & (F.col("relative") >= 0.05)
    return gaps.withColumn("qualified", good)


def select_qualified(candidates: DataFrame) -> DataFrame:
    """(graph, selected, status): the second if it is qualified, else the most isolated that is, else none."""
    pick = F.max_by(F.when(F.col("qualified"), F.col("idx")), F.when(F.col("qualified"), F.struct(F.col("isolation"), -F.col("idx"))))
    second = F.coalesce(F.bool_or((F.col("idx") == 2) & F.col("qualified")), F.lit(False))
    s = candidates.groupBy("graph").agg(second.alias("second"), pick.alias("other"))
    status = F.when(F.col("second"), "second").when(F.col("other").isNotNull(), "later").otherwise("none")
    return s.select("graph", F.when(F.col("second"), F.lit(2)).otherwise(F.col("other")).cast("int").alias("selected"), status.alias("status"))


def embedding(solved: DataFrame, selected: int = 2) -> DataFrame:
    """(graph, node, x, y, z): the selected vector and the first two others of the second to fourth."""
    rest = [i for i in (2, 3, 4) if i != selected][:2]
    return solved.select("graph", "node", *(F.get("q", F.lit(i - 1)).alias(c) for c, i in zip("xyz", (selected, *rest))))


def subspace_residual(solved: DataFrame, first: int = 2, count: int = 3) -> DataFrame:
    """(graph, residual): Frobenius norm of L Q - Q diag(values) over the coordinates, from the residuals of the pairs."""
    part = F.slice("residuals", first, count)
    return solved.groupBy("graph").agg(F.first(F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, r: a + r * r))).alias("residual"))


def nodal_domains(edges: DataFrame, vector: DataFrame, tolerance: float = 1e-10, signs_first: bool = True) -> DataFrame:
    """(node, sign, domain): components of the graphs that the nodes of one sign of ``vector`` (node, q) induce.

    Entries within tolerance of 0, relative to the largest, are the boundary, domain -1. With ``signs_first`` they are an error,
    and so are those within ROBUST: the domains must not depend on where zero ends.
    Domains are numbered from 1: by sign (negative first), size downwards and smallest node, or without the sign.
    """
    largest = vector.agg(F.max(F.abs("q")).alias("most"))
    zero = F.abs("q") <= F.col("most") * (max(tolerance, ROBUST) if signs_first else tolerance)
    sign = F.when(zero, F.raise_error(F.lit("an entry of the vector is zero")).cast("int") if signs_first else F.lit(0)).otherwise(F.signum("q").cast("int"))
    signed = cut(vector.crossJoin(F.broadcast(largest)).select("node", sign.alias("sign")))  # one row
    inner = signed.where("sign <> 0")
    u, v = (inner.select(F.col("node").alias(c), F.col("sign").alias(f"s{c}")) for c in "uv")
    same = edges.join(u, "u").join(v, "v").where("su = sv").select("u", "v")
    labels = C.components(same, inner).join(inner, "node")
    order = [F.desc("size"), F.col("label")]
    number = labels.groupBy("label", "sign").agg(F.count(F.lit(1)).alias("size"))
    number = number.withColumn("domain", F.row_number().over(Window.orderBy(*([F.col("sign"), *order] if signs_first else order)))).select("label", "domain")
    found = labels.join(number, "label").select("node", "sign", "domain")
    return found.unionByName(signed.where("sign = 0").select("node", "sign", F.lit(-1).alias("domain")))


def fiedler_sweep(births: DataFrame, nodes: DataFrame, k_min: int, k_max: int, dense: int = 0) -> DataFrame:
    """(k, components, lambda2, residual) for each k, from (u, v, birth, w): the second eigenvalue of the whole graph if it is
    connected, else 0 without a residual. One task per k; two pairs take few Lanczos steps, whatever the number of nodes."""
    n = nodes.count()
    ks = births.sparkSession.range(k_min, k_max + 1).select(F.col("id").cast("int").alias("k"))
    dealt = births.join(F.broadcast(ks), F.col("birth") <= F.col("k")).select("k", "u", "v", "w")  # k_max rows

    def run(table: pa.Table) -> pa.Table:
        u, v, w = (table.column(c).to_numpy() for c in ("u", "v", "w"))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = C._roots(place[: len(u)], place[len(u) :], len(ids))
        parts = len(np.unique(label)) + n - len(ids)
        value, residual = 0.0, None
        if parts == 1:
            _, values, _, residuals = _solve(u, v, w, 2, dense)
            value, residual = float(values[1]), float(residuals[1])
        return pa.table({"k": table.column("k").slice(0, 1), "components": pa.array([parts], pa.int64()), "lambda2": pa.array([value]), "residual": pa.array([residual], pa.float64())})

    return dealt.groupBy("k").applyInArrow(run, "k int, components long, lambda2 double, residual double")


def decreases(curve: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(k, next_k, change) where lambda2 falls from one connected k to the next."""
    w = Window.orderBy("k")
    c = curve.where("components = 1").select("k", F.lead("k").over(w).alias("next_k"), (F.lead("lambda2").over(w) - F.col("lambda2")).alias("change"))
    return c.where(F.col("change") < -tolerance)


def cut_metrics(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """One row: crossing edges and weight, and the normalised cut, the sum over domains (node, domain) of crossing weight by
    volume. Edges to the boundary, -1, cross; with a boundary there is no normalised cut."""
    u, v = (domains.select(F.col("node").alias(c), F.col("domain").alias(f"d{c}")) for c in "uv")
    e = edges.join(u, "u").join(v, "v")
    crossing = (F.col("du") != F.col("dv")) | (F.col("du") == -1) | (F.col("dv") == -1)
    one = e.agg(F.count_if(crossing).alias("crossing_edges"), F.coalesce(F.sum(F.when(crossing, F.col("w"))), F.lit(0.0)).alias("crossing_weight"))
    ends = e.select(F.col("du").alias("domain"), "w", crossing.alias("x")).unionAll(e.select("dv", "w", crossing))
    per = ends.groupBy("domain").agg(F.sum("w").alias("volume"), F.coalesce(F.sum(F.when(F.col("x"), F.col("w"))), F.lit(0.0)).alias("cut"))
    ncut = per.agg(F.when(F.min("domain") > -1, F.sum(F.col("cut") / F.col("volume"))).alias("normalized_cut"))
    return one.crossJoin(ncut)  # one row and one row
