"""Exact Euclidean nearest neighbours and Gaussian weights.

Rows are dealt into blocks and, as candidates, into larger stripes; every block and stripe is one group, whose numpy kernel keeps
the nearest k of each row of the block: products in single precision say which can be among them, exact distances decide. Rows
travel as packed arrays. Groups have about ASKS + STRIPE rows whatever the table's size; where there are several stripes, their
partial lists are merged by a window. Neighbours are computed once, at the largest k, and every smaller graph is a filter on the rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import written
from .leiden_arrays import order_of

#: Largest k, rank of the distance that gives the bandwidth.
K_MAX, BANDWIDTH_RANK = 64, 10
#: Rows of a block about at most and, as long as there are not PARTS blocks, at least; rows of a block that asks a stripe, and of a
#: stripe.
BLOCK, LEAST_BLOCK, PARTS, ASKS, STRIPE = 8192, 256, 8, 4096, 131072
#: Pairs whose exact distance a kernel works out at a time; rows and candidates that it holds against each other at a time.
EXACT, ROWS, TILE = 1 << 16, 512, 1024
#: Groups of a kernel are dealt into so many partitions at most.
MOST_PARTS = 512


def check_k(k: int, n: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int):
        raise ValueError("k must be an integer")
    if n <= BANDWIDTH_RANK:
        raise ValueError(f"more than {BANDWIDTH_RANK} rows are needed")
    if not 1 <= k < n:
        raise ValueError("k must be at least 1 and less than the number of rows")


def _blocks(n: int, most: int | None = None) -> int:
    return max(ceil(n / (most or BLOCK)), min(PARTS, ceil(n / LEAST_BLOCK)))


def _by_group(rows: DataFrame, groups: int, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run() of the rows of each ``group`` from 0 to groups - 1. Up to MOST_PARTS groups are a partition each, where a hash would put
    several into one; above, partitions are in the order of their groups. Rows come in small batches."""
    parts = min(MOST_PARTS, groups)
    dealt = rows.repartitionById(parts, F.col("group") % parts)
    dealt = dealt.sortWithinPartitions("group") if groups > parts else dealt

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("group").to_numpy()
            ends = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for lo, hi in zip([0, *ends], ends):
                if held and lo < hi and held[-1].column("group")[0].as_py() != group[lo]:
                    yield from run(pa.Table.from_batches(held)).to_batches()
                    held = []
                held += [batch.slice(lo, hi - lo)] if lo < hi else []
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return dealt.mapInArrow(each, schema)


def _groups(n: int) -> int:
    return _blocks(n) * (_blocks(n) + 1) // 2


def _dealt(features: DataFrame, n: int) -> DataFrame:
    """(node, f, mine, x, y, group): every row in the groups x <= y of its block and each block."""
    blocks = _blocks(n)
    mine = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = features.select("node", "f", mine.alias("mine"), other.alias("other"))
    rows = rows.select("node", "f", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    return rows.withColumn("group", F.expr(f"x * (2 * {blocks} - x - 1) div 2 + y").cast("int"))


Side = tuple[np.ndarray, np.ndarray]


def _sides(table: pa.Table) -> tuple[list[int], list[Side]]:
    """The one or two values of ``mine`` in a group, in order, and (nodes in order, vectors) of each."""
    node, mine = table.column("node").to_numpy(), table.column("mine").to_numpy()
    flat = table.column("f").combine_chunks()
    f = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(node), -1)
    order = np.argsort(node, kind="stable")
    node, f, mine = node[order], f[order], mine[order]
    names = np.unique(mine).tolist()
    return names, [(node[mine == b], f[mine == b]) for b in names]


def _exact(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(r))
    for lo in range(0, len(r), EXACT):
        part = slice(lo, lo + EXACT)
        out[part] = np.sqrt(((a[r[part]] - b[c[part]]) ** 2).sum(axis=1))
    return out


def _first(x: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, c, dist) of the nearest k of the candidates of each row, exactly; those of a row are in the order of ``j``, which rises."""
    dist = _exact(x, b, r, c)
    order = np.argsort(dist, kind="stable")
    order = order[order_of(r[order], len(x))]
    r, c, dist = r[order], c[order], dist[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(x)))[r] < k
    return r[keep], c[keep], dist[keep]


def _slack(width: int) -> float:
    """Of single-precision products of rows of ``width``, or their squares: the error, as a share of the sum of both squares."""
    return (width + 16) * 2.0**-23


def _nearest(one: Side, other: Side, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, dist) of the nearest k of ``other`` for each of ``one``, by distance and then node.

    Squares by a matrix product in single precision, between two limits that rounding can't pass, say which can be among them; of
    those the exact distances decide. Tile after tile of ``other``, only what may be as near as the k nearest so far is kept."""
    (i, a), (j, b) = one, other
    i, a, j, b = i[own := np.isfinite((a * a).sum(axis=1))], a[own], j[own := np.isfinite((b * b).sum(axis=1))], b[own]
    if not len(i) or not len(j):
        return
    middle = b.mean(axis=0)
    far = max(float(((x - middle) ** 2).sum(axis=1).max()) for x in (a, b))
    unit = np.sqrt(far) if far > 0 else 1.0
    # what the move to the middle rounds, and what is too small for single precision
    loose = 1e-13 * max(float((x * x).sum(axis=1).max()) for x in (a, b)) / unit**2 + 1e-30
    k, slack = min(k, len(j)), _slack(b.shape[1])
    held = (b - middle) / unit
    size = (held * held).sum(axis=1)
    held = np.column_stack([held, size * (1 - slack)]).astype(np.float32)
    for lo in range(0, len(i), ROWS):
        x, mine = a[lo : lo + ROWS], i[lo : lo + ROWS]
        asks = (x - middle) / unit
        own = (asks * asks).sum(axis=1)
        asks = np.column_stack([-2 * asks, np.ones(len(x))]).astype(np.float32)
        most = np.full(len(x), np.inf)
        kept, new, before = [], 0, 0  # (row, place in other, the least and the most that the square can be)
        for at in range(0, len(j), TILE):
            names = j[at : at + TILE]
            near = asks @ held[at : at + TILE].T
            if at == 0 and len(names) > k:
                above = near + (2 * slack * size[: len(names)]).astype(np.float32)
                for row in np.flatnonzero(np.searchsorted(names, mine) < np.searchsorted(names, mine, "right")):
                    above[row, names == mine[row]] = np.inf  # not its own neighbour
                most = np.partition(above, k - 1, axis=1)[:, k - 1] + own * (1 + slack) + loose + 1e-6
            flat = np.flatnonzero(near <= np.nextafter((most - own * (1 - slack)).astype(np.float32), np.float32(np.inf))[:, None])
            row, col = np.divmod(flat, len(names))
            real = names[col] != mine[row]
            row, col, least = row[real], col[real], near.ravel()[flat[real]].astype(float)
            least += own[row] * (1 - slack) - loose
            kept.append((row, at + col, least, least + 2 * slack * (own[row] + size[at + col]) + 2 * loose))
            new += len(row)
            if new <= 0.25 * before:
                continue
            r, c, least, up = (np.concatenate(part) for part in zip(*kept))
            if len(r) > 8 * k * len(x):  # many equal ones
                r, c, up = _first(x, b, r, c, k)
                up = (up / unit) ** 2
                least, up = up * (1 - 1e-12), up * (1 + 1e-12)
            # the most of the k-th of each row: rows and bits of single numbers not below it, sorted as one number
            key = np.nextafter(np.maximum(up, 0).astype(np.float32), np.float32(np.inf)).view(np.int32) + (r << 32)
            key.sort()
            count = np.bincount(r, minlength=len(x))
            full = count >= k
            last = key[(np.cumsum(count) - count + k - 1)[full]] & 0xFFFFFFFF
            most[full] = np.minimum(most[full], last.astype(np.int32).view(np.float32))
            stay = least <= most[r]
            kept = [(r[stay], c[stay], least[stay], up[stay])]
            new, before = 0, int(np.count_nonzero(stay))
        r, c = (np.concatenate(part) for part in list(zip(*kept))[:2])
        r, c, dist = _first(x, b, r, c, k)
        yield mine[r], j[c], dist


_PACK = "side int, at int, node binary, f binary, single boolean"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, at, node, f, single): of the rows (node, f, x, y) of a batch, those of each x as side 0, of each y as side 1, as bytes; in
    single precision where that holds them exactly."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        node, flat = batch.column("node").to_numpy().astype(np.int64, copy=False), batch.column("f").flatten()
        f = np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(n, -1)
        with np.errstate(over="ignore"):
            short = f.astype(np.float32)
        single = bool((short == f).all())
        f = short if single else f
        out = []
        for side, name in enumerate("xy"):
            at = batch.column(name).to_numpy()
            order = np.argsort(at, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(at[order])) + 1, n).tolist()
            out += [(side, int(at[own[0]]), node[own].tobytes(), f[own].tobytes(), single) for own in (order[lo:hi] for lo, hi in zip([0, *ends], ends))]
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["side", "at", "node", "f", "single"])


def _unpacked(table: pa.Table) -> dict[int, Side]:
    """(nodes in order, vectors) of each side that _packs() made."""
    parts: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    plain = (table.column(c).to_pylist() for c in ("side", "single"))
    for side, single, node, f in zip(*plain, *([x.as_buffer() for x in table.column(c)] for c in ("node", "f"))):
        nodes, vectors = parts.setdefault(side, ([], []))
        nodes.append(np.frombuffer(node, np.int64))
        vectors.append(np.frombuffer(f, np.float32 if single else np.float64).reshape(len(nodes[-1]), -1))
    out = {}
    for side, (nodes, vectors) in parts.items():
        node = np.concatenate(nodes)
        order = np.argsort(node, kind="stable")
        out[side] = node[order], np.concatenate(vectors)[order].astype(float, copy=False)
    return out


def neighbors(features: DataFrame, k_max: int = K_MAX) -> DataFrame:
    """(i, j, rank, dist): the max(k_max, 10) nearest others of every node, by distance and then node. Equal vectors of other
    nodes stay, at distance 0."""
    n = features.count()
    check_k(k_max, n)
    k = min(n - 1, max(k_max, BANDWIDTH_RANK))
    blocks, stripes = _blocks(n, ASKS), ceil(n / STRIPE)

    def run(table: pa.Table) -> pa.Table:
        sides = _unpacked(table)
        del table
        out = list(_nearest(sides[0], sides[1], k)) if len(sides) == 2 else []
        i, j, dist = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if 0 in sides and (np.diff(sides[0][0]) == 0).any():  # one list of rows that share an id
            order = np.lexsort((j, dist, i))
            i, j, dist = i[order], j[order], dist[order]
        first = np.flatnonzero(np.diff(i, prepend=i[:1] - 1))  # a node's are in order
        rank = np.arange(1, len(i) + 1) - np.repeat(first, np.diff(first, append=len(i)))
        return pa.table({"i": i, "j": j, "rank": rank.astype(np.int32), "dist": dist}).filter(pa.array(rank <= k))

    x, y = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(stripes)).cast("int")
    packs = features.select("node", "f", x.alias("x"), y.alias("y")).mapInArrow(_packs, _PACK)
    asks, last = F.col("side") == 0, F.when(F.col("side") == 0, stripes).otherwise(blocks) - 1
    dealt = packs.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    group = F.when(asks, F.col("at") * stripes + F.col("other")).otherwise(F.col("other") * stripes + F.col("at"))
    partial = _by_group(dealt.select("side", "node", "f", "single", group.alias("group")), blocks * stripes, run, "i long, j long, rank int, dist double")
    if stripes == 1:
        return partial
    rank = F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))
    return partial.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def _tiles(table: pa.Table, more: Callable[[np.ndarray], tuple] = lambda a: ()) -> Iterator[tuple[tuple, tuple, np.ndarray | None]]:
    """Pairs of a group i < j, or of its two blocks, tile by tile: two sides, with what ``more`` makes of their vectors, and the places
    that count where not all do."""
    sides = [(i, a, *more(a)) for i, a in _sides(table)[1]]
    same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
    for one, other in [(sides[0], sides[0])] if same else [(sides[0], sides[1])] if len(sides) > 1 else []:
        for lo in range(0, len(one[0]), ROWS):
            for at in range(lo // TILE * TILE if same else 0, len(other[0]), TILE):
                u, v = tuple(x[lo : lo + ROWS] for x in one), tuple(x[at : at + TILE] for x in other)
                yield u, v, u[0][:, None] < v[0] if same and at < lo + ROWS else None


def pairs(features: DataFrame) -> DataFrame:
    """(i, j, dist) of all i < j: for statistics of small tables; nothing keeps it."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for (i, a), (j, b), count in _tiles(table):
            r, c = np.nonzero(np.ones((len(i), len(j)), bool) if count is None else count)
            out.append((np.minimum(i[r], j[c]), np.maximum(i[r], j[c]), _exact(a, b, r, c)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"i": cols[0], "j": cols[1], "dist": cols[2]})

    n = features.count()
    return _by_group(_dealt(features, n), _groups(n), run, "i long, j long, dist double")


#: Bins of squared distances between two limits; pairs between two limits whose exact distances are written, as values and counts.
BINS, FEW = 1 << 16, 1 << 23


def _summed(rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """(k, at, n) of (k, values, counts), added up."""
    k, at, n = zip(*((np.full(len(v), k, np.int32), v, c) for k, v, c in rows))
    sums = pa.table({"k": np.concatenate(k), "at": np.concatenate(at).astype(np.int64), "n": np.concatenate(n).astype(np.int64)})
    return sums.group_by(["k", "at"]).aggregate([("n", "sum")]).select(["k", "at", "n_sum"]).rename_columns(["k", "at", "n"])


Range = tuple[tuple[float, float], list[int]]  # two limits, the places between them
Totals = tuple[np.ndarray, np.ndarray, np.ndarray]  # number of the range; bin or bits, -1 for what lies below the range; pairs


def order_statistics(features: DataFrame, places: list[int]) -> list[float]:
    """Of the distances of all pairs in rising order, those at ``places`` (from 0), exactly; no pair is ever a row.

    Squares by a matrix product, first in single precision, are counted in bins. They are off by less than a slack, and so is each
    of their order statistics, so a wanted one is within 4 times that of the bin of its place. If that range holds up to FEW pairs,
    their exact distances are written, as values and counts, and searched by 16 of their 64 bits at a time. Else the range is
    binned anew in double precision, until it holds few or bins are as narrow as the slack; in the latter case the distances are
    worked out anew for each 16 bits. Every pass counts anew what lies below a range."""
    n = features.count()
    dealt = _dealt(features, n)
    square = F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x)
    far, wide = features.agg(F.max(square), F.max(F.size("f"))).first()
    if not np.isfinite(far):
        raise ValueError("a feature is not finite")
    slack = max(4 * far * (wide + 16) * 2.0**-50, 1e-300)

    def of_batches(f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column("f").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([pa.array([f(x).tolist()])], names=["v"])

        return np.array([r["v"] for r in features.select("f").mapInArrow(run, "v array<double>").collect()])  # a row per batch

    # single precision: squares of vectors from the middle, in units of the largest
    middle = of_batches(lambda x: x.sum(axis=0)).sum(axis=0) / n
    unit = float(of_batches(lambda x: ((x - middle) ** 2).sum(axis=1).max(keepdims=True)).max()) or 1.0
    loose = 2 * _slack(wide) + slack / unit + 1e-30

    def scaled(lo: float, scale: float) -> Callable[[np.ndarray], tuple]:
        """For sides whose product is the squares in units, less ``lo`` and times ``scale``."""

        def more(a: np.ndarray) -> tuple:
            m = (a - middle) / np.sqrt(unit)
            own, one = (m * m).sum(axis=1), np.ones(len(m))
            return (np.column_stack([-2 * m, own - lo, one]) * scale).astype(np.float32), np.column_stack([m, one, own]).astype(np.float32)

        return more

    def single(one: tuple, other: tuple) -> np.ndarray:
        return one[2] @ other[3].T

    def double(one: tuple, other: tuple) -> np.ndarray:
        a, b = one[1], other[1]
        d = a @ b.T
        d *= -2
        d += (b * b).sum(axis=1)
        d += (a * a).sum(axis=1)[:, None]
        return d

    def counted(d: np.ndarray, count: np.ndarray | None) -> np.ndarray:
        if count is not None:
            d[~count] = np.nan
        return d

    def added(rows: DataFrame) -> Totals:
        """Sums over all tasks, by bin or bits."""
        sums = rows.groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
        k, at, count = (sums.column(c).to_numpy() for c in ("k", "at", "n"))
        order = np.argsort(at)
        return k[order], at[order], count[order]

    def passed(run: Callable[[pa.Table], pa.Table]) -> Totals:
        return added(_by_group(dealt, _groups(n), run, "k int, at long, n long"))

    def all_binned(lo: float, hi: float) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            total = np.zeros(BINS, np.int64)
            for one, other, count in _tiles(table, scaled(lo, BINS / (hi - lo))):
                d = single(one, other)
                place = (d if count is None else d[count]).astype(np.int64).ravel()
                total += np.bincount(np.clip(place, 0, BINS - 1, out=place), minlength=BINS)
            b = np.flatnonzero(total)
            return _summed([(0, b, total[b])])

        return run

    def binned(limits: list[tuple[float, float]]) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            total, below = np.zeros((len(limits), BINS), np.int64), [0] * len(limits)
            for one, other, count in _tiles(table):
                d = counted(double(one, other), count)
                for k, (lo, hi) in enumerate(limits):
                    place = ((d[(d >= lo) & (d < hi)] - lo) * (BINS / (hi - lo))).astype(np.int64)
                    total[k] += np.bincount(np.clip(place, 0, BINS - 1, out=place), minlength=BINS)
                    below[k] += int(np.count_nonzero(d < lo))
            rows = [(k, np.flatnonzero(t), t[t > 0]) for k, t in enumerate(total)]
            return _summed(rows + [(k, np.array([-1]), np.array([b])) for k, b in enumerate(below)])

        return run

    def exact(limits: list[tuple[float, float]], squares: Callable, more: Callable[[np.ndarray], tuple], use: Callable) -> Callable[[pa.Table], pa.Table]:
        """use(values, counts of the bits of the distances between each two limits, pairs below) of each group."""

        def run(table: pa.Table) -> pa.Table:
            found, below = [[np.empty(0, np.int64)] for _ in limits], [0] * len(limits)
            times = [[np.empty(0, np.int64)] for _ in limits]
            for one, other, count in _tiles(table, more):
                d = counted(squares(one, other), count)
                for k, (lo, hi) in enumerate(limits):
                    less, upto = d < lo, d < hi
                    few = int(np.count_nonzero(less))
                    below[k] += few
                    if np.count_nonzero(upto) > few:
                        r, c = np.divmod(np.flatnonzero(less ^ upto), d.shape[1])
                        for x, v in zip((found, times), np.unique(_exact(one[1], other[1], r, c).view(np.int64), return_counts=True)):
                            x[k].append(v)
            return use([_summed([(0, np.concatenate(v), np.concatenate(c))]) for v, c in zip(found, times)], below)

        return run

    def written_out(found: list[pa.Table], below: list[int]) -> pa.Table:
        cols = [[x.column(c).to_numpy().tobytes() for x in found] for c in ("at", "n")]
        return pa.table({"k": pa.array(range(len(found)), pa.int32()), "below": pa.array(below, pa.int64()), "at": pa.array(cols[0], pa.binary()), "n": pa.array(cols[1], pa.binary())})

    def cut_to(x: pa.Table, k: int, shift: int, known: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
        bits, count = x.column("at").to_numpy() >> shift, x.column("n").to_numpy()
        own = np.isin(bits >> 16, known[k])
        return k, bits[own], count[own]

    def by_digits(some: list[Range], below: np.ndarray, digits: Callable[[int, list[np.ndarray]], Totals]) -> dict[int, float]:
        at = {(k, p): (0, p - int(below[k])) for k, (_, own) in enumerate(some) for p in own}  # bits so far, place among those that share them
        for shift in (48, 32, 16, 0):
            which, bits, count = digits(shift, [np.unique([at[k, p][0] for p in own]) for k, (_, own) in enumerate(some)])
            for (k, p), (prefix, place) in at.items():
                own = (which == k) & (bits >> 16 == prefix) & (bits >= 0)
                upto = np.cumsum(count[own])
                b = int(np.searchsorted(upto, place, "right"))
                at[k, p] = (int(bits[own][b]), place - int(upto[b] - count[own][b]))
        return {p: float(np.int64(bits).view(np.float64)) for (_, p), (bits, _) in at.items()}

    def of_few(some: list[Range], squares: Callable, more: Callable[[np.ndarray], tuple]) -> dict[int, float]:
        run = exact([x[0] for x in some], squares, more, written_out)
        table = written(_by_group(dealt, _groups(n), run, "k int, below long, at binary, n binary"))
        below = np.zeros(len(some), np.int64)
        for r in table.groupBy("k").agg(F.sum("below").alias("n")).collect():  # a row per range
            below[r["k"]] = r["n"]

        def digits(shift: int, known: list[np.ndarray]) -> Totals:
            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k, at, count in zip(*(batch.column(c).to_pylist() for c in ("k", "at", "n"))):
                        x = pa.table({"at": np.frombuffer(at, np.int64), "n": np.frombuffer(count, np.int64)})
                        yield from _summed([cut_to(x, k, shift, known)]).to_batches()

            return added(table.select("k", "at", "n").mapInArrow(each, "k int, at long, n long"))

        return by_digits(some, below, digits)

    def of_many(some: list[Range]) -> dict[int, float]:
        def digits(shift: int, known: list[np.ndarray]) -> Totals:
            def use(found: list[pa.Table], below: list[int]) -> pa.Table:
                rows = [cut_to(x, k, shift, known) for k, x in enumerate(found)]
                return _summed(rows + [(k, np.array([-1]), np.array([b])) for k, b in enumerate(below)])

            return passed(exact([x[0] for x in some], double, lambda a: (), use))

        low = digits(48, [np.zeros(1, np.int64)] * len(some))
        below = np.array([low[2][(low[0] == k) & (low[1] < 0)].sum() for k in range(len(some))])
        return by_digits(some, below, lambda shift, known: low if shift == 48 else digits(shift, known))

    def narrowed(ranges: list[Range], sums: Totals, slack: float) -> Iterator[tuple[Range, int]]:
        """(range, pairs in it) for the places of ``ranges``."""
        which, bins, count = sums
        narrower: dict[tuple[float, float], tuple[list[int], int]] = {}
        for k, ((lo, hi), own_places) in enumerate(ranges):
            own = which == k
            total = np.zeros(BINS + 1, np.int64)
            total[bins[own] + 1] = count[own]
            upto, step = np.cumsum(total), (hi - lo) / BINS  # upto[b]: pairs before bin b
            side = max(1, ceil(4 * slack / step))
            for p in own_places:
                at = int(np.searchsorted(upto, p, "right")) - 1
                first, last = max(0, at - side), min(BINS, at + side + 1)
                key = (lo + first * step, lo + last * step if last < BINS else hi)
                narrower.setdefault(key, ([], int(upto[last] - upto[first])))[0].append(p)
        for key, (own_places, inside) in narrower.items():
            yield (key, own_places), inside

    whole = ((-8 * loose, 4 + 16 * loose), list(places))
    found: dict[int, float] = {}
    few, left = [], []
    for x, inside in narrowed([whole], passed(all_binned(*whole[0])), loose):
        if inside <= FEW:
            few.append(x)
        else:
            left.append(((max(x[0][0] * unit, -2 * slack), min(x[0][1] * unit, 4 * far + 8 * slack)), x[1]))
    found |= of_few(few, single, scaled(0.0, 1.0)) if few else {}
    few, many = [], []
    while left:
        ranges, left = left, []
        for x, inside in narrowed(ranges, passed(binned([r[0] for r in ranges])), slack):
            (few if inside <= FEW else many if (x[0][1] - x[0][0]) / BINS < 4 * slack else left).append(x)
    found |= of_few(few, double, lambda a: ()) if few else {}
    found |= of_many(many) if many else {}
    return [found[p] for p in places]


QUARTERS = (0.0, 0.25, 0.5, 0.75, 1.0)


def pair_quantiles(features: DataFrame, sigma: float | None = None) -> DataFrame:
    """(n, q0, q25, q50, q75, q100) of the distances of all pairs, or with ``sigma`` of their similarities, by linear
    interpolation. A similarity falls with the distance, so its ranks are those of distances from the end."""
    n = features.count()
    n = n * (n - 1) // 2
    if not n:
        return features.sparkSession.createDataFrame([(0, *[None] * 5)], "n long, q0 double, q25 double, q50 double, q75 double, q100 double")
    ends = [(int(np.floor(q * (n - 1))), int(np.ceil(q * (n - 1)))) for q in QUARTERS]
    place = (lambda p: p) if sigma is None else (lambda p: n - 1 - p)
    wanted = sorted({place(p) for e in ends for p in e})
    dist = dict(zip(wanted, order_statistics(features, wanted)))
    value = lambda p: dist[place(p)] if sigma is None else float(np.exp(-0.5 * (dist[place(p)] / sigma) ** 2))
    row = [value(a) + (value(b) - value(a)) * (q * (n - 1) - a) for q, (a, b) in zip(QUARTERS, ends)]
    return features.sparkSession.createDataFrame([(n, *row)], "n long, q0 double, q25 double, q50 double, q75 double, q100 double")


def bandwidth(neighbors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(sigma, fallback): the median distance to the 10th neighbour; if that is 0 the median of the positive ones; if there are
    none, of the positive distances of ``pairs``. All distances 0 is an error when the row is read."""
    tenth = neighbors.where(F.col("rank") == BANDWIDTH_RANK)
    got = tenth.agg(F.median("dist").alias("plain"), F.median(F.when(F.col("dist") > 0, F.col("dist"))).alias("positive"))
    if pairs is not None:
        got = got.crossJoin(pairs.agg(F.median(F.when(F.col("dist") > 0, F.col("dist"))).alias("all")))  # one row and one row
    else:
        got = got.withColumn("all", F.lit(None).cast("double"))
    fallback = F.when(F.col("plain") > 0, F.lit(None).cast("string")).when(F.col("positive") > 0, "positive_10th").otherwise("positive_pairwise")
    none = F.raise_error(F.lit("all distances are zero")).cast("double")
    return got.select(F.coalesce(F.when(F.col("plain") > 0, F.col("plain")), "positive", "all", none).alias("sigma"), fallback.alias("fallback"))


def gaussian(dist: Column, sigma: Column) -> Column:
    return F.exp(-0.5 * F.pow(dist / sigma, 2))


def weighted(neighbors: DataFrame, sigma: DataFrame) -> DataFrame:
    """``neighbors`` with w, one sigma for every k; a weight that is not positive and finite is an error."""
    w = neighbors.crossJoin(F.broadcast(sigma.select("sigma"))).withColumn("w", gaussian(F.col("dist"), F.col("sigma"))).drop("sigma")
    bad = F.raise_error(F.lit("a similarity is not positive and finite"))
    return w.withColumn("w", F.when((F.col("w") > 0) & (F.col("w") <= 1), F.col("w")).otherwise(bad.cast("double")))
