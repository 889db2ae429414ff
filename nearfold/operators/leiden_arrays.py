"""Leiden on arrays.

The same three phases as in ``leiden``: moves, refinement, a graph of the parts. Nodes go in random batches; those of a batch
decide at the same time, from what was true before it. Links are worked on in pieces of a fixed number, so arrays of all links may
lie in memory or in files: what is found does not depend on it, and in files only arrays of nodes and of a piece take memory.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from .components import _roots

#: Gain in modularity (times the total weight) that counts.
LEAST_GAIN = 1e-12
#: Batches of a round at least; links of a batch about at most; rounds of moves at most, and share of nodes that has to move for
#: another; runs from the whole graph to communities at most, and modularity that a run has to gain for another.
BATCHES, BATCH_LINKS, ROUNDS, LEAST_MOVED, RUNS, LEAST_RISE = 16, 1 << 20, 30, 1e-3, 10, 1e-4
#: Cells a link of a table of nodes and groups, up to which it is filled in place of sorting links.
FEW_CELLS = 4
#: Links that are worked on at a time where all are, and that are sorted at a time.
AT_ONCE, PIECE = 1 << 16, 1 << 20
#: Looks at links in place of which a table of all nodes is filled.
TABLE_LOOKS = 2

#: A new array of a length and type, in memory (np.empty) or in a file (in_file).
Make = Callable[[int, type], np.ndarray]


def in_file(n: int, dtype: type) -> np.ndarray:
    """An array of zeros in a file of the executor's local folder, which goes with the array."""
    if not n:
        return np.empty(0, dtype)
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]) as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.asarray(np.memmap(f, dtype, "r+", shape=(n,)))


def pieces(m: int) -> list[slice]:
    return [slice(at, min(at + PIECE, m)) for at in range(0, m, PIECE)]


class Links(NamedTuple):
    """Of each node its links (no loops), from both ends; strengths count loops twice. ``once``: ends and weight of each link, where
    they are known; ``positive``: no weight is 0, so a sum of weights is 0 only where there is no link."""

    start: np.ndarray
    to: np.ndarray
    w: np.ndarray
    strength: np.ndarray
    total: float
    once: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    positive: bool
    make: Make = np.empty


def order_of(key: np.ndarray, bound: int) -> np.ndarray:
    """np.argsort(key, kind="stable") of keys from 0 to bound - 1: key and place are sorted as one number, if they fit in one."""
    bits = len(key).bit_length()
    if bound.bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    both = key.astype(np.int64)
    both <<= bits
    both |= np.arange(len(key))
    both.sort()
    both &= (1 << bits) - 1
    return both


def ordered(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, make: Make = np.empty, summed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between 0..n-1 in the order of (u, v), ``summed`` those of a pair as one. They are dealt into ranges of u of about PIECE
    links, and a range is sorted at a time."""
    m, count = len(u), np.zeros(n, np.int64)
    for p in pieces(m):
        count += np.bincount(u[p], minlength=n)
    start = np.concatenate([[0], np.cumsum(count)])
    edge = np.unique([0, *np.searchsorted(start, np.arange(PIECE, m, PIECE), "right") - 1, n])
    of = np.repeat(np.arange(len(edge) - 1, dtype=np.int32), np.diff(edge))
    a, b, x = make(m, np.int32), make(m, np.int32), make(m, np.float64)
    free = start[edge].copy()
    for p in pieces(m):
        into = of[u[p]]
        order, many = order_of(into, len(edge)), np.bincount(into, minlength=len(edge) - 1)
        lo = 0
        for k in np.flatnonzero(many).tolist():
            own, to = order[lo : lo + many[k]], slice(free[k], free[k] + many[k])
            a[to], b[to], x[to] = u[p][own], v[p][own], w[p][own]
            free[k], lo = to.stop, lo + many[k]
    at = 0
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        own = slice(start[lo], start[hi])
        key = (a[own] - np.int64(lo)) * n + b[own]
        order = order_of(key, (hi - lo) * n)
        if summed and len(order):
            key = key[order]
            first = _firsts(key)
            to, key = slice(at, at + len(first)), key[first]
            x[to] = np.add.reduceat(x[own][order], first)
            a[to], b[to] = key // n + lo, key % n
            at = to.stop
        else:
            a[own], b[own], x[own] = a[own][order], b[own][order], x[own][order]
            at = own.stop
    if at == m:
        return a, b, x
    out = make(at, np.int32), make(at, np.int32), make(at, np.float64)
    for whole, few in zip((a, b, x), out):
        few[:] = whole[:at]
    return out


def _sums(g: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray, n: int) -> np.ndarray:
    """The weights of the links (u, v, w) at both ends, by ``of`` of the end."""
    out = np.zeros(n)
    for p in pieces(len(g[0])):
        for ends in g[:2]:
            out += np.bincount(of[ends[p]], g[2][p], n)
    return out


def links(u: np.ndarray, v: np.ndarray, w: np.ndarray, strength: np.ndarray, total: float, make: Make = np.empty) -> Links:
    n, m = len(strength), len(u)
    count = np.zeros(n, np.int64)
    for p in pieces(m):
        for ends in (u, v):
            count += np.bincount(ends[p], minlength=n)
    start = np.concatenate([[0], np.cumsum(count)])
    to, both, free = make(2 * m, np.int32), make(2 * m, np.float64), start[:-1].copy()
    for ends, others in ((u, v), (v, u)):
        for p in pieces(m):
            order = order_of(ends[p], n)
            own = ends[p][order]
            first = _firsts(own)
            many = np.diff(first, append=len(own))
            at = np.arange(len(own)) + np.repeat(free[own[first]] - first, many)
            to[at], both[at] = others[p][order], w[p][order]
            free[own[first]] += many
    return Links(start, to, both, strength, total, (u, v, w), not m or bool(w.min() > 0), make)


def _at(g: Links, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``nodes``, place in ``g.to``) of the links of ``nodes``."""
    count = g.start[nodes + 1] - g.start[nodes]
    row = np.repeat(np.arange(len(nodes)), count)
    return row, np.arange(len(row)) + np.repeat(g.start[nodes] - np.cumsum(count) + count, count)


def _summed(key: np.ndarray, w: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys from 0 to bound - 1 in order, sum of w of each)."""
    bits = len(key).bit_length()
    if bound.bit_length() + bits > 63:
        order = np.argsort(key, kind="stable")
        key = key[order]
    else:
        both = key.astype(np.int64)
        both <<= bits
        both |= np.arange(len(key))
        both.sort()
        key, order = both >> bits, both
        order &= (1 << bits) - 1
    first = _firsts(key)
    return key[first], np.add.reduceat(w[order], first) if len(first) else np.empty(0)


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    """The first place of each value."""
    new = np.empty(len(sorted_), bool)
    new[:1] = True
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    return np.flatnonzero(new)


def _into(g: Links, labels: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``nodes``, label, weight) of the links of ``nodes`` to each group, in order."""
    count = g.start[nodes + 1] - g.start[nodes]
    at = np.arange(int(count.sum()))
    at += np.repeat(g.start[nodes] - np.cumsum(count) + count, count)
    used = np.zeros(len(labels), bool)
    used[labels] = True
    names = np.flatnonzero(used)
    if len(nodes) * len(names) <= FEW_CELLS * len(at):
        place = np.cumsum(used) - 1
        cell, cells = np.repeat(np.arange(len(nodes)) * len(names), count), len(nodes) * len(names)
        cell += place[labels][g.to[at]]
        into = np.bincount(cell, g.w[at], cells)
        filled = np.flatnonzero(into if g.positive else np.bincount(cell, minlength=cells))
        return filled // len(names), names[filled % len(names)], into[filled]
    key = np.repeat(np.arange(len(nodes)) * len(labels), count)
    key += labels[g.to[at]]
    key, w = _summed(key, g.w[at], len(nodes) * len(labels))
    return key // len(labels), key % len(labels), w


def _ranges(g: Links) -> list[tuple[int, int]]:
    """Nodes (from, to) with about AT_ONCE links, so that what is worked out of them stays in the processor's cache."""
    edge = np.unique(np.searchsorted(g.start, np.arange(0, len(g.to) + AT_ONCE, AT_ONCE)).clip(0, len(g.start) - 1))
    edge[-1] = len(g.start) - 1
    return list(zip([0, *edge[1:-1].tolist()], edge[1:].tolist())) if len(edge) > 1 else [(0, int(edge[-1]))]


class _Table:
    """What each node has in each group that is in use, kept up as nodes move: a move costs its own links, a look at a node none.
    Links are counted too, as a sum of weights that came and went need not end at 0."""

    def __init__(self, g: Links, labels: np.ndarray, names: np.ndarray):
        n, self.g, self.names = len(labels), g, names
        self.place = np.full(n, -1)
        self.place[names] = np.arange(len(names))
        cells, of = n * len(names), self.place[labels]
        self.w, self.count = g.make(cells, np.float64), g.make(cells, np.int32)
        for lo, hi in _ranges(g):
            cell = np.repeat(np.arange(hi - lo) * len(names), np.diff(g.start[lo : hi + 1]))
            at, mine = slice(g.start[lo], g.start[hi]), slice(lo * len(names), hi * len(names))
            cell += of[g.to[at]]
            self.w[mine] = np.bincount(cell, g.w[at], (hi - lo) * len(names))
            self.count[mine] = np.bincount(cell, minlength=(hi - lo) * len(names))

    def into(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _into()."""
        row, k = np.nonzero(self.count.reshape(-1, len(self.names))[nodes])
        return row, self.names[k], self.w[nodes[row] * len(self.names) + k]

    def best(self, nodes: np.ndarray, s: np.ndarray, was: np.ndarray, volume: np.ndarray, twice: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _best(), from all groups of a node at once, by about AT_ONCE cells."""
        w, count, of, names = self.w.reshape(-1, len(self.names)), self.count.reshape(-1, len(self.names)), self.place[was], volume[self.names]
        stay, most, goal = -s * (volume[was] - s) / twice, np.empty(len(nodes)), was.copy()
        step = max(1, AT_ONCE // len(self.names))
        for lo in range(0, len(nodes), step):
            own = slice(lo, min(lo + step, len(nodes)))
            here = np.arange(own.stop - lo), of[own]
            less = np.repeat(names[None, :], own.stop - lo, 0)
            less[here] -= s[own]
            less *= s[own, None]
            less /= twice
            gain, linked = w[nodes[own]] - less, count[nodes[own]] != 0
            stay[own] = np.where(linked[here], gain[here], stay[own])
            gain[~linked] = -np.inf
            most[own] = gain.max(axis=1)
            found = self.names[(gain >= (most[own] - LEAST_GAIN)[:, None]).argmax(axis=1)]
            goal[own] = np.where(most[own] > -np.inf, found, goal[own])
        return stay, most, goal

    def moved(self, other: np.ndarray, w: np.ndarray, was: np.ndarray, goal: np.ndarray) -> bool:
        """Takes links to ``other`` from groups ``was`` to ``goal``; false, and no more of use, if a group is new."""
        if (self.place[goal] < 0).any():
            return False
        row = other * np.int64(len(self.names))
        for to, sign in ((goal, 1), (was, -1)):
            cell = row + self.place[to]
            np.add.at(self.w, cell, sign * w)
            np.add.at(self.count, cell, np.int32(sign))
        return True


def _table(g: Links, labels: np.ndarray, nodes: np.ndarray) -> _Table | None:
    """A table for rounds over ``nodes`` and what follows, if it has no more cells than there are links, and filling it is no more
    than TABLE_LOOKS looks at those of ``nodes``."""
    names = np.unique(labels)
    if len(names) * len(labels) > len(g.to) or len(g.to) > TABLE_LOOKS * (g.start[nodes + 1] - g.start[nodes]).sum():
        return None
    return _Table(g, labels, names)


def _largest(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest value, its first place) of each row."""
    first = _firsts(row)
    if not len(first):
        return np.empty(0), np.empty(0, np.int64)
    most = np.maximum.reduceat(value, first)
    count = np.diff(first, append=len(row))
    near = np.flatnonzero(value >= np.repeat(most, count) - LEAST_GAIN)
    return most, near[_firsts(row[near])]


def _best(g: Links, labels: np.ndarray, nodes: np.ndarray, s: np.ndarray, was: np.ndarray, volume: np.ndarray, twice: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain where they are, largest gain, its group) of ``nodes`` by their links; -inf and where they are without any."""
    row, c, into = _into(g, labels, nodes)
    own = c == was[row]
    gain = into - s[row] * (volume[c] - np.where(own, s[row], 0)) / twice
    stay = -s * (volume[was] - s) / twice
    stay[row[own]] = gain[own]
    most, place = _largest(row, gain)
    best, goal = np.full(len(nodes), -np.inf), was.copy()
    best[row[place]], goal[row[place]] = most, c[place]
    return stay, best, goal


def _batches(g: Links, nodes: np.ndarray) -> list[np.ndarray]:
    of = int((g.start[nodes + 1] - g.start[nodes]).sum())
    return [x for x in np.array_split(nodes, min(max(1, len(nodes)), max(BATCHES, of // BATCH_LINKS))) if len(x)]


def _move(g: Links, labels: np.ndarray, r: np.random.Generator) -> bool:
    """Moves nodes to better groups, in ``labels``, in rounds over those whose neighbours moved; whether any did."""
    n, twice = len(labels), 2 * g.total
    volume, size = np.bincount(labels, g.strength, n), np.bincount(labels, minlength=n)
    active, moved, table = np.ones(n, bool), False, None
    for _ in range(ROUNDS):
        nodes, now = r.permutation(np.flatnonzero(active)), 0
        active[:] = False
        table = table or _table(g, labels, nodes)
        for batch in _batches(g, nodes):
            s, was = g.strength[batch], labels[batch]
            stay, best, goal = table.best(batch, s, was, volume, twice) if table else _best(g, labels, batch, s, was, volume, twice)
            alone = (best < 0) & (stay < -LEAST_GAIN) & (size[batch] == 0)  # the label of its own, if it is free
            best[alone], goal[alone] = 0.0, batch[alone]
            go = np.flatnonzero((best > stay + LEAST_GAIN) & (goal != was))
            if not len(go):
                continue
            labels[batch[go]] = goal[go]
            for x, by in ((volume, s[go]), (size, 1)):
                np.add.at(x, goal[go], by)
                np.subtract.at(x, was[go], by)
            row, at = _at(g, batch[go])
            other, to = g.to[at], goal[go][row]
            active[other[labels[other] != to]] = True
            if table and not table.moved(other, g.w[at], was[go][row], to):
                table = None
            now += len(go)
        moved = moved or now > 0
        if now <= LEAST_MOVED * n:
            break
    return moved


def _within(g: Links, labels: np.ndarray) -> Links:
    short, start, at = labels.astype(np.int32), np.zeros(len(g.start), np.int64), 0
    to, w = g.make(len(g.to), np.int32), g.make(len(g.to), np.float64)
    for lo, hi in _ranges(g):
        own = slice(g.start[lo], g.start[hi])
        keep = np.flatnonzero(np.repeat(short[lo:hi], np.diff(g.start[lo : hi + 1])) == short[g.to[own]])
        start[lo : hi + 1] = at + np.searchsorted(keep, g.start[lo : hi + 1] - g.start[lo])
        to[at : at + len(keep)], w[at : at + len(keep)] = g.to[own][keep], g.w[own][keep]
        at += len(keep)
    return Links(start, to[:at], w[:at], g.strength, g.total, None, g.positive, g.make)


def _refine(g: Links, labels: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Within each group, merges nodes that are alone into well connected parts, at random by their gain. Who is joined in a batch
    does not move in it, so parts are connected."""
    n, twice, own = len(labels), 2 * g.total, _within(g, labels)
    parts, volume, size = np.arange(n), g.strength.copy(), np.ones(n, np.int64)
    members = np.bincount(labels, g.strength, n)[labels]
    inside = np.zeros(n)
    for lo, hi in _ranges(own):
        row = np.repeat(np.arange(hi - lo), np.diff(own.start[lo : hi + 1]))
        inside[lo:hi] = np.bincount(row, own.w[own.start[lo] : own.start[hi]], hi - lo)
    first = inside.copy()
    for _ in range(2):
        nodes = np.flatnonzero((size == 1) & (parts == np.arange(n)) & (first >= g.strength * (members - g.strength) / twice))
        for batch in _batches(own, r.permutation(nodes)):
            batch = batch[(parts[batch] == batch) & (size[batch] == 1)]
            s = g.strength[batch]
            row, p, into = _into(own, parts, batch)
            gain = into - s[row] * volume[p] / twice
            good = (gain >= 0) & (inside[p] >= volume[p] * (members[batch][row] - volume[p]) / twice - LEAST_GAIN)
            row, p, into, gain = row[good], p[good], into[good], gain[good]
            if not len(row):
                continue
            most = np.full(len(batch), 1e-12)
            np.maximum.at(most, row, gain)
            _, place = _largest(row, np.minimum(50, gain / 0.01 / most[row]) + r.gumbel(size=len(row)))
            row, p, into = row[place], p[place], into[place]
            turn = np.full(n, -1)
            turn[batch[row]] = row  # who moves, and when it would
            clash = turn[p] >= 0
            stays = np.zeros(n, bool)
            stays[p[clash & (row < turn[p])]] = True
            go = ~stays[batch[row]] & ~(clash & (row > turn[p]))
            u, p, into = batch[row[go]], p[go], into[go]
            parts[u] = p
            np.add.at(inside, p, first[u] - 2 * into)
            np.add.at(volume, p, g.strength[u])
            np.add.at(size, p, 1)
            volume[u], size[u], inside[u] = 0.0, 0, 0.0
    return parts


def _merged(g: Links, parts: np.ndarray, labels: np.ndarray) -> tuple[Links, np.ndarray, np.ndarray]:
    """The graph of the parts: (graph, group of each part, part of each node)."""
    names, one, place = np.unique(parts, return_index=True, return_inverse=True)
    m, short, k = len(names), place.astype(np.int32), 0
    u, v, w = (g.make(len(x), x.dtype) for x in g.once)
    for p in pieces(len(u)):
        a, b = (short[x[p]] for x in g.once[:2])
        keep = np.flatnonzero(a != b)
        a, b, to = a[keep], b[keep], slice(k, k + len(keep))
        u[to], v[to], w[to] = np.minimum(a, b), np.maximum(a, b), g.once[2][p][keep]
        k = to.stop
    u, v, w = ordered(u[:k], v[:k], w[:k], m, g.make, summed=True)
    group = np.unique(labels[one], return_inverse=True)[1]
    return links(u, v, w, np.bincount(place, g.strength, m), g.total, g.make), group, place


def connected(u: np.ndarray, v: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Groups split into their components, by the smallest node of each."""
    root = np.arange(len(labels))
    for p in pieces(len(u)):
        same = labels[u[p]] == labels[v[p]]
        root = _roots(root[u[p][same]], root[v[p][same]], len(labels))[root]
    return root


def _connected_by(g: Links, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """connected() of the groups ``at`` of a graph of connected parts, for the nodes whose parts are ``place``."""
    root, least = connected(*g.once[:2], at)[place], np.full(len(at), len(place))
    np.minimum.at(least, root, np.arange(len(place)))
    return least[root]


def quality(u: np.ndarray, v: np.ndarray, w: np.ndarray, labels: np.ndarray) -> float:
    total, inside = float(w.sum()), 0.0
    for p in pieces(len(u)):
        inside += float(w[p][labels[u[p]] == labels[v[p]]].sum())
    return float(inside / total - ((_sums((u, v, w), labels, len(labels)) / (2 * total)) ** 2).sum())


def _proper(u: np.ndarray, v: np.ndarray, w: np.ndarray, make: Make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links but for loops."""
    if not any((u[p] == v[p]).any() for p in pieces(len(u))):
        return u, v, w
    out, k = tuple(make(len(x), x.dtype) for x in (u, v, w)), 0
    for p in pieces(len(u)):
        keep = np.flatnonzero(u[p] != v[p])
        for x, y in zip(out, (u, v, w)):
            x[k : k + len(keep)] = y[p][keep]
        k += len(keep)
    return tuple(x[:k] for x in out)


def leiden(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, seed: int, make: Make = np.empty) -> np.ndarray:
    """A label for each of the nodes 0..n-1, the smallest node of its community; communities are connected."""
    labels, r, total = np.arange(n), np.random.default_rng(seed), float(w.sum())
    if total <= 0:
        return labels
    whole = links(*_proper(u, v, w, make), _sums((u, v, w), labels, n), total, make)
    best = quality(u, v, w, labels)
    for _ in range(RUNS):
        g, at, place, sound = whole, labels.copy(), np.arange(n), True
        while True:
            moved = _move(g, at, r)
            groups = len(np.unique(at))
            if groups == len(at) or not moved and len(at) < n:
                break
            parts = _refine(g, at, r)
            if len(np.unique(parts)) == len(at):
                parts, sound = at, False  # whole groups, which need not be connected
            g, at, step = _merged(g, parts, at)
            place = step[place]
        after = _connected_by(g, at, place) if sound else connected(u, v, at[place])
        new = quality(u, v, w, after)
        rise = new - best
        if rise > 0:
            labels, best = after, new
        if rise < LEAST_RISE:
            break
    return labels
