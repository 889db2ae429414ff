"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes in both directions, labels every position with probabilities of the languages,
and a text's probabilities are the means over all its positions. It is trained here, in numpy, by backpropagation through
time on a bounded sample of windows; the windows of a text to predict cover all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import cutoff
from ._words import LOWER, blocks

WINDOW, HIDDEN = 64, 8
#: Of labelled documents that are learned from at most, and of windows of each.
SAMPLE_ROWS, SAMPLE_WINDOWS = 2_000, 6
STEPS, BATCH, RATE = 350, 256, 0.02
#: Windows that run through the network together.
AT_ONCE = 2_048
UNKNOWN = "und"
_F = np.float32


@dataclass
class Network:
    """``byte``: (2, 3 H, 256) input weights by direction; ``state``: (2, 3 H, H); ``shift``: (2, 3 H) with the biases of the
    state; ``out``: (L, 2 H); ``base``: (L). Gates in the order update, reset, candidate."""

    langs: list[str]
    byte: np.ndarray
    state: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    base: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.byte, self.state, self.shift, self.out, self.base]


def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
    r = np.random.default_rng(seed)
    draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(_F)
    return Network(langs, draw(2, 3 * hidden, 256, scale=0.3), draw(2, 3 * hidden, hidden, scale=hidden**-0.5), np.zeros((2, 3 * hidden), _F), draw(len(langs), 2 * hidden, scale=0.3), np.zeros(len(langs), _F))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= _F(0.5)
    np.tanh(x, out=x)
    x *= _F(0.5)
    x += _F(0.5)
    return x


def _forward(net: Network, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Probabilities (T, L, B) of windows (T, B). keep: gets what backward needs of each direction, by step."""
    steps, wide = windows.shape
    hidden = net.state.shape[2]
    states = np.empty((steps, 2 * hidden, wide), _F)
    for way in (0, 1):
        h = np.zeros((hidden, wide), _F)
        log = []
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            x = np.take(net.byte[way], windows[t], axis=1)
            u = net.state[way] @ h
            u += net.shift[way][:, None]
            g = _sigmoid(x[: 2 * hidden] + u[: 2 * hidden])
            z, r = g[:hidden], g[hidden:]
            n = np.tanh(x[2 * hidden :] + r * u[2 * hidden :])
            if keep is not None:
                log.append((t, h, z, r, n, u[2 * hidden :]))
            h = h - n
            h *= z
            h += n
            states[t, way * hidden : (way + 1) * hidden] = h
        if keep is not None:
            keep.append(log)
    if keep is not None:
        keep.append(states)
    p = np.matmul(net.out, states)
    p += net.base[:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def gradients(net: Network, windows: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the positions that mask (T, B) holds, and its gradient by each of parts()."""
    keep: list = []
    p = _forward(net, windows, keep)
    hidden, total = net.state.shape[2], max(1.0, float(mask.sum()))
    at = np.arange(windows.shape[1])
    loss = -float((np.log(p[:, label, at] + 1e-9) * mask).sum()) / total
    d = p.copy()
    d[:, label, at] -= 1
    d *= (mask / total)[:, None, :]
    states = keep[2]
    grads = [np.zeros_like(x) for x in net.parts()]
    grads[3] = np.einsum("tlb,thb->lh", d, states, optimize=True)
    grads[4] = d.sum(axis=(0, 2))
    back = np.matmul(net.out.T, d)
    for way in (0, 1):
        dh = np.zeros((hidden, windows.shape[1]), _F)
        for t, before, z, r, n, u in reversed(keep[way]):
            dh = dh + back[t, way * hidden : (way + 1) * hidden]
            da = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = da * u * r * (1 - r)
            dx = np.concatenate([dz, dr, da])
            du = np.concatenate([dz, dr, da * r])
            grads[1][way] += du @ before.T
            grads[2][way] += du.sum(axis=1)
            for g in range(3 * hidden):
                grads[0][way, g] += np.bincount(windows[t], weights=dx[g], minlength=256).astype(_F)
            dh = dh * z + net.state[way].T @ du
    return loss, grads


def train(langs: list[str], windows: np.ndarray, label: np.ndarray, sizes: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
    """Adam over random batches of windows (N, WINDOW) of ``sizes`` bytes each."""
    net, r = fresh(langs), np.random.default_rng(seed)
    first, second = [np.zeros_like(x) for x in net.parts()], [np.zeros_like(x) for x in net.parts()]
    for k in range(1, steps + 1):
        pick = r.integers(0, len(windows), min(BATCH, len(windows)))
        mask = (np.arange(windows.shape[1])[:, None] < sizes[pick][None]).astype(_F)
        _, grads = gradients(net, np.ascontiguousarray(windows[pick].T), label[pick], mask)
        rate = RATE * min(1.0, 2 * (1 - k / (steps + 1)))
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        for x, g, m, s in zip(net.parts(), grads, first, second):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)).astype(_F)
    return net


def windows_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows (N, WINDOW), bytes of each that are text, text of each): all bytes of all texts."""
    sizes = np.diff(bounds)
    count = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[doc] + nth * WINDOW
    size = np.minimum(WINDOW, bounds[doc + 1] - start)
    place = start[:, None] + np.arange(WINDOW)[None]
    out = np.where(np.arange(WINDOW)[None] < size[:, None], LOWER[buf][np.minimum(place, max(0, len(buf) - 1))], 0x20) if len(buf) else np.empty((0, WINDOW), np.uint8)
    return out, size, doc


def pooled(net: Network, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean probabilities (texts, L) over all positions; 0 for empty texts."""
    windows, sizes, doc = windows_of(buf, bounds)
    total = np.zeros((len(bounds) - 1, len(net.langs)))
    for lo in range(0, len(windows), AT_ONCE):
        part = np.ascontiguousarray(windows[lo : lo + AT_ONCE].T)
        p = _forward(net, part)
        p *= (np.arange(WINDOW)[:, None] < sizes[None, lo : lo + AT_ONCE])[:, None, :]
        np.add.at(total, doc[lo : lo + AT_ONCE], p.sum(axis=0, dtype=float).T)
    return total / np.maximum(1, np.diff(bounds))[:, None]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, bounds in blocks(batch.column("text")):
            windows, sizes, doc = windows_of(buf, bounds)
            first = np.searchsorted(doc, np.arange(hi - lo + 1))
            pick = np.concatenate([np.unique(np.linspace(a, b - 1, SAMPLE_WINDOWS).astype(int)) if b > a else np.empty(0, int) for a, b in zip(first[:-1], first[1:])]).astype(int)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo).take(pa.array(doc[pick])), pa.array([w.tobytes() for w in windows[pick]], pa.binary()), pa.array(sizes[pick].astype(np.int32))], ["lang", "window", "size"])


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """A network from about ``rows`` documents at most, as many of each language, whose crc32(doc_id) mod 3 is not 1, chosen by a
    hash of doc_id and text; equal rows count once. None without any."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and length(text) > 0").where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0)) != 1)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    most = F.create_map(*(F.lit(x) for k, v in counts.items() for x in (k, cutoff(max(1, rows // len(counts)), v))))
    chosen = known.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(3)), 1)).where(F.col("hash") <= most[F.col("lang")])
    chosen = chosen.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    found = chosen.select("lang", "text").mapInArrow(_cut, "lang string, window binary, size int").toArrow()
    langs = sorted(counts)
    if unseen := set(langs) - set(found.column("lang").to_pylist()):
        raise ValueError(f"no sample of languages {sorted(unseen)}")
    windows = np.frombuffer(b"".join(found.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    label = np.array([langs.index(x) for x in found.column("lang").to_pylist()], int)
    if not len(windows):
        return None
    order = np.lexsort([*windows.T[:8], label])  # the same whatever order the executors answered in
    return train(langs, windows[order], label[order], np.asarray(found.column("size").to_numpy())[order])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` from its whole text.

    Null texts and texts without a letter (Unicode class L) are ``und`` with score 0, and so is everything without a network.
    Rows that repeat come out as often; an empty table gives an empty result; other columns are not read.
    """
    named = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in blocks(batch.column("text")):
                letters = np.asarray(batch.column("letters").slice(lo, hi - lo).to_numpy(zero_copy_only=False), bool)
                if net is None:
                    names, score = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                else:
                    p = pooled(net, buf, bounds)
                    names = [net.langs[k] if known else UNKNOWN for k, known in zip(p.argmax(axis=1), letters)]
                    score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return named.mapInArrow(run, f"doc_id {dict(named.dtypes)['doc_id']}, lang_pred string, score double")
