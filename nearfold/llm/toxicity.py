"""Toxicity by weak supervision.

A bounded sample of labelled rows gives a lexicon: words and word beginnings that stand in toxic texts far oftener than in
others. Groups of its terms and patterns of their use are voters, which vote for, against or not at all; the label of a row
is one more voter. A generative model estimates, by expectation maximisation, how each voter votes on toxic and on clean
texts, and discounts voters by how far they agree beyond what the hidden class explains. A linear classifier of the
lexicon's terms is then trained on the posterior, and scores every whole text of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import cutoff
from ._words import BLOCK, LOWER, NOT_ALNUM, _hash, blocks, words

#: Labelled rows that are learned from at most, and terms of the lexicon.
SAMPLE_ROWS, TERMS = 12_000, 1_024
#: Toxic rows among them below which only the fixed words count.
LEAST_TOXIC = 5
#: Words are counted in 2**BITS cells, their beginnings of PREFIX bytes in as many more.
BITS, PREFIX = 20, 6
THRESHOLD = 0.3
#: Log odds of a term of the lexicon.
LEAST_ODDS = 2.0
#: Common English insults, voters even where few labels are known.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "bastard", "imbecile", "dumb", "vermin", "filth", "jerk")


@dataclass
class Model:
    """``place``: cell to term or -1. The last three weights are of EXTRA, the one after of nothing."""

    place: np.ndarray
    weights: np.ndarray
    bias: float


#: Terms found with repeats and distinct, both as log(1 + n), and how dense they are.
EXTRA = 3


def cells(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each word, cell of its beginning or -1 for short words, first word of each text)."""
    hashes, starts, ends, first = words(buf, bounds, NOT_ALNUM, LOWER)
    mask = np.uint64(2**BITS - 1)
    whole = (hashes & mask).astype(np.int64)
    begin = np.full(len(starts), -1, np.int64)
    long_ = np.flatnonzero(ends - starts > PREFIX)
    low, at, k = LOWER[buf], starts[long_], 0
    while k < len(long_):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + BLOCK, "right")))
        part, a = at[k:stop], at[k]
        piece = low[a : part[-1] + PREFIX]
        begin[long_[k:stop]] = (_hash(piece, part - a, part - a + PREFIX) & mask).astype(np.int64) + 2**BITS
        k = stop
    return whole, begin, first


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, bounds in blocks(batch.column("text")):
            whole, begin, first = cells(buf, bounds)
            rows = [np.unique(np.concatenate([whole[a:b], begin[a:b][begin[a:b] >= 0]])).astype(np.int32) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(lo, hi - lo), pa.array(rows, pa.list_(pa.int32())), pa.array(np.diff(first))], ["toxic", "cells", "n"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> pa.Table:
    """(toxic, cells, n) of about ``rows`` labelled documents at most whose crc32(doc_id) mod 4 is not 2, chosen by hash. Of texts
    that share a doc_id the smallest counts, of labels the largest."""
    known = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 1) <= cutoff(rows, known.count()))
    # at most about `rows` pairs of numbers
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return picked.select("toxic", "text").mapInArrow(_gather, "toxic int, cells array<int>, n long").toArrow()


def lexicon(y: np.ndarray, owner: np.ndarray, cell: np.ndarray, terms: int) -> np.ndarray:
    """Cells by how much more of the toxic texts than of the others hold them, best first."""
    toxic = np.bincount(cell, weights=y[owner], minlength=2 ** (BITS + 1))
    every = np.bincount(cell, minlength=2 ** (BITS + 1))
    nt, nc = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    odds = np.log((toxic + 0.5) / (nt + 1)) - np.log((every - toxic + 0.5) / (nc + 1))
    gain = np.where((toxic >= 3) & (odds > LEAST_ODDS), toxic * odds**2, 0)
    best = np.argsort(-gain, kind="stable")[:terms]
    best = best[gain[best] > 0]
    data = np.frombuffer(" ".join(INSULTS).encode(), np.uint8)
    fixed = cells(data, np.array([0, len(data)]))[0]
    return np.concatenate([best, fixed[~np.isin(fixed, best)]])


def votes(x: np.ndarray, n: np.ndarray, fixed: np.ndarray, begins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows by voters, each 1, -1 or 0 (no vote). x: rows by terms, 1 where the text holds the term."""
    hits = x.sum(axis=1)
    for_ = lambda a: a.astype(np.int8)
    both = lambda a, b: a.astype(np.int8) - b.astype(np.int8)
    borders = np.unique(np.geomspace(1, x.shape[1] + 1, 17).astype(int)) - 1  # few of the best terms, many of the others
    groups = [for_(x[:, a:b].any(axis=1)) for a, b in zip(borders[:-1], borders[1:])]
    half = x[:, : max(1, x.shape[1] // 8)].sum(axis=1)
    density = 100 * hits / (n + 20)
    patterns = [
        both(x[:, fixed].sum(axis=1) >= 2, x[:, fixed].sum(axis=1) == 0),
        both(half >= 2, half == 0),
        both(hits >= 3, hits == 0),
        both(density >= 2, density < 0.2),
        both(x[:, begins].sum(axis=1) >= 2, x[:, begins].sum(axis=1) == 0),
    ]
    return np.stack([*groups, *patterns, both(y == 1, y == 0)], axis=1)


def label_model(v: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of the class, table[voter, class, vote + 1], weight of each voter), from the votes alone."""
    q = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + v.sum(axis=1) - np.median(v.sum(axis=1)))))
    q = 0.5 * q + 0.5 * (v[:, -1] > 0)
    weight = np.ones(v.shape[1])
    for _ in range(rounds):
        table = np.stack([np.stack([((v == k) * c[:, None]).sum(axis=0) + 0.5 for k in (-1, 0, 1)], axis=1) / (c.sum() + 1.5) for c in (1 - q, q)], axis=1)
        each = np.log(table[:, 1] / table[:, 0])
        odds = np.log(prior / (1 - prior)) + sum(weight[j] * each[j, v[:, j] + 1] for j in range(v.shape[1]))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        means = table @ np.array([-1.0, 0.0, 1.0])
        rest = v - (means[:, 0][None] * (1 - q)[:, None] + means[:, 1][None] * q[:, None])
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-6
        alike = np.abs((rest / scale).T @ (rest / scale) / len(v))
        np.fill_diagonal(alike, 0)
        weight = 1 / (1 + np.clip(alike - 0.05, 0, 1).sum(axis=1))
        weight[-1] = 1.0  # the label is nobody's copy
    return q, table, weight


def _extra(total: np.ndarray, distinct: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(total), np.log1p(distinct), np.minimum(5.0, 100 * total / (n + 20))], axis=1)


def train(table: pa.Table, terms: int = TERMS) -> Model:
    y = np.asarray(table.column("toxic").to_numpy(), float)
    lists = table.column("cells").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    cell, lengths = np.asarray(lists.flatten()), np.asarray(lists.value_lengths().fill_null(0))
    owner, n = np.repeat(np.arange(len(y)), lengths), np.asarray(table.column("n").to_numpy(), float)
    chosen = lexicon(y, owner, cell, terms)
    place = np.full(2 ** (BITS + 1), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    if not LEAST_TOXIC <= y.sum() < len(y):  # too little to learn from: the fixed words alone
        return Model(place, np.concatenate([np.full(len(chosen), 1.5), np.zeros(EXTRA)]), -3.0)
    x = np.zeros((len(y), len(chosen)), np.float32)
    hit = place[cell] >= 0
    x[owner[hit], place[cell[hit]]] = 1
    data = np.frombuffer(" ".join(INSULTS).encode(), np.uint8)
    fixed = np.unique(place[cells(data, np.array([0, len(data)]))[0]])
    begins = np.flatnonzero(chosen >= 2**BITS)
    q, _, _ = label_model(votes(x, n, fixed, begins, y), float(np.clip(y.mean(), 0.01, 0.5)))
    distinct = x.sum(axis=1)
    x = np.concatenate([x, _extra(distinct, distinct, n).astype(np.float32)], axis=1)
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(y.mean() / (1 - y.mean())))
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, 301):  # Adam on the cross-entropy with the posterior
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (x.T @ (p - q).astype(np.float32)) / len(y) + 2e-4 * w
        gb = float((p - q).mean())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.05 / (1 + t / 100)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-8)
    return Model(place, w.astype(float), b)


def scores(model: Model, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    whole, begin, first = cells(buf, bounds)
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    term = np.concatenate([model.place[whole], np.where(begin >= 0, model.place[begin], -1)])
    who = np.concatenate([doc, doc])
    hit = term >= 0
    once = np.unique(who[hit] * np.int64(len(model.weights)) + term[hit])
    who, term = once // len(model.weights), once % len(model.weights)
    distinct = np.bincount(who, minlength=n).astype(float)
    z = np.bincount(who, weights=model.weights[term], minlength=n) + _extra(distinct, distinct, np.diff(first)) @ model.weights[-EXTRA:] + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``, from its whole text alone.

    Null and empty texts get the score of a text without terms. Rows that repeat come out as often; an empty table gives an
    empty result; other columns are not read.
    """
    named = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(scores(model, buf, bounds))], ["doc_id", "score"])

    return named.mapInArrow(run, f"doc_id {dict(named.dtypes)['doc_id']}, score double")


def below(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(model, buf, bounds) for _, _, buf, bounds in blocks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(found) < threshold)) if found else batch

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """score() of ``docs`` by a model of ``labelled`` documents (doc_id, text) and ``labels`` (doc_id, toxic)."""
    return score(docs, train(sample(labelled, labels)))
