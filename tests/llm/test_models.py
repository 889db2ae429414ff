"""op3, op5 by held-out accuracy, op4 against a plain computation, and the pipeline's stages."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfold.llm import _sample, langid, minhash, mixing, queries, toxicity

from .fixtures import docs, saved

SF = "/root/testdata/sf0.01"


def rest(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_toxicity_on_rows_that_were_not_learned_from(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10_000 and all(r.held_out == (rest(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([a > b for a in good for b in bad]) > 0.93
    assert np.mean([s >= 0.3 for s in good]) > 0.8 and np.mean([s >= 0.3 for s in bad]) < 0.02


def test_toxicity_awkward_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "you idiot, stupid moron"), (3, "you idiot, stupid moron"), (None, "fine words"), (4, "word " * 50_000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")):
        folder = saved(spark, tmp_path, documents=docs(spark, rows), labels=labels)
        got = sorted(((str(r.doc_id), r.score) for r in queries.op3_toxicity(spark, folder).collect()))
        assert [k for k, _ in got] == ["1", "2", "3", "3", "4", "None"] and got[0][1] == got[1][1] and got[2] == got[3]
    empty = saved(spark, tmp_path, documents=docs(spark, rows[:0]), labels=none)
    assert queries.op3_toxicity(spark, empty).collect() == []


def test_label_model_finds_good_voters():
    r = np.random.default_rng(3)
    y = (r.random(4000) < 0.2).astype(int)
    right = lambda p: np.where(r.random(4000) < p, 2 * y - 1, 1 - 2 * y)
    v = np.stack([right(0.95), right(0.9), right(0.5), right(0.5), right(0.85)], axis=1)
    v = np.concatenate([v[:, :1], v], axis=1)  # the first voter twice
    q, table, weight = toxicity.label_model(v, 0.2)
    assert ((q > 0.5) == y).mean() > 0.95
    assert table[0, 1, 2] > 0.85 and abs(table[3, 1, 2] - 0.5) < 0.1
    assert weight[0] < 0.7 and weight[3] > 0.9


def test_language_on_rows_that_were_not_learned_from(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op5_language(spark, SF).collect()
    assert len(got) == len(lang) and all(r.held_out == (rest(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.97


def test_language_gradient():
    r = np.random.default_rng(1)
    net = langid.fresh(["a", "b", "c"], hidden=3)
    for name in ("byte", "state", "shift", "out", "base"):
        setattr(net, name, getattr(net, name).astype(float))
    windows, label, mask = r.integers(97, 105, (7, 4)), np.array([0, 1, 2, 1]), np.ones((7, 4))
    mask[5:, 2] = 0
    _, grads = langid.gradients(net, windows, label, mask)
    for x, g in zip(net.parts(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = x[at]
        x[at] = was + 1e-3
        up = langid.gradients(net, windows, label, mask)[0]
        x[at] = was - 1e-3
        down = langid.gradients(net, windows, label, mask)[0]
        x[at] = was
        assert abs((up - down) / 2e-3 - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_language_awkward_rows(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "de"), (4, "the cat and the dog", "en"), (5, "der hund und die katze", "de"), (5, "der hund und die katze", "de"), (None, "the one", None), (6, "é", "de")]
    rows += [(k, t, g) for k in range(10, 30) for t, g in [("the dog and a cat", "en") if k % 2 else ("die katze und ein hund", "de")]]
    folder = saved(spark, tmp_path, documents=docs(spark, rows))
    got = [(r.doc_id, r.lang_pred, r.score) for r in queries.op5_language(spark, folder).collect()]
    assert len(got) == len(rows) and all((p == "und") == (i in (1, 2, 3)) for i, p, _ in got) and {p for _, p, _ in got} <= {"und", "en", "de"}
    nothing = saved(spark, tmp_path, documents=docs(spark, [(r[0], r[1], None) for r in rows]))
    assert {(r.lang_pred, r.score) for r in queries.op5_language(spark, nothing).collect()} == {("und", 0.0)}
    assert queries.op5_language(spark, saved(spark, tmp_path, documents=docs(spark, []))).collect() == []


def test_windows_cover_every_byte():
    data = np.arange(97, 97 + 26, dtype=np.uint8).repeat(10)
    windows, sizes, doc = langid.windows_of(data, np.array([0, 0, 64, 200, 260]))
    assert sizes.sum() == 260 and np.bincount(doc, weights=sizes, minlength=4).tolist() == [0, 64, 136, 60]
    assert b"".join(w[:n].tobytes() for w, n in zip(windows, sizes)) == data.tobytes()


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


@pytest.mark.parametrize("counts", [{"a": 200, "b": 900, "c": 300}, {"a": 3, "b": 900, "é": 40, None: 60, "z": 1}, {None: 5}])
def test_mixing(spark, tmp_path, counts):
    r = np.random.default_rng(9)
    rows = [(k, "w " * int(r.integers(0, 40)) if k % 17 else None, "en", s) for k, s in enumerate(x for s, n in counts.items() for x in [s] * n)]
    rows += [(k, "x\x0by z", "en", s) for k, s in enumerate(counts, 100_000)]
    folder = saved(spark, tmp_path, documents=docs(spark, rows).repartition(3))
    got = queries.op4_mixing(spark, folder).collect()
    again = queries.op4_mixing(spark, folder).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    sizes, taken, target, source = {}, {}, {}, {x[0]: x[3] for x in rows}
    for x in got:
        s = source[x.doc_id]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + x.size, taken.get(s, 0) + x.taken, x.target
        assert x.taken <= 3 * x.size and (x.doc_id < 100_000 or x.size == 2)
    assert all(x.source_size == sizes[source[x.doc_id]] for x in got)
    assert target == pytest.approx(plain_targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 25 for s in sizes)


def test_mixing_empty_and_repeats(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert mixing.mix(docs(spark, [(1, "a b"), (1, "a b"), (None, None)])).agg(F.sum("taken")).first()[0] == 4


def plain_rates(sizes, target):
    """Rate of each number of bits: weight times the level that makes the target, found by halving."""
    words = {}
    for n in sizes:
        if n:
            words[n.bit_length() - 1] = words.get(n.bit_length() - 1, 0) + n
    lo, hi = 0.0, 10.0
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(3, level * (4 + b)) * w for b, w in words.items()) < target else (lo, level)
    return {b: round(min(3, hi * (4 + b)), 9) for b in words}


def test_inclusion_is_by_size(spark):
    """Over seeds, documents are taken as often as the rate of their size says: longer ones more often, none above 3 times."""
    r = np.random.default_rng(4)
    sizes = [int(2 ** r.uniform(0, 9)) for _ in range(900)]
    d = docs(spark, [(k, "w " * n, "en", "abc"[min(2, k % 6)]) for k, n in enumerate(sizes)]).cache()
    runs = [sorted(mixing.mix(d, seed=s).collect()) for s in range(20)]
    target = {x.doc_id: x.target for x in runs[0]}
    for part in range(3):
        own = [k for k in range(900) if min(2, k % 6) == part]
        rate = plain_rates([sizes[k] for k in own], target[own[0]])
        assert len(set(rate.values())) > 3 or min(rate.values()) == 3
        for bits, want in rate.items():
            group = [k for k in own if sizes[k].bit_length() - 1 == bits]
            copies = np.array([[run[k].copies for k in group] for run in runs])
            p = want % 1
            assert set(np.unique(copies)) <= {int(want), min(3, int(want) + 1)}
            assert abs(copies.mean() - want) < 0.02 + 4 * (p * (1 - p) / copies.size) ** 0.5, (part, bits)
        for run in runs:
            assert abs(sum(run[k].taken for k in own) - target[own[0]]) <= max(sizes) / 2


def test_mixing_takes_some_of_many_equal_rows(spark):
    """Copies of one row, where the rest of a source ends among them: as many as fill it."""
    rows = [(None, "a b c", "en", "a")] * 500 + [(7, "d e", "en", "a")] * 100 + [(k, "w " * (k % 9 + 1), "en", "b") for k in range(1_000, 1_300)]
    got = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(mixing.mix(docs(spark, rows).coalesce(1)).collect(), key=str)
    for source_size in {x.source_size for x in got}:
        own = [x for x in got if x.source_size == source_size]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 4.5
    copies = [x.copies for x in got if x.doc_id is None]
    assert len(copies) == 500 and set(copies) == {1, 2}


def test_mixing_sql_gives_the_same_rows(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(k if k % 9 else None, " ".join(f"w{k}" for _ in range(int(2 ** r.uniform(0, 8)) - 1)), "en", [None, "a", "b", "c", "d"][int(r.integers(0, 5) ** 2 // 5)]) for k in range(700)]
    rows += [(10_000, None, "en", "a"), (10_001, "", "en", "z")]
    folder = saved(spark, tmp_path, documents=docs(spark, rows))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    got = queries.op4_mixing(spark, folder)
    want = con.execute(queries.ORACLES["op4_mixing"]).fetchall()
    assert sorted(map(tuple, got.select("doc_id", "size", "source_size", "target", "taken", "copies").collect()), key=str) == sorted(want, key=str)


def test_samples_of_any_table():
    """A bounded sample, never an empty one: as many of 1e12 rows as of 1e6."""
    for count in (10**6, 10**9, 10**12, 10**18):
        share = (_sample.cutoff(2_000, count) + 1) / 2**63
        assert abs(share * count - 2_000) < 1
    assert _sample.cutoff(400, 400) == _sample.cutoff(400, 3) == 2**63 - 1


def test_samples_are_bounded_by_distinct_rows(spark):
    """A third of all rows without an id and of one text, or of one id: they count once."""
    rows = [(k, f"some words {k}", "en") for k in range(600)] + [(None, "the same words", "en")] * 300 + [(7, f"other words {k}", "de") for k in range(300)]
    assert langid.fit(docs(spark, rows), rows=100) is not None
    labels = spark.createDataFrame([(k, 1, int(k % 9 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    assert 350 < toxicity.sample(docs(spark, rows), labels).num_rows <= 600


def test_pipeline(spark, tmp_path):
    item = " ".join(f"bench{k}" for k in range(30))
    live = "ghp_Zq7Lk2Vw9Xb4Nc8Rt5Yp1Md6Hs3Jf0Ga8Eu2"
    clean = [(k, " ".join(f"t{k}x{j}" for j in range(40)), "en", "ab"[k % 2]) for k in range(10, 40)]
    rows = clean + [(1, None), (2, ""), (3, "you idiot stupid moron scum " * 3), (4, f"before {item} after", "en", "a"), (5, clean[0][1] + " more", "en", "b"), (6, f"key {live} end", "en", "a")]
    labels = spark.createDataFrame([(3, 0, 1)] + [(k, 1, 0) for k in range(10, 40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    folder = saved(spark, tmp_path, documents=docs(spark, rows), labels=labels, benchmark=bench)
    at = docs(spark, rows)
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at.columns
        at = stage(spark, at, folder)
        assert at.columns == before
        ids[name] = {r.doc_id for r in at.select("doc_id").collect()}
    every = {r[0] for r in rows}
    assert ids["toxicity"] == every - {3}
    assert ids["near_duplicates"] == every - {3, 10}  # 5 is nearly 10 and the smaller
    assert ids["decontamination"] == every - {3, 10, 4} == ids["secrets"]
    assert at.where("doc_id = 6").first().text == "key [SECRET] end"
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids["secrets"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    empty = saved(spark, tmp_path, documents=docs(spark, []), labels=labels.limit(0), benchmark=bench.limit(0))
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_near_duplicate_stage_keeps_rows_without_id(spark):
    d = docs(spark, [(None, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_duplicates(spark, d, "").collect()) == ["1", "None"]
    assert minhash.SHARP_ROWS * minhash.SHARP_BANDS == 1300
