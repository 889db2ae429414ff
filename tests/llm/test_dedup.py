"""op6, op7, op8, op10 against brute force on small tables with groups of copies, near copies and awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.llm import _links, decontam, embedding, minhash, queries, substring

from .fixtures import docs, saved


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(r, text, edits):
    text = text[:]
    for _ in range(edits):
        text[r.randrange(len(text))] = f"z{r.randrange(10_000)}"
    return text


def corpus(seed=1):
    """Texts with copies, near copies of all degrees, a passage in many, short, empty and null ones."""
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One  TWO"), (5, "one two three four"), (6, "a b c"), (7, "É é x y z"), (8, "é é x y z")]
    base, passage = words(r, 150), words(r, 60)
    texts = [base[:] for _ in range(6)] + [edited(r, base, k % 12) for k in range(60)]
    texts += [words(r, r.randrange(5, 80)) + passage + words(r, r.randrange(5, 80)) for _ in range(40)]
    texts += [words(r, r.randrange(1, 120)) for _ in range(60)]
    texts += [base[:75] + base[:75], base[:25] * 4, words(r, 3000)]
    r.shuffle(texts)
    return rows + [(100 + 3 * k, " ".join(t)) for k, t in enumerate(texts)]


def components(ids, links):
    at = {i: i for i in ids}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute_minhash(rows, width, percent):
    """(id, size, component, kept) of each row; links are of rows, and rows without id have none."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    own = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    links = [(a, b) for x, a in enumerate(own) for b in own[x + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    c = components(range(len(rows)), links)
    least = {}
    for k in own:
        least[c[k]] = min(least.get(c[k], rows[k][0]), rows[k][0])
    ids = [least.get(c[k], i) for k, (i, _) in enumerate(rows)]
    return sorted(((i, len(sets[k]), ids[k], i is None or ids[k] == i) for k, (i, _) in enumerate(rows)), key=str)


def minhash_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_minhash(spark, tmp_path):
    rows = corpus()
    folder = saved(spark, tmp_path, documents=docs(spark, rows).repartition(3))
    assert minhash_rows(queries.op6_minhash(spark, folder)) == brute_minhash(rows, 4, 80)


def test_minhash_of_repeated_and_null_ids(spark):
    """Different texts under one id, and rows without an id: every row by the links of its own text, and no row twice."""
    a, b, c = "a b c d e f g h", "i j k l m n o p", "q r s t u v w x"
    probe = [(1, a), (5, a), (5, b), (7, c)]
    assert minhash_rows(minhash.minhash_components(docs(spark, probe), 4)) == [(1, 5, 1, True), (5, 5, 1, False), (5, 5, 5, True), (7, 5, 7, True)]
    rows = [(None if i % 7 == 0 else i // 9, t) for i, t in corpus(6)] + [(9, a), (9, a), (9, b), (None, a), (2, b), (2, b + " y")]
    d = docs(spark, rows).repartition(3)
    assert minhash_rows(minhash.minhash_components(d, 4)) == brute_minhash(rows, 4, 80)
    stay = minhash.without_duplicates(d, 4)
    kept = [r for r in brute_minhash(rows, 4, 80) if r[3]]
    assert stay.columns == d.columns and sorted((str(r.doc_id) for r in stay.collect())) == sorted(str(r[0]) for r in kept)


def test_minhash_blocks(spark, monkeypatch):
    """The same where clusters are split into many blocks."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", 7)
    rows = corpus(2)
    assert minhash_rows(minhash.minhash_components(docs(spark, rows), 4)) == brute_minhash(rows, 4, 80)


def test_minhash_repeats_and_empty(spark):
    d = docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.minhash_components(d).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]
    assert minhash.minhash_components(d.limit(0)).collect() == []


def test_signature_estimates_jaccard():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate([a[:400], r.integers(0, 2**63, 200).astype(np.uint64)])
    same = (minhash.signature(np.unique(a), 2000) == minhash.signature(np.unique(b), 2000)).mean()
    assert abs(same - 400 / 800) < 0.05


def brute_repeats(rows, window=20):
    """(id, words, removed, hash) of each row; rows of null id come last, by the hash of their text."""
    order = sorted({t for i, t in rows if i is None}, key=lambda t: substring_hash[t])
    place = lambda i, t: (1 << 63, order.index(t)) if i is None else (i, 0)
    first, texts = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        texts.append((i, place(i, t), w))
        for s in range(len(w) - window + 1):
            at, run = (*place(i, t), s), tuple(w[s : s + window])
            first[run] = min(first.get(run, at), at)
    out = []
    for i, at, w in texts:
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] != (*at, s) for p in range(s, s + window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


#: xxhash64 of the texts of rows without id, as Spark gives it.
substring_hash = {}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring(spark, tmp_path, seed):
    rows = corpus(seed) + [(900_000, "x " * 100), (900_001, "x y " * 50), (900_002, "é " * 30 + "\x0b" + "q " * 25)]
    folder = saved(spark, tmp_path, documents=docs(spark, rows).repartition(3))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substring(spark, folder).collect()), key=str)
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_substring_of_repeated_and_null_ids(spark, seed):
    """Different texts under one id, and several rows without an id: every row by the places of its own text."""
    r = random.Random(seed)
    a, x, y = words(r, 30), words(r, 30, 10**6), words(r, 40, 10**6)
    probe = [(1, a), (2, a), (2, x), (None, a), (None, y)]
    found = sorted((str(z.doc_id), z.n_removed) for z in substring.remove_repeats(docs(spark, [(i, " ".join(t)) for i, t in probe])).collect())
    assert found == [("1", 0), ("2", 0), ("2", 30), ("None", 0), ("None", 30)]
    rows = [(i if i % 7 else None, t) for i, t in corpus(seed)]
    rows = [(None if i is None else i // 9, t) for i, t in rows] + rows[20:30] + [(None, " ".join(a + y)), (None, " ".join(x + a)), (3, " ".join(a + x)), (3, " ".join(y + a)), (3, " ".join(y[:5] + x + a))]
    d = docs(spark, rows).repartition(3)
    substring_hash.update({z.text: z.h for z in d.where("doc_id is null").selectExpr("text", "xxhash64(text) as h").collect()})
    got = sorted(((z.doc_id, z.n_words, z.n_removed, z.kept_sha256) for z in substring.remove_repeats(d).collect()), key=str)
    assert got == brute_repeats(rows)


def test_matched_gives_the_same_for_hot_keys(spark):
    """Keys with many rows and keys with few: all rows, once."""
    rows = spark.createDataFrame([(k % 5 if k < 3_000 else k, k) for k in range(6_000)], "key long, x long")
    sums = rows.groupBy("key").agg(F.count("x").alias("rows")).where("key % 2 = 0")
    got = _links.matched(rows, sums, "key").orderBy("x").collect()
    assert [(g.key, g.x) for g in got] == [(key, k) for k in range(6_000) for key in [k % 5 if k < 3_000 else k] if key % 2 == 0]


def test_substring_repeats_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(30))
    d = docs(spark, [(5, text), (5, text), (None, text), (4, "short")])
    assert sorted((str(r.doc_id), r.n_removed) for r in substring.remove_repeats(d).collect()) == [("4", 0), ("5", 0), ("5", 0), ("None", 30)]
    assert substring.remove_repeats(d.limit(0)).collect() == []


def brute_leaks(rows, items, similar=0.8):
    """Items and their similarity for each row, from strings alone: weighted Jaccard of sets of five words, at every start."""
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = {i: (len(split(t)), shingles(split(t))) for i, t in items if len(split(t)) >= 5}
    holders = Counter(x for _, s in sets.values() for x in s)
    weigh = lambda s: sum(math.log(1 + len(sets) / max(1, holders[x])) for x in s)
    out = []
    for i, t in rows:
        w, found = split(t), {}
        own = shingles(w)
        for item, (n, s) in sets.items():
            if not s & own or weigh(s & own) < similar * weigh(s) - 1e-9:
                continue
            best = max(weigh(s & x) / weigh(s | x) for k in range(max(1, len(w) - n + 1)) for x in [shingles(w[k : k + n])])
            if best >= similar - 1e-9:
                found[item] = best
        out.append((i, found))
    return out


def planted(seed, count):
    """Benchmark items, and rows that hold them whole, with words changed, cut off at an end, or in part."""
    r = random.Random(seed)
    items = [(k, " ".join(words(r, r.choice([12, 20, 30, 64, 150]) + r.randrange(12), 5000))) for k in range(60)] + [(900, None), (901, "too short"), (902, "")]
    rows = [(0, None), (1, ""), (2, "four words are few"), (None, "x " + items[3][1])]
    for k in range(count):
        item = items[r.randrange(60)][1].split()
        kind = r.randrange(5)
        if kind == 1:
            item = edited(r, item, r.randrange(1, 3))
        elif kind == 2:
            item = item[r.randrange(len(item) // 6 + 1) :]
        elif kind == 3:
            item = item[: len(item) - r.randrange(len(item) // 6 + 1)] + words(r, 3, 5000)
        inside = item if kind else []
        rows.append((10 + k, " ".join(words(r, r.randrange(80), 5000) + inside + words(r, r.randrange(80), 5000))))
    return items, rows


def test_leaks_against_every_window(spark, tmp_path):
    items, rows = planted(5, 400)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {x.doc_id: {s.item: s.similarity for s in x["items"]} for x in decontam.find_leaks(docs(spark, rows), bench).collect()}
    want = dict(brute_leaks(rows, items))
    hits = sum(len(x) for x in want.values())
    got = sum(len(set(found[i]) & set(want[i])) for i in want)
    assert hits > 200 and got >= 0.99 * hits, (got, hits)
    assert all(found[i][item] == pytest.approx(want[i][item]) for i in found for item in found[i])  # none that is not there
    clean = decontam.without_leaks(docs(spark, rows), bench)
    assert clean.columns == docs(spark, rows).columns and clean.count() == sum(not x for x in found.values())
    folder = saved(spark, tmp_path, documents=docs(spark, rows), benchmark=bench)
    assert sum(x.contaminated for x in queries.op8_decontamination(spark, folder).collect()) == sum(bool(x) for x in found.values())
    assert decontam.find_leaks(docs(spark, rows[:3]), bench.limit(0)).where("size(items) > 0").count() == 0


def test_blocks_prune_and_miss_none_within_the_radius():
    r = np.random.default_rng(2)
    codes = r.integers(0, 1 << (decontam.BITS // decontam.BLOCKS), (2_000, decontam.BLOCKS)).astype(np.uint32)
    index = decontam.Blocks(codes)
    share = len(index.candidates(r.integers(0, 1 << 18, (60, decontam.BLOCKS)).astype(np.uint32))[0]) / 60 / 2_000
    assert share < 0.05, share
    few = decontam.Blocks(np.concatenate([codes[:300], codes[:20]]))  # with equal ones, and so few that they are compared
    for away in (0, 10, 25, decontam.RADIUS, decontam.RADIUS + 1):
        bits = np.zeros((40, decontam.BITS), bool)
        for k in range(40):
            bits[k, r.choice(decontam.BITS, away, replace=False)] = True
        asked = codes[:40] ^ decontam._code(bits.astype(int)).astype(np.uint32)
        distance = np.bitwise_count(asked[:, None] ^ codes[None]).sum(axis=2)
        want = list(zip(*np.nonzero(distance <= decontam.RADIUS)))
        assert list(zip(*index.within(asked))) == want and len(want) >= 40 * (away <= decontam.RADIUS)
        distance = np.bitwise_count(asked[:, None] ^ few.codes[None]).sum(axis=2)
        assert list(zip(*few.within(asked))) == list(zip(*np.nonzero(distance <= decontam.RADIUS)))


def test_leaks_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SLICE_CHARS", 100)
    items = [(k, " ".join(f"b{k}w{j}" for j in range(20))) for k in range(10)]
    d = docs(spark, [(1, items[2][1]), (None, items[3][1]), (2, "none")]).withColumns({"row": F.lit(1), "_row": F.lit(2), "items": F.lit(3)})
    clean = decontam.without_leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == d.columns and [x.doc_id for x in clean.collect()] == [2]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, key int")


def test_embeddings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    r = np.random.default_rng(3)
    centre = r.standard_normal((4, 16))
    rows = [(k, [float(x) for x in centre[k % 4] + r.standard_normal(16) * (0.1 + 0.05 * (k % 3))], k % 3 if k % 11 else None, 1, 2) for k in range(400)]
    rows += [(1000 + k, rows[4][1], rows[4][2], 1, 2) for k in range(5)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(2000 + k, v, 1, 1, 2) for k, v in enumerate(odd)]
    folder = saved(spark, tmp_path, embeddings=embeddings(spark, rows))
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in queries.op10_embedding(spark, folder).collect()}
    good = {i: (label, np.array(v, float)) for i, v, label, _, _ in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = defaultdict(set)
    for a, (la, va) in good.items():
        for b, (lb, vb) in good.items():
            if a != b and la == lb and len(va) == len(vb) and va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= 0.98:
                links[a].add(b)
    c = components([x[0] for x in rows], [(a, b) for a in links for b in links[a]])
    assert got == {i: (len(links[i]), c[i], c[i] == i) for i in c} and sum(map(len, links.values())) > 500


def test_embeddings_without_id(spark):
    """Rows of null vec_id link as others do, also as the first of their class."""
    v, w, u = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [-1.0, 5.0, 0.0]
    rows = [(3, v, 1), (None, w, 1), (None, v, 1), (9, w, 1), (None, u, 1), (None, u, 2), (4, u, 2), (4, v, 2), (None, None, 1)]
    got = embedding.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(3, 3, 3, True), (None, 3, 3, False), (None, 3, 3, False), (9, 3, 3, False), (None, 0, None, True), (None, 1, 4, False), (4, 1, 4, True), (4, 0, 4, True), (None, 0, None, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_estimate_is_unbiased_and_bounded():
    r = np.random.default_rng(5)
    x = embedding.unit(r.standard_normal((300, 64)))
    turn = embedding.rotations(64)
    code, factor = embedding.encode(x, turn)
    turned = np.einsum("nd,kde->nke", x, turn).reshape(len(x), -1)
    estimate = np.where(code, 1.0, -1.0) @ turned.T / (len(turn) * 8) / factor[:, None]
    error = estimate - x @ x.T
    np.fill_diagonal(error, 0)
    assert abs(error.mean()) < 2e-3 and np.abs(error).max() < embedding.ERRORS * (np.sqrt(1 - factor**2) / factor / np.sqrt(255)).max()


def pairs_at(cosine, n, dim, seed):
    r = np.random.default_rng(seed)
    x, y = embedding.unit(r.standard_normal((n, dim))), r.standard_normal((n, dim))
    y = embedding.unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


def test_tables_miss_no_more_than_they_say_in_large_labels():
    tables = embedding.table_planes(10_000_000, 64, 0.98)
    missed = 0
    for seed in range(10):
        x, y = pairs_at(0.98, 20_000, 64, seed)
        missed += int((embedding._keys(x, tables) != embedding._keys(y, tables)).all(axis=1).sum())
    assert missed <= 3  # 0.2 expected


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = corpus(7)
    folder = saved(spark, tmp_path, documents=docs(spark, rows))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLES["op7_substring"]).fetchall()
    assert sorted(map(tuple, queries.op7_substring(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == sorted(want)


def test_leaks_do_not_depend_on_slices(spark, monkeypatch):
    r = random.Random(8)
    shared = words(r, 30, 5000)  # half of the items hold it
    items = [(k, " ".join(words(r, 30, 5000) + shared * (k % 2))) for k in range(40)]
    rows = [(None if k == 7 else k, " ".join(edited(r, items[k % 40][1].split(), k % 3))) for k in range(80)] + [(100, None), (101, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found():
        leaks = [(x.doc_id, [(s.item, round(s.similarity, 9)) for s in x["items"]]) for x in decontam.find_leaks(docs(spark, rows), bench).collect()]
        clean = [x.doc_id for x in decontam.without_leaks(docs(spark, rows), bench).collect()]
        return sorted(leaks, key=str), sorted(clean, key=str)

    whole = found()
    monkeypatch.setattr(decontam, "SLICE_CHARS", 3_000)
    assert decontam.indexes(bench)[0] > 1 and found() == whole
