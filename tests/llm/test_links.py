"""Components of chains, stars, trees and random links; sieves."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from nearfold.llm import minhash, substring
from nearfold.llm._links import components, sifted

from .fixtures import docs


def test_components(spark):
    r = random.Random(2)
    chain = [(k, k + 1) for k in range(60)]
    shuffled = r.sample(range(100, 180), 80)
    path = list(zip(shuffled[:-1], shuffled[1:]))
    star = [(250, k) for k in range(200, 240)]
    loose = [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(90)]
    links = chain + path + star + loose + [(7, 7), (2, 1)]
    at = {x: x for p in links for x in p}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    got = {x.id: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for p in links if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sieve_splits_rows_and_loses_no_key(spark):
    rows = [(None if k % 50 == 0 else k, k % 7, k, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, word long, `mask.x` long")
    keys = df.where("word % 10 = 0").select("a", "b")
    some, rest = (x.collect() for x in sifted(df, keys, {"a": F.col("a"), "b": F.col("b")}))
    assert sorted(r.word for r in some + rest) == list(range(3000))
    assert {r.word for r in some} >= set(range(0, 3000, 10))
    assert len(some) < 310  # 300 rows of keys, and few by chance
    some, rest = sifted(df, keys.limit(0), {"a": F.col("a"), "b": F.col("b")})
    assert (some.count(), rest.count()) == (0, 3000)
    assert some.columns == rest.columns == df.columns


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_task_of_substring_has_one_python_worker(spark):
    words = " ".join(f"w{k}" for k in range(40))
    plan = _plan(substring.remove_repeats(docs(spark, [(1, words), (2, "x " + words), (3, "a b")])))
    assert plan.count("MapInArrow") == 2  # of rows with repeats, and of the others


def test_near_duplicates_shuffle_only_texts_that_may_go(spark):
    words = " ".join(f"w{k}" for k in range(40))
    out = minhash.without_duplicates(docs(spark, [(1, words), (2, words), (3, "a b c"), (4, None)]))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    gone = _plan(out).partition("LeftAnti")[2]
    assert "bit_get" in gone  # a sieve stands before the join
