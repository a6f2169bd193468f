"""op1: exact search against all inner products in integers of any size; pruning on clustered vectors."""

import math

import numpy as np
import pytest
from codequarry.llm import queries, topk
from codequarry.llm.common import Scratch
from pyspark.sql import functions as F
from test_sql import compare

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, is_query, k, scale=1024):
    sound = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sound:
        if is_query(q):
            cut = lambda s: max(-(2**63), min(2**63 - 1, s))
            found = sorted((-cut(sum(x * y for x, y in zip(a, b))), i) for i, b in sound if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def search(spark, rows, k=3, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 2 == 0, Scratch(spark), k).select("query_id", "rank", "vec_id", "score").collect()))


def test_same_as_sql(spark):
    compare(spark, "op1_exact_top_k")


def test_random(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 37)
    g = np.random.default_rng(3)
    rows = [(i, g.normal(size=5).tolist()) for i in range(300)]
    assert search(spark, rows) == brute(rows, lambda i: i % 2 == 0, 3)


def test_nulls_lengths_ties_repeats(spark):
    nan = float("nan")
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [float("inf")]), (7, []), (8, [2.0]), (None, [9.0]), (9, [0.5, 0.5, 0.5]), (10, [-1.0])]
    assert search(spark, rows, 4) == brute(rows, lambda i: i % 2 == 0, 4)


def test_no_clamp(spark):
    rows = [(0, [1 / 1024]), (1, [2.0**35]), (3, [2.0**33]), (5, [2.0**35 + 1]), (7, [-(2.0**60)]), (9, [2.0**52 + 0.0]), (2, [3e5, 2.0**30]), (11, [2.0**30, 1.0])]
    got = search(spark, rows, 9)
    assert got == brute(rows, lambda i: i % 2 == 0, 9)
    assert (0, 1, 9, 2**62) in got and (0, 2, 5, 2**45 + 2**10) in got


def test_beyond_a_long(spark):
    rows = [(0, [2.0**40]), (1, [2.0**40]), (3, [1.7e308]), (5, [-1e300]), (7, [1.0])]
    assert search(spark, rows, 9) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 7, 2**60), (0, 4, 5, -(2**63))]


def test_empty_and_clashing_columns(spark):
    assert search(spark, []) == [] and search(spark, [(1, [1.0])]) == [] and search(spark, [(0, [1.0])]) == []
    df = spark.createDataFrame([(0, [1.0], 1, 1, 1), (1, [2.0], 1, 1, 1)], SCHEMA + ", code int, shard int, _x int")
    assert topk.top_k(df, F.col("vec_id") == 0, Scratch(spark), 3).collect()[0][:] == (0, 1, 1, 1024 * 2048)


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 50)
    rows = [(1, [1.0, 2.0])] * 400 + [(i, [float(i % 7), 1.0]) for i in range(2, 200)]
    assert search(spark, rows, 5) == brute(rows, lambda i: i % 2 == 0, 5)


def test_blocks_are_pruned_where_vectors_cluster():
    g = np.random.default_rng(1)
    centers = g.normal(size=(40, 16)) * 1000
    codes = np.floor(np.repeat(centers, 64, axis=0) + g.normal(size=(2560, 16)) * 10)
    shard = topk.Shard(np.arange(2560), codes)
    q = codes[::100]
    least = np.full(len(q), np.iinfo(np.int64).min)
    best, scored = shard.search(np.arange(2560)[::100], q, least, 10)
    assert scored < 0.1 * len(q) * len(shard.starts)
    everything = topk.scores(q, codes)
    for i, (s, ids) in enumerate(best):
        own = np.delete(everything[i], i * 100)
        assert s.tolist() == np.sort(own)[::-1][:10].tolist()
    # what is known before saves blocks too, and loses nothing
    kth = np.array([s[-1] for s, _ in best])
    again, fewer = shard.search(np.arange(2560)[::100], q, kth, 10)
    assert fewer <= scored and all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(again, best))


@pytest.mark.parametrize("q, d", [([[2**31]], [[2**31 - 1]]), ([[-(2**53), 1]], [[2**53, -1]])])
def test_scores_are_whole(q, d):
    want = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q[0], d[0]))))
    assert topk.scores(np.array(q, float), np.array(d, float)).tolist() == [[want]]


def test_registered(spark):
    assert queries.QUERIES["op1_exact_top_k"](spark, "/root/testdata/sf0.001").columns == ["query_id", "rank", "vec_id", "score"]
