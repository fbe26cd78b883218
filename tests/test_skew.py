"""One key holding a third (or more) of the rows: results stay whole and exact."""

import math

import pytest
from pyspark.sql import functions as F

from seqlabel.operators import curate as C
from seqlabel.operators import metrics as M
from seqlabel.operators import pool as PL
from seqlabel.operators import predict as P


def test_dedup_with_hot_copy_group(spark):
    rows = [(i, "HOT" if i % 3 == 0 else f"S{i}", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, sequence string, a int").repartition(7)
    out = {r["id"]: r for r in C.dedup_exact(df, ["a"], mode="union").collect()}
    assert out[0]["n_copies"] == 100 and out[0]["a"] == 1
    assert len(out) == 1 + 200


def test_softmax_hot_key(spark):
    rows = [(0 if i < 400 else i, i, float(i % 17)) for i in range(600)]
    df = spark.createDataFrame(rows, "key long, pos long, s double").repartition(6)
    w = PL.group_softmax(df, "key", "s")
    tot = {r["key"]: r["t"] for r in w.groupBy("key").agg(F.sum("weight").alias("t")).collect()}
    assert all(v == pytest.approx(1.0) for v in tot.values())
    hot = {r["pos"]: r["weight"] for r in w.filter("key = 0").collect()}
    z = sum(math.exp(i % 17 - 16) for i in range(400))
    assert hot[16] == pytest.approx(math.exp(0) / z)


def test_smoothing_hot_key_across_chunks(spark):
    vals = [float((i * 7) % 11) for i in range(500)]
    rows = [(1, i, v) for i, v in enumerate(vals)] + [(2, i, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "key long, t long, value double").repartition(5)
    got = {(r["key"], r["t"]): r["smoothed"] for r in PL.gaussian_smooth(df, "key", "t", "value", 2, chunk=64).collect()}
    w = PL.gaussian_weights(2)
    for i in range(500):
        want = sum(w[k + 2] * vals[min(max(i + k, 0), 499)] for k in range(-2, 3))
        assert got[(1, i)] == pytest.approx(want)
    assert len(got) == 520


def test_compare_runs_hot_key_keeps_left_duplicates(spark):
    a = spark.createDataFrame([(7, i, [1.0], [1]) for i in range(50)] + [(8, 0, [-1.0], [1])],
                              "id long, o long, logits array<double>, targets array<int>")
    b = spark.createDataFrame([(7, 5, [-1.0], [1]), (7, 2, [1.0], [1]), (8, 0, [1.0], [1])],
                              "id long, o long, logits array<double>, targets array<int>")
    c = P.compare_runs(a, b, key="id", order="o").collect()
    assert len(c) == 51
    hot = [r for r in c if r["id"] == 7]
    assert all(r["predicted_label_b"] == 1 and r["outcome"] == "both_right" for r in hot)   # first by o = 2
    assert [r["outcome"] for r in c if r["id"] == 8] == ["fixed"]


def test_ensemble_with_one_item_everywhere(spark):
    rows = [(r, 1, [1.0, -1.0], [1, 0]) for r in range(40)] + [(0, 2, [1.0, 1.0], [1, 1])]
    df = spark.createDataFrame(rows, "run int, id long, logits array<double>, targets array<int>").repartition(4)
    e = {r["id"]: r for r in M.ensemble(df, ["a", "b"]).collect()}
    assert e[1]["n_runs"] == 40 and e[1]["pred"] == [1, 0]


def test_softmax_over_a_wide_range_of_scores(spark):
    """Scores far apart lie on many steps; the states merge to the plain result."""
    import numpy as np
    rng = np.random.default_rng(9)
    scores = {0: rng.normal(0, 400, 300), 1: rng.normal(-3000, 1, 50), 2: np.array([5.0]), 3: np.array([float("-inf"), 1.0, 2.0]), 4: rng.normal(1e6, 50, 200)}
    rows = [(k, i, float(s), [float(s % 7), 1.0]) for k, v in scores.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "key long, pos long, s double, vec array<double>").repartition(7)
    got = {(r["key"], r["pos"]): r["weight"] for r in PL.group_softmax(df, "key", "s").collect()}
    for k, v in scores.items():
        e = np.exp(v - v.max())
        assert np.allclose([got[k, i] for i in range(len(v))], e / e.sum(), rtol=1e-7, atol=1e-12)


def test_pooling_is_one_lazy_plan(spark):
    """No statistic is written while the plan is built, and no row is joined."""
    import re
    rows = [(k, p, [float(k + p), 1.0, float(p * p % 5)], p < 3 + k % 4 and k != 5) for k in range(8) for p in range(7)]
    df = spark.createDataFrame(rows, "key long, pos long, vec array<double>, mask boolean")
    pooled = PL.pooled_vectors(df, [0.5, -0.5, 1.0])
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join|FileScan", plan)
    both = {r["key"]: r["pooled"] for r in pooled.collect()}
    assert len(both) == 8 and both[5] is None and all(len(v) == 3 for k, v in both.items() if k != 5)
