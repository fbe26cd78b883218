"""Smoothing, softmax, pooling, kNN and streaming restart."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlabel.operators import diagnose as DG
from seqlabel.operators import pool as PL
from seqlabel.sources import views as V
from seqlabel.streaming import running as ST

SF = "/root/testdata/sf0.001"


def smooth_ref(x, sigma=2):
    w = PL.gaussian_weights(sigma)
    n = len(x)
    return [sum(w[k + sigma] * x[min(max(i + k, 0), n - 1)] for k in range(-sigma, sigma + 1)) for i in range(n)]


def test_gaussian_weights_fixed_values():
    # kernel of a Gaussian with sigma 2 truncated at one sigma
    assert PL.gaussian_weights(2) == pytest.approx([0.152469, 0.221841, 0.251379, 0.221841, 0.152469], abs=1e-6)
    assert PL.gaussian_weights(0) == [1.0]


@pytest.mark.parametrize("chunk", [3, 65536])
def test_smooth_matches_loop_short_series_and_chunks(spark, chunk):
    rows = []
    series = {1: [5.0], 2: [1.0, 3.0], 3: [float(i * i % 7) for i in range(11)], 4: [2.0] * 6}
    for k, xs in series.items():
        for i, x in enumerate(xs):
            rows.append((k, 100 - i, i, x))      # order column decreasing, t increasing
    df = spark.createDataFrame(rows, "key long, neg long, t long, value double")
    got = {(r["key"], r["t"]): r["smoothed"] for r in PL.gaussian_smooth(df, "key", ["t"], "value", 2, chunk=chunk).collect()}
    for k, xs in series.items():
        want = smooth_ref(xs)
        for i in range(len(xs)):
            assert got[(k, i)] == pytest.approx(want[i], abs=1e-12)
    # constants stay constant
    assert all(got[(4, i)] == pytest.approx(2.0) for i in range(6))
    dense = PL.gaussian_smooth(df, "key", ["t"], "value", 2, dense_pos="t", chunk=chunk).collect()
    assert {(r["key"], r["t"]): r["smoothed"] for r in dense} == pytest.approx(got)


def test_softmax_sums_to_one_and_masked_zero(spark):
    df = spark.createDataFrame([(1, 0, 1.0, True), (1, 1, 2.0, True), (1, 2, 9.0, False), (2, 0, 0.5, False)],
                               "key long, pos long, s double, m boolean")
    r = {(x["key"], x["pos"]): x["weight"] for x in PL.group_softmax(df, "key", "s", "m").collect()}
    assert r[(1, 0)] + r[(1, 1)] == pytest.approx(1.0) and r[(1, 2)] == 0.0
    assert r[(1, 1)] / r[(1, 0)] == pytest.approx(math.e)
    assert r[(2, 0)] is None


def test_attention_pool_against_numpy(spark):
    q = [((7 * j) % 5 - 2) / 10.0 for j in range(64)]
    pos = V.pos_v(spark, SF)
    pooled, att = PL.attention_pool(pos, q)
    got = {r["key"]: np.array(r["pooled"]) for r in pooled.collect()}
    pdf = pos.toPandas()
    for key, g in pdf.groupby("key"):
        g = g.sort_values("pos")
        live = g[g["mask"]]
        X = np.stack(live["vec"].to_numpy())
        ln = (X - X.mean(1, keepdims=True)) / np.sqrt(X.var(1, keepdims=True) + 1e-5)
        s = smooth_ref(list(ln @ np.array(q)))
        w = np.exp(np.array(s) - max(s))
        w /= w.sum()
        assert np.allclose(got[key], (w[:, None] * ln).sum(0), atol=1e-9)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, features array<double>")
    got = DG.knn(df, "features", k=5, block_rows=16, fan=2).collect()     # 6 blocks: a 3-level merge
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["rank"], r["nbr"]))
    for i in range(90):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(1))
        d[i] = np.inf
        want = sorted(range(90), key=lambda j: (d[j], j))[:5]
        assert [n for _, n in sorted(by[i])] == want


def test_pca_scores_centred(spark):
    pts, ev = DG.pca_points(V.pred_v(spark, SF).filter("run = 0").select("id", F.col("logits").alias("features"), "targets"))
    m = pts.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    assert abs(m["x"]) < 1e-9 and abs(m["y"]) < 1e-9
    v = [r["explained_variance"] for r in ev.orderBy("component").collect()]
    assert v[0] >= v[1] > 0


def test_streamed_counters_equal_batch(spark):
    from seqlabel.operators import metrics as M
    from seqlabel.session import fresh_path

    out, ck = fresh_path(spark, "t-h1"), fresh_path(spark, "t-h1c")
    ST.run_to_table(ST.running_metrics(V.pred_from_embeddings(V.embeddings_stream(spark, SF), 1), ["run"]), out, ck)
    s = {r["label_idx"]: r for r in spark.read.parquet(out).collect()}
    b = {r["label_idx"]: r for r in M.confusion(V.pred_v(spark, SF, runs=1), ["run"]).collect()}
    for i in range(10):
        assert (s[i]["tp"], s[i]["fp"], s[i]["fn"], s[i]["tn"]) == (b[i]["tp"], b[i]["fp"], b[i]["fn"], b[i]["tn"])


def test_resumable_scoring_no_loss_no_double(spark):
    from seqlabel.operators.score import numpy_linear_loader, rule_head
    from seqlabel.session import fresh_path

    src = fresh_path(spark, "t-h2src")
    e = V.table(spark, SF, "embeddings")
    e.filter("vec_id < 250").repartition(3).write.parquet(src + "/a")
    w, b = rule_head(10, 64)
    out, ck = fresh_path(spark, "t-h2out"), fresh_path(spark, "t-h2ck")

    def run():
        st = spark.readStream.schema(V.EMBEDDINGS_SCHEMA).option("recursiveFileLookup", "true").parquet(src) \
            .select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
        ST.score_stream(st, "x", numpy_linear_loader(w, b), 10, 64, out, ck)

    run()
    assert spark.read.parquet(out).count() == 250
    e.filter("vec_id >= 250").repartition(2).write.parquet(src + "/b")
    run()
    res = spark.read.parquet(out)
    assert res.count() == 500 and res.select("id").distinct().count() == 500


def test_batch_log_idempotent(spark):
    from seqlabel.session import fresh_path

    out = fresh_path(spark, "t-h3")
    for _ in range(2):      # a second run with a fresh checkpoint replays batch 0 over itself
        ST.batch_log(V.pred_from_embeddings(V.embeddings_stream(spark, SF), 1), out, fresh_path(spark, "t-h3c"))
    t = spark.read.parquet(out).collect()
    assert len(t) == 1 and t[0]["n"] == 500
