"""Hand-computed cells: ties, empty groups, NaN and extreme logits."""

import math

import pytest

from seqlabel.functions import arrays as fa
from seqlabel.operators import metrics as M

L3 = ["a", "b", "c"]
SCHEMA = "run int, id bigint, logits array<double>, targets array<int>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_threshold_vs_round_at_half(spark):
    # p = 0.5 exactly: threshold says 1, half-to-even rounding says 0
    df = frame(spark, [(0, 1, [0.0, 1.0, -1.0], [1, 1, 0])])
    r = df.select(fa.predict(fa.probs("logits")).alias("t"), fa.predict(fa.probs("logits"), mode="round").alias("r")).first()
    assert r["t"] == [1, 1, 0]
    assert r["r"] == [0, 1, 0]


def test_nan_predicts_zero_and_extremes(spark):
    df = frame(spark, [(0, 1, [float("nan"), 1000.0, -1000.0], [0, 1, 0])])
    r = df.select(fa.predict(fa.probs("logits")).alias("p"), fa.bce_cells("logits", "targets").alias("b")).first()
    assert r["p"] == [0, 1, 0]
    assert r["b"][1] == pytest.approx(0.0, abs=1e-12) and r["b"][2] == pytest.approx(0.0, abs=1e-12)


def test_label_without_positives_scores_zero(spark):
    # label c: never true, never predicted -> precision = recall = f1 = mcc = 0
    df = frame(spark, [(0, 1, [5.0, -5.0, -5.0], [1, 0, 0]), (0, 2, [-5.0, 5.0, -5.0], [0, 1, 0])])
    rep = M.label_report(M.confusion(df, ["run"], L3), ["run"]).orderBy("label_idx").collect()
    c = rep[2]
    assert (c["precision"], c["recall"], c["f1"], c["mcc"], c["support"]) == (0.0, 0.0, 0.0, 0.0, 0)
    assert rep[0]["f1"] == 1.0 and rep[0]["mcc"] == 1.0


def test_null_target_not_counted(spark):
    df = frame(spark, [(0, 1, [5.0, 5.0, 5.0], [1, None, 0])])
    conf = {r["label"]: r for r in M.confusion(df, ["run"], L3).collect()}
    assert conf["b"]["n"] == 0 and conf["b"]["n_null"] == 1
    assert conf["c"]["fp"] == 1


def test_confusion_matches_loop(spark):
    import random

    rnd = random.Random(3)
    rows = [(r, i, [rnd.uniform(-3, 3) for _ in L3], [rnd.randint(0, 1) for _ in L3]) for r in range(2) for i in range(60)]
    got = {(x["run"], x["label_idx"]): x for x in M.confusion(frame(spark, rows), ["run"], L3).collect()}
    for run in range(2):
        for j in range(3):
            tp = fp = fn = tn = eq = 0
            bce = 0.0
            for r, _, z, y in rows:
                if r != run:
                    continue
                p = 1 / (1 + math.exp(-z[j]))
                h = int(p >= 0.5)
                tp += h and y[j]
                fp += h and not y[j]
                fn += (not h) and y[j]
                tn += (not h) and not y[j]
                eq += int(round(p) == y[j])
                bce += max(z[j], 0) - z[j] * y[j] + math.log1p(math.exp(-abs(z[j])))
            g = got[(run, j)]
            assert (g["tp"], g["fp"], g["fn"], g["tn"], g["n_eq_round"]) == (tp, fp, fn, tn, eq)
            assert g["bce_sum"] == pytest.approx(bce, rel=1e-9)


def test_micro_between_label_extremes_and_weighted(spark):
    import random

    rnd = random.Random(7)
    rows = [(0, i, [rnd.uniform(-2, 2) for _ in L3], [rnd.randint(0, 1) for _ in L3]) for i in range(200)]
    conf = M.confusion(frame(spark, rows), ["run"], L3)
    rep = M.label_report(conf, ["run"]).collect()
    avg = M.avg_report(conf, ["run"]).first()
    f1s = [r["f1"] for r in rep]
    assert min(f1s) - 1e-12 <= avg["micro_f1"] <= max(f1s) + 1e-12
    assert avg["macro_f1"] == pytest.approx(sum(f1s) / 3)


def test_ensemble_tie_is_zero_and_identical_runs(spark):
    # two runs disagree on label a -> mean vote 0.5 -> strict > 0.5 gives 0
    df = frame(spark, [(0, 1, [5.0, 5.0, -5.0], [1, 1, 0]), (1, 1, [-5.0, 5.0, -5.0], [1, 1, 0])])
    e = M.ensemble(df, L3).first()
    assert e["pred"] == [0, 1, 0] and e["n_runs"] == 2
    same = frame(spark, [(r, 1, [5.0, -5.0, 5.0], [1, 0, 0]) for r in range(3)])
    assert M.ensemble(same, L3).first()["pred"] == [1, 0, 1]


def test_ensemble_check_raises_on_uneven_runs(spark):
    df = frame(spark, [(0, 1, [1.0, 1.0, 1.0], [1, 1, 1]), (1, 1, [1.0, 1.0, 1.0], [1, 1, 1]),
                       (0, 2, [1.0, 1.0, 1.0], [1, 1, 1])])
    with pytest.raises(ValueError):
        M.ensemble(df, L3, check=True)


def test_summarize_single_run_std_zero(spark):
    df = frame(spark, [(0, i, [1.0, -1.0, 1.0], [1, 0, i % 2]) for i in range(4)])
    res = M.run_results(df, L3)
    s = {r["metric"]: r for r in M.summarize_runs(res, L3).collect()}
    assert s["test_accuracy"]["std"] == 0.0 and s["test_accuracy"]["n_runs"] == 1


def test_best_so_far_ties_keep_first(spark):
    h = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.7), (4, 0.6)], "epoch int, acc double")
    r = M.best_so_far(h, "acc").orderBy("epoch").collect()
    assert [x["is_new_best"] for x in r] == [True, False, True, False]
    assert [x["best"] for x in r] == [0.5, 0.5, 0.7, 0.7]


def test_f1_vector_in_label_order(spark):
    df = frame(spark, [(0, 1, [5.0, -5.0, 5.0], [1, 1, 1])])
    v = M.f1_vector(M.confusion(df, ["run"], L3), ["run"]).first()["f1_per_label"]
    assert v == [1.0, 0.0, 1.0]


def test_confidence_is_max_softmax(spark):
    df = frame(spark, [(0, 1, [1.0, 2.0, 3.0], [0, 0, 1])])
    c = df.select(fa.confidence("logits").alias("c")).first()["c"]
    e = [math.exp(x) for x in (1, 2, 3)]
    assert c == pytest.approx(max(e) / sum(e))


def test_dominant_all_zero(spark):
    df = spark.createDataFrame([([0, 0, 0],), ([0, 1, 1],)], "t array<int>")
    r = df.select(fa.dominant("t", L3).alias("d"), fa.dominant("t", L3, on_empty="first").alias("f")).collect()
    assert r[0]["d"] is None and r[0]["f"] == "a"
    assert r[1]["d"] == "b"


def test_sample_metrics_empty_row_scores_zero(spark):
    df = frame(spark, [(0, 1, [-5.0, -5.0, -5.0], [0, 0, 0])]).withColumn("pred", fa.predict(fa.probs("logits")))
    r = M.sample_metrics(df, ["run"]).first()
    assert r["samples_f1"] == 0.0 and r["samples_accuracy"] == 1.0
