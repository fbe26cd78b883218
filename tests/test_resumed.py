"""Selections, stored counts, committed versions and side-by-side fits."""

import hashlib
import math
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlabel.operators import curate as C
from seqlabel.operators import metrics as M
from seqlabel.operators import score as SC
from seqlabel.operators import splits as S
from seqlabel.session import fresh_path
from seqlabel.sources import views as V
from seqlabel.streaming import running as ST

SF = "/root/testdata/sf0.001"


def order(ids, seed=77):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("limit", [50_000, 5, 1])
def test_selection_takes_the_first_of_the_order(spark, monkeypatch, limit):
    """Small limits, so that the boundary bucket is cut further and further."""
    monkeypatch.setattr(S, "BUCKET_ROWS", limit)
    df = spark.range(700).repartition(5)
    for n in (0, 1, 2, 333, 699, 700, 900):
        chosen, total = S.first_of(df, lambda _: n)
        assert total == 700 and {r["id"] for r in df.filter(chosen).collect()} == set(order(range(700))[:n])
    assert S.first_of(df.limit(0), lambda n: n) [1] == 0


def test_selection_falls_back_where_ids_repeat(spark):
    df = spark.createDataFrame([(i % 4,) for i in range(40)], "id long")
    s = S.split(df, test=0.3)
    assert s.filter("split = 'test'").count() == 12 and s.count() == 40
    assert S.sample_exact(df, 7).count() == 7


def test_split_of_a_wide_table_moves_no_rows(spark):
    wide = spark.range(300).select("id", *[F.lit("text" * 20).alias(f"c{i}") for i in range(12)])
    s = S.split(wide)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Sort|Window", plan)
    test = order(range(300))[:math.ceil(0.3 * 300)]
    assert {r["id"] for r in s.filter("split = 'test'").collect()} == set(test)


def test_rows_without_a_key_are_not_merged(spark):
    rows = [("k", "a", 1), ("k", "b", 0), (None, "a", 1), (None, "b", 0), (None, "a", 1)]
    d = spark.createDataFrame(rows, "key string, source string, SP int")
    out = C.merge_annotations(d, "key", ["SP"]).collect()
    assert sorted((r["key"] or "", r["SP"], r["SP_conflict"], r["sources"]) for r in out) == [
        ("", 0, False, ["b"]), ("", 1, False, ["a"]), ("", 1, False, ["a"]), ("k", 1, True, ["a", "b"])]
    two = {s: d.filter(F.col("source") == s).drop("source") for s in ("a", "b")}
    assert len(C.merge_annotations(two, "key", ["SP"]).collect()) == 4


def test_history_is_resumed_and_reads_new_epochs_only(spark):
    d = V.pred_v(spark, SF).withColumnRenamed("run", "epoch").withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("train"))
    path = fresh_path(spark, "epochs-test")
    first = M.store_epochs(d.filter("epoch < 2"), path)
    assert first.count() == 2
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rest = d.filter("epoch >= 2").count()
    watched = d.mapInArrow(seen, d.schema)
    # the stored epochs are filtered before the predictions are looked at
    done = M.store_epochs(d.filter("epoch in (0, 1)").unionByName(watched.filter("epoch >= 2")), path)
    want = sorted(map(tuple, M.history(d, ["epoch"], "split").select(sorted(done.columns)).collect()))
    got = sorted(map(tuple, done.select(sorted(done.columns)).collect()))
    assert np.allclose(np.array(got, float), np.array(want, float)) and len(got) == 5
    assert read.value == d.count() and rest
    again = M.store_epochs(d.filter("epoch < 5"), path)         # nothing is left to add
    assert sorted(map(tuple, again.select(sorted(done.columns)).collect())) == got


def metrics_of(t):
    return sorted((r["run"], r["label_idx"], r["tp"], r["fp"], r["fn"], r["tn"], r["n"]) for r in t.collect())


def test_update_mode_equals_complete_mode(spark):
    out = {}
    for mode in ("complete", "update"):
        path, ck = fresh_path(spark, f"h1-{mode}"), fresh_path(spark, f"h1-{mode}-ck")
        stream = V.pred_from_embeddings(V.embeddings_files(spark, SF))
        ST.run_to_table(ST.running_metrics(stream, ["run"]), path, ck, mode=mode, keys=["run", "label_idx"] if mode == "update" else ())
        out[mode] = metrics_of(ST.latest(spark, path))
    assert out["update"] == out["complete"] and len(out["update"]) == 50
    with pytest.raises(ValueError, match="keys"):
        ST.run_to_table(None, "x", "y", mode="update")


def test_a_version_without_its_mark_is_not_read(spark):
    path, ck = fresh_path(spark, "h1-marks"), fresh_path(spark, "h1-marks-ck")
    ST.run_to_table(ST.running_metrics(V.pred_from_embeddings(V.embeddings_files(spark, SF)), ["run"]), path, ck)
    want = metrics_of(ST.latest(spark, path))
    half = ST.latest(spark, path).limit(3).withColumn("tp", F.lit(10**6).cast("long"))
    half.write.parquet(f"{path}/version=99")        # written, not committed
    assert metrics_of(ST.latest(spark, path)) == want
    assert ST.committed(spark, path) == 3 and ST.committed(spark, path, 2) == 1 and ST.committed(spark, path, 0) is None
    with pytest.raises(ValueError, match="no complete version"):
        ST.latest(spark, fresh_path(spark, "h1-none"))


def test_labels_are_fitted_side_by_side(spark, monkeypatch):
    """Each fit waits for another one to have started."""
    gate, real = threading.Barrier(2, timeout=60), SC.LogisticRegression.fit
    monkeypatch.setattr(SC.LogisticRegression, "fit", lambda self, d: gate.wait() is None or real(self, d))
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x @ rng.normal(size=(4, 2)) + rng.normal(size=(300, 2)) > 0).astype(int)
    d = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "features array<double>, targets array<int>")
    rows = SC.fit_multilabel(d, labels=["a", "b"], reg=0.05, max_iter=300, tol=1e-14, at_once=2).orderBy("label_idx").collect()
    for k, r in enumerate(rows):
        p = 1 / (1 + np.exp(-(x @ np.array(r["weights"]) + r["bias"])))
        assert np.allclose((p[:, None] * x).mean(0) + 0.05 * np.array(r["weights"]), (y[:, k, None] * x).mean(0), atol=1e-6)
