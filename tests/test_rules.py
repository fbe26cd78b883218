"""Missing values, repeated ids, threshold edges and hot keys."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlabel.operators import curate as C
from seqlabel.operators import diagnose as DG
from seqlabel.operators import encode as E
from seqlabel.operators import metrics as M
from seqlabel.operators import pool as PL
from seqlabel.operators import predict as P
from seqlabel.operators import similarity as SIM
from seqlabel.operators import splits as S
from seqlabel.plans.catalog import queries

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# ------------------------------------------------------------- similarity bounds
@pytest.mark.parametrize("t,q", [(0.7, 3), (0.8, 3), (0.9, 3), (0.95, 3), (0.6, 2), (0.9, 5), (1.0, 3)])
def test_shared_grams_holds_for_every_partner_length(t, q):
    for l in range(1, 400):
        for L in range(l, int(l / t) + 2):
            if l < t * L - 1e-9:
                break
            edits = math.floor((1 - t) * L + 1e-9)
            least = L - q + 1 - q * edits      # shared grams of a pair of these lengths
            assert SIM.shared_grams(l, t, q) <= max(least, 0) or SIM.shared_grams(l, t, q) <= least
            assert SIM.shared_grams(L, t, q) <= least


@pytest.mark.parametrize("t,a,b", [
    (0.8, "ABCDEFGHIJKLMN", "AB0DE1GH2IJKLMN"),
    (0.9, "ABCDEFGHIJKLMNOPQRSTUVWXYZabc", "ABCDEFGHI0JKLMNOPQR1TUVWXYZab2"),
])
def test_kmer_mode_keeps_pairs_across_step_boundaries(spark, t, a, b):
    assert 1 - distance(a, b) / max(len(a), len(b)) >= t - 1e-9
    rng = random.Random(1)
    rows = [(1, a), (2, b)] + [(i, "".join(rng.choice("KLMNO") for _ in range(25))) for i in range(3, 30)]
    df = spark.createDataFrame(rows, "id long, sequence string")
    for group in (256, 1):
        assert (1, 2) in {(r["id"], r["ref_id"]) for r in SIM.similar_pairs_kmer(df, None, t, max_group=group).collect()}


def test_kmer_mode_against_brute_force_at_step_boundaries(spark):
    rng = random.Random(7)
    seqs = []
    for n in list(range(10, 40)) * 2:
        s = [rng.choice("ABCDEFGH") for _ in range(n)]
        seqs.append("".join(s))
        for _ in range(max(1, n // 8)):
            i = rng.randrange(len(s))
            s[i:i + 1] = rng.choice([[], ["x"], [s[i], "y"]])
        seqs.append("".join(s))
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, sequence string")
    want = {(i, j) for i in range(len(seqs)) for j in range(i + 1, len(seqs))
            if 1 - distance(seqs[i], seqs[j]) / max(len(seqs[i]), len(seqs[j])) >= 0.8 - 1e-9}
    got = {(r["id"], r["ref_id"]) for r in SIM.similar_pairs_kmer(df, None, 0.8).collect()}
    assert got == want and want


@pytest.mark.parametrize("kernel", ["bitparallel", "builtin"])
def test_pair_on_the_length_bound(spark, kernel):
    a = spark.createDataFrame([(1, "A" * 55)], "id long, sequence string")
    b = spark.createDataFrame([(2, "A" * 100)], "id long, sequence string")
    assert SIM.similar_pairs(a, b, 0.55, kernel=kernel).count() == 1


def test_near_copy_entry_is_not_empty(spark):
    assert queries()["B4_near_copies_kmer"](spark, SF).count() > 20


# ------------------------------------------------------------- missing values
def test_rows_without_a_sequence_stay_apart(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, 0), (3, "AB", 1), (4, "AB", None), (5, "", 0), (6, "", 0)], "id long, sequence string, a int")
    for mode in ("first", "union"):
        out = {r["id"]: r for r in C.dedup_exact(df, ["a"], mode=mode).collect()}
        assert {i: r["n_copies"] for i, r in out.items()} == {1: 1, 2: 1, 3: 2, 5: 2}
        assert out[1]["sequence"] is None and out[3]["sequence"] == "AB"
    assert C.dedup_exact(df, ["a"], keep_sequence=False).columns == ["id", "n_copies", "a"]


def test_unannotated_labels(spark):
    df = spark.createDataFrame([(0, [1, 0, None], [1, 0, 0]), (0, [1, None, 1], [0, 1, 1]), (0, [None, None, None], [1, 1, 1])],
                               "run int, targets array<int>, pred array<int>")
    assert M.subset_accuracy(df).first()["subset_accuracy"] == 0.5
    r = M.sample_metrics(df).first()
    assert r["support"] == 3
    assert r["samples_precision"] == 1.0 and r["samples_recall"] == 0.75
    assert r["samples_f1"] == pytest.approx((1 + 2 / 3) / 2) and r["samples_accuracy"] == 0.75
    c = M.confusion(df, ["run"], ["a", "b", "c"], pred="pred").collect()
    assert [(x["n_rows"], x["n_exact"], x["n"]) for x in c] == [(2, 1, 2), (2, 1, 1), (2, 1, 1)]
    e = spark.createDataFrame([(0, 1, [1.0, 1.0], [1, None]), (1, 1, [1.0, -1.0], [0, 1])], "run int, id long, logits array<double>, targets array<int>")
    assert M.ensemble(e, ["a", "b"]).first()["targets"] == [1, None]


def test_encoding_with_repeated_ids(spark, monkeypatch):
    df = spark.createDataFrame([(1, "ABC"), (1, "AB"), (2, ""), (3, None)], "id long, sequence string").repartition(3)
    vocab = spark.createDataFrame([("A", 3), ("B", 4)], "symbol string, token_id int")
    small = sorted(map(repr, E.encode(df, vocab, max_len=6).collect()))
    monkeypatch.setattr(E, "MAP_LIMIT", 1)
    assert sorted(map(repr, E.encode(df, vocab, max_len=6).collect())) == small
    assert "n_tokens=4" in "".join(small) and "n_tokens=3" in "".join(small)


def test_batches_with_repeated_ids(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    out = S.assign_batches(df, 2, epochs=2, shuffle=False).collect()
    assert sorted((r["epoch"], r["rank"]) for r in out) == [(e, k) for e in (1, 2) for k in (1, 2, 3)]


def test_compare_runs_without_order_fails_on_repeated_keys(spark):
    one = spark.createDataFrame([(7, [1.0], [1])], "id long, logits array<double>, targets array<int>")
    two = one.union(one)
    assert P.compare_runs(two, one).count() == 2
    with pytest.raises(Exception, match="needs an order"):
        P.compare_runs(one, two).collect()


# ------------------------------------------------------------- kNN
def brute_knn(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return [sorted(range(len(x)), key=lambda j, i=i: (d[i, j], j))[:k] for i in range(len(x))]


@pytest.mark.parametrize("offset,spread", [(1e6, 0.01), (0.0, 1.0)])
def test_knn_is_exact_far_from_the_origin(spark, offset, spread):
    x = np.random.default_rng(2).normal(0, spread, (200, 3)) + offset
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {}
    for r in DG.knn(df, k=5, block_rows=32, pivots=8).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["nbr"]
    centred = x - x.mean(0)
    want = brute_knn(centred, 5)
    assert [[got[i][k] for k in range(1, 6)] for i in range(200)] == want


def test_knn_on_clustered_data(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.01, (50, 4)) + 10 * c for c in rng.normal(0, 1, (12, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    out = DG.knn(df, k=5, block_rows=50, pivots=60)
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nbr"]))
    assert [[n for _, n in sorted(got[i])] for i in range(600)] == brute_knn(x - x.mean(0), 5)


def test_knn_rejects_non_finite_vectors(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [float("nan")])], "id long, features array<double>")
    with pytest.raises(Exception, match="finite"):
        DG.knn(df, k=1).collect()


# ------------------------------------------------------------- hot keys
def test_no_task_holds_a_hot_key(spark, monkeypatch):
    """Half of all rows have one key; statistics too many to broadcast."""
    monkeypatch.setattr(PL, "BROADCAST_KEYS", 0)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 40_000
        df = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("pos"),
                                   (F.col("id") % 17).cast("double").alias("s")).repartition(8)
        w = PL.group_softmax(df, "key", "s")
        tasks = [r["count"] for r in w.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(tasks) == n and max(tasks) < n / 4
        total = w.filter("key = 0").agg(F.sum("weight")).first()[0]
        assert total == pytest.approx(1.0)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_key_with_every_position_masked(spark):
    rows = [(1, 0, [1.0, 2.0], True), (1, 1, [2.0, 0.0], False), (2, 0, [1.0, 1.0], False)]
    df = spark.createDataFrame(rows, "key long, pos long, vec array<double>, mask boolean")
    pooled, att = PL.attention_pool(df, [0.5, -0.5])
    assert {r["key"]: r["pooled"] is None for r in pooled.collect()} == {1: False, 2: True}
    assert {(r["key"], r["pos"]): r["attn"] for r in att.collect()} == {(1, 0): 1.0, (1, 1): 0.0, (2, 0): None}


# ------------------------------------------------------------- plans
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exchange_counts(spark):
    assert plan(queries()["B10_kfold"](spark, SF)).count("Exchange hashpartitioning") <= 4
    for name in ("B3_dedup_first", "B3_dedup_union", "F11_ensemble"):
        assert "SortAggregate" not in plan(queries()[name](spark, SF)), name
