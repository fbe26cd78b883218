"""Splits are exact partitions, seeded, and independent of partitioning."""

import math


from seqlabel.operators import splits as S
from seqlabel.operators.rank import global_rank, md5_key, ordered_rank


def ids(spark, n, parts=3):
    return spark.range(n).repartition(parts)


def test_global_rank_is_a_permutation_and_partition_free(spark):
    a = {r["id"]: r["rank"] for r in global_rank(ids(spark, 700, 3), md5_key(77, "id")).collect()}
    b = {r["id"]: r["rank"] for r in global_rank(ids(spark, 700, 11), md5_key(77, "id")).collect()}
    assert sorted(a.values()) == list(range(1, 701))
    assert a == b


def test_global_rank_matches_sorted_md5(spark):
    import hashlib

    got = {r["id"]: r["rank"] for r in global_rank(ids(spark, 300), md5_key(5, "id")).collect()}
    order = sorted(range(300), key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))
    assert [got[i] for i in order] == list(range(1, 301))


def test_split_sizes(spark):
    for n in (1, 7, 100, 333):
        s = S.split(ids(spark, n), test=0.3)
        c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
        assert c.get("test", 0) == math.ceil(0.3 * n)
        assert c.get("train", 0) == n - math.ceil(0.3 * n)


def test_sample_exact_and_too_large(spark):
    import pytest

    assert S.sample_exact(ids(spark, 50), 20).count() == 20
    with pytest.raises(ValueError):
        S.sample_exact(ids(spark, 5), 6)


def test_kfold_partition(spark):
    n, k = 101, 5
    f = S.kfold(ids(spark, n), k=k, val=0.2).collect()
    tests = [r["id"] for r in f if r["role"] == "test"]
    assert sorted(tests) == list(range(n))            # each row tests exactly once
    for fold in range(k):
        rows = [r for r in f if r["fold"] == fold]
        assert len(rows) == n
        rest = [r for r in rows if r["role"] != "test"]
        assert sum(r["role"] == "val" for r in rest) == math.ceil(0.2 * len(rest))


def test_batches(spark):
    b = S.assign_batches(ids(spark, 70), batch_size=32, epochs=2).collect()
    for e in (1, 2):
        rows = [r for r in b if r["epoch"] == e]
        sizes = {}
        for r in rows:
            sizes[r["batch_id"]] = sizes.get(r["batch_id"], 0) + 1
        assert sizes == {0: 32, 1: 32, 2: 6}
    first = {r["id"]: r["rank"] for r in b if r["epoch"] == 1}
    second = {r["id"]: r["rank"] for r in b if r["epoch"] == 2}
    assert first != second                             # a new permutation per epoch
    ev = S.assign_batches(ids(spark, 70), batch_size=32, shuffle=False).collect()
    assert all(r["rank"] == r["id"] + 1 for r in ev)


def test_ordered_rank(spark):
    df = spark.createDataFrame([(k % 4, 100 - k) for k in range(40)], "g long, v long").repartition(5)
    r = ordered_rank(df, ["g", "v"], out="r").collect()
    want = sorted((x["g"], x["v"]) for x in r)
    assert [x["r"] for x in sorted(r, key=lambda x: (x["g"], x["v"]))] == list(range(1, 41))
    assert len(want) == 40
