import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlabel.operators import diagnose as DG
from seqlabel.operators import lsh as LSH
from seqlabel.plans.catalog import queries


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


def exact(x, k):
    """Distances of each row's k nearest others."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, :k]


def clustered(clusters, size, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 20, dims) + rng.normal(0, 0.3, (size, dims)) for _ in range(clusters)])


@pytest.mark.parametrize("x", [np.random.default_rng(1).normal(size=(900, 12)), clustered(30, 30)], ids=["even", "clustered"])
def test_lsh_reaches_its_recall(spark, x):
    found, measured = LSH.knn_lsh(frame(spark, x), k=5, cell_rows=100, pilots=64, batch=4)
    rows = found.collect()
    truth = exact(x, 5)
    hits = sum(r["dist"] <= truth[r["id"], -1] * (1 + 1e-9) for r in rows)
    assert measured >= 0.93 and hits / truth.size >= 0.9
    for r in rows:
        assert r["id"] != r["nbr"] and abs(r["dist"] - np.linalg.norm(x[r["id"]] - x[r["nbr"]])) < 1e-9
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append((r["rank"], r["dist"], r["nbr"]))
    for own in by.values():
        own.sort()
        assert [o[0] for o in own] == list(range(1, len(own) + 1)) and len({o[2] for o in own}) == len(own)
        assert [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_lsh_gives_up_with_the_recall_it_reached(spark):
    x = np.random.default_rng(2).normal(size=(600, 32))
    found, measured = LSH.knn_lsh(frame(spark, x), k=5, cell_rows=30, pilots=64, batch=2, max_tables=2)
    truth = exact(x, 5)
    recall = sum(r["dist"] <= truth[r["id"], -1] * (1 + 1e-9) for r in found.collect()) / truth.size
    assert 0 < measured < 0.9 and abs(measured - recall) < 0.15


def test_lsh_cells_are_bounded_with_many_copies(spark):
    """A third of the rows are equal: no signature tells them apart."""
    x = np.random.default_rng(3).normal(size=(900, 8))
    x[:300] = x[0]
    df = frame(spark, x)
    rows = df.select("id", F.col("features").alias("v"))
    planes = np.random.default_rng(4).normal(size=(3, 10, 8))
    cells = LSH._cells(rows, planes, 60)
    dealt = LSH._searched(rows.withColumn("reach", F.lit(float("inf"))), planes, cells, 4).groupBy("id").count()
    assert dealt.agg(F.max("count")).first()[0] <= 3 * 4
    assert sum(int(parts.sum()) for _, parts, _ in cells) <= 3 * (4 * 900 / 60 + 1)
    found, measured = LSH.knn_lsh(df, k=4, cell_rows=60, pilots=200)
    assert measured >= 0.93
    assert all(r["dist"] == 0 for r in found.filter("id < 300").collect())


@pytest.mark.parametrize("n", [0, 1, 2])
def test_lsh_on_few_rows(spark, n):
    found, measured = LSH.knn_lsh(frame(spark, np.eye(3)[:n]), k=5)
    assert measured == 1.0 and sorted((r["id"], r["nbr"]) for r in found.collect()) == [(0, 1), (1, 0)][: 2 * (n == 2)]


def test_lsh_is_the_same_for_any_partitioning(spark):
    df = frame(spark, np.random.default_rng(5).normal(size=(400, 8)))
    once = [sorted(map(tuple, LSH.knn_lsh(df.repartition(p), k=3, cell_rows=60, pilots=32)[0].select("id", "nbr", "rank").collect())) for p in (1, 5)]
    assert once[0] == once[1]


def test_lsh_rejects_non_finite_vectors(spark):
    with pytest.raises(Exception, match="finite"):
        LSH.knn_lsh(frame(spark, [[1.0, math.nan]]))


def sent(spark, x, k=5, block_rows=40, pivots=4096):
    base, n, mean = DG._centred(frame(spark, x), "features", "id")
    e = DG.Exchange(base, mean, n, k, block_rows, pivots)
    return e.queries.count(), e.references.count()


def test_references_sent_grow_in_step_with_the_rows(spark):
    """Clusters of one size, ever more of them: what is sent for a row stays the
    same, while copying each block to every part of the queries would square."""
    few, many = sent(spark, clustered(20, 60), block_rows=30), sent(spark, clustered(80, 60), block_rows=30)
    assert many[1] <= 1.3 * 4 * few[1] and many[0] <= 1.3 * 4 * few[0]
    assert few[1] <= 2 * 20 * 60


def test_references_follow_the_queries(spark):
    """All rows ask all blocks: as many parts as the queries need."""
    x = np.random.default_rng(6).normal(size=(1500, 24))
    queries, references = sent(spark, x, block_rows=20)
    assert queries > 1500 * 40 and 3 * 1500 < references <= 5 * 1500    # at most ceil(1500 / (16 * 20)) parts
    got = {(r["id"], r["nbr"]) for r in DG.knn(frame(spark, x), k=3, block_rows=20).collect()}
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(1500) for j in np.argsort(d[i])[:3]}


@pytest.mark.parametrize("block_rows", [None, 30])
def test_search_for_some_rows_among_all(spark, block_rows):
    """Only the asked rows have neighbours, the same ones as in the search for all."""
    x = clustered(8, 60)
    asks = F.col("id") % 10 == 0
    key = lambda df: sorted((r["id"], r["nbr"], r["rank"], r["dist"]) for r in df.collect())
    every = key(DG.knn(frame(spark, x), k=4))
    assert key(DG.knn(frame(spark, x), k=4, block_rows=block_rows, asks=asks)) == [r for r in every if r[0] % 10 == 0]
    assert DG.knn(frame(spark, x), k=4, asks=F.col("id") < 0).count() == 0


def test_what_a_search_for_some_rows_sends(spark):
    """Rows without clusters: every tenth row goes to all blocks, each block once."""
    x = np.random.default_rng(7).normal(size=(1200, 24))
    base, n, mean = DG._centred(frame(spark, x), "features", "id")
    e = DG.Exchange(base, mean, n, 3, 100, 4096, F.col("id") % 10 == 0)
    assert e.references.count() <= 1200 and e.queries.count() <= 120 * e.blocks


def test_lsh_for_some_rows_among_all(spark):
    x = np.random.default_rng(8).normal(size=(900, 12))
    found, measured = LSH.knn_lsh(frame(spark, x), k=5, cell_rows=100, pilots=64, batch=4, asks=F.col("id") % 10 == 0)
    rows, truth = found.collect(), exact(x, 5)[::10]
    hits = sum(r["dist"] <= truth[r["id"] // 10, -1] * (1 + 1e-9) for r in rows)
    assert {r["id"] for r in rows} == set(range(0, 900, 10)) and any(r["nbr"] % 10 for r in rows)
    assert measured >= 0.93 and hits / truth.size >= 0.9
    assert LSH.knn_lsh(frame(spark, x), k=5, asks=F.col("id") < 0)[0].count() == 0


def embeddings(spark, path, n):
    """A folder with an ``embeddings`` table of n rows whose ids are not divisible by 100."""
    x = np.random.default_rng(9).normal(size=(n, 64)).astype(np.float32)
    ids = [i + 1 + i // 99 for i in range(n)]
    rows = [(i, v.tolist(), i % 10) for i, v in zip(ids, x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return ids, x.astype(float)


def test_the_queries_search_for_every_row(spark, tmp_path):
    ids, x = embeddings(spark, tmp_path, 130)
    rows = {(r["id"], r["rank"]): r["dist"] for r in queries()["G5_knn"](spark, str(tmp_path)).collect()}
    truth = exact(x, 30)
    assert rows.keys() == {(i, k + 1) for i in ids for k in range(30)}
    assert all(abs(rows[i, k + 1] - truth[at, k]) < 1e-5 for at, i in enumerate(ids) for k in range(30))
    r = queries()["G5_knn_lsh_recall"](spark, str(tmp_path)).first()
    assert (r["n"], r["n_true"]) == (130, 130 * 30) and r["recall_reached"] and r["distances_exact"]
    purity = queries()["G6_neighbour_purity"](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in purity) == 130
