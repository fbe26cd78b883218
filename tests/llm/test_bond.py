import math
import random

import duckdb
import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from seqlabel.llm import bond as B
from seqlabel.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchors=50, low=50, high=95, k=5, per_pair=3):
    sound = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        row = (y, [math.floor(256 * float(np.float32(x))) for x in v])
        sound[i] = min(sound.get(i, row), row)
    out = []
    for a, (label, q) in sound.items():
        if a % anchors:
            continue
        scores = sorted((-sum(x * z for x, z in zip(q, v)), i, y) for i, (y, v) in sound.items() if i != a)
        for s, p, _ in [r for r in scores if r[2] == label][:k]:
            fits = [(n, -t) for t, n, y in scores if y != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, r + 1, n, -s, t) for r, (n, t) in enumerate(fits[:per_pair])]
    return sorted(out)


def mined(spark, rows, anchors=50, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS id", "'own' AS score", "'own' AS row", "'own' AS v", "'own' AS ids").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, B.mined(df, label, F.col("id") % anchors == 0, **options).collect()))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, SF).collect()))
    assert got and got == brute(rows)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    sql = con.execute(ORACLE_SQL["op12_hard_negatives"])
    got = QUERIES["op12_hard_negatives"](spark, SF).select([d[0] for d in sql.description])
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())


def made(seed, n, dims, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (labels, dims))
    own = rng.integers(0, labels, n)
    return [(i, [float(x) for x in (centres[y] + rng.normal(0, 1, dims)).astype(np.float32)], int(y)) for i, y in enumerate(own)]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(1, 120, 6)
    rows += [(200, None, 1), (201, [1.0] * 6, None), (None, [1.0] * 6, 1), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (203, [nan] * 6, 1), (204, [inf] + [1.0] * 5, 2),
             (205, [], 1), (250, [], 2), (206, [2.0, 1.0], 3), (300, [0.0] * 6, 1), (207, [-1.0] * 6, 7), (350, [1.0] * 6, 9)]
    rows += [rows[3], rows[50], (50, rows[7][1], 3)] + [(400 + i, rows[0][1], i % 3) for i in range(80)]  # repeats and ties
    assert mined(spark, rows, anchors=10) == brute(rows, anchors=10)
    assert mined(spark, rows[:0]) == [] and mined(spark, rows[1:40]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_many_blocks_and_rounds(spark, spread):
    """Blocks are parts of batches and rounds a few anchors each."""
    rows = made(2, 3000, 20, 5, spread)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        assert mined(spark, rows, anchors=25, round_bytes=8 * 20 * 40) == brute(rows, anchors=25)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_components(spark):
    pick = random.Random(3)
    rows = [(i, [float(np.float32(pick.uniform(-1, 1) * 2**15)) for _ in range(8)], i % 3) for i in range(150)]  # beyond a double's integers
    assert mined(spark, rows, anchors=10) == brute(rows, anchors=10)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(i, [1e30], i % 2) for i in range(20)], anchors=10)


def test_bounds_hold_while_scanning():
    rng = np.random.default_rng(4)
    m = rng.integers(-300, 300, (20, 500))
    row = {"ids": np.arange(500).tobytes(), "labels": np.zeros(500, np.int64).tobytes(), "kind": "<i2", "low": m.min(1).tobytes(), "high": m.max(1).tobytes(),
           "columns": [c.astype("<i2").tobytes() for c in m]}
    q = rng.integers(-300, 300, (3, 20))
    anchors = B.Anchors(np.arange(3), np.zeros(3, np.int64), q)
    block = B.Block(row, anchors.largest)
    low, high = anchors.remaining(block, np.arange(3))
    for k in range(3):
        true, seen = q[k] @ m, []

        def shrink(sums, least, most):
            assert (sums + least <= true).all() and (sums + most >= true).all()
            seen.append(most - least)
            return np.ones(len(sums), bool)

        rows, scores = B.scanned(anchors, k, block, np.arange(500), low[k], high[k], shrink)
        assert (scores == true[rows]).all() and seen == sorted(seen, reverse=True) and seen[-1] == 0
        assert low[k, 0] <= true.min() and high[k, 0] >= true.max()
