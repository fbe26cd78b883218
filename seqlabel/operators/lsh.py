"""Approximate nearest neighbours by signed random projections (G5, LSH mode).

A table has ``bits`` random directions; a row's signature in it is the sign of its
centred vector along each.  Close rows agree in most signs, so rows that share a
cell (a run of neighbouring signatures with about ``cell_rows`` rows) are measured
against each other, exactly, and each keeps its ``k`` best.  What one table misses
another may find: tables are added ``batch`` at a time, and from the second batch
on a row only returns neighbours nearer than its k-th so far.

How many tables are needed depends on the data, so it is measured: up to
``pilots`` rows (those with the least hash of their id) are searched exactly, in
one pass over the rows, and tables are added until ``recall`` of their
neighbours have been found, or ``max_tables`` are used up; what was reached is
returned with the neighbours.  Clustered rows need few tables; rows spread evenly
in many dimensions need so many that the exact search is cheaper.

Cells are bounded: a cell of more than ``cell_rows`` rows, which share few
signatures (many copies), is cut by a hash of the id, and no cell returns more
than ``cell_rows * k`` rows, give or take the hash.  By default ``cell_rows``
grows with the square root of the rows, so a table costs rows ** 1.5.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SEED
from ..session import materialized
from .diagnose import _centred, _nearest, _vectors

CELL_ROWS = (256, 16_384)   # bounds of the default
NEIGHBOURS = "id long, nbr long, dist double, rank int"
FOUND = "id long, nbr long, dist double"


def _signatures(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(tables, rows) signatures; ``planes`` is (tables, bits, dimensions)."""
    weights = 1 << np.arange(planes.shape[1], dtype=np.int64)[::-1]
    return np.stack([(v @ p.T > 0).astype(np.int64) @ weights for p in planes])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Each row's ``k`` best of what has been found, ties by neighbour id."""
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    once = found.groupBy("id", "nbr").agg(F.min("dist").alias("dist"))
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _pilots(rows: DataFrame, k: int, pilots: int, asks: Column) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pilots, ascending, and each one's distance to its k-th (or
    last) neighbour, found exactly: each task keeps the k best of its rows."""
    chosen = rows.filter(asks).orderBy(F.xxhash64("id"), "id").limit(pilots).toArrow().sort_by("id")
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0)
    ids, queries = chosen.column("id").to_numpy(), _vectors(chosen.column("v"))

    def best(batches):
        i, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            if not b.num_rows:
                continue
            rid = b.column(0).to_numpy()
            a, n, e = _nearest(queries, ids, _vectors(b.column(1)), rid, k)
            i, j, d = np.concatenate((i, a)), np.concatenate((j, rid[n])), np.concatenate((d, e))
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, d = i[keep], j[keep], d[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(j), pa.array(d)], names=["id", "nbr", "dist"])

    far = _merged(rows.mapInArrow(best, FOUND), k).groupBy("id").agg(F.max("dist").alias("dist")).toArrow()
    reach = np.full(len(ids), -1.0)
    reach[np.searchsorted(ids, far.column("id").to_numpy())] = far.column("dist").to_numpy()
    return ids, reach


def _cells(rows: DataFrame, planes: np.ndarray, cell_rows: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Per table: the first signature of each cell, how many parts the cell is
    cut into, and the number of the table's first part.  Signatures are counted
    in Spark; a table has at most ``4 * rows / cell_rows + 1`` cells."""
    def count(batches):
        for b in batches:
            if b.num_rows:
                for t, s in enumerate(_signatures(_vectors(b.column(1)), planes)):
                    sig, n = np.unique(s, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(sig), pa.array(n)], names=["t", "sig", "n"])

    counts = rows.mapInArrow(count, "t int, sig long, n long").groupBy("t", "sig").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("t").orderBy("sig")) - F.col("n")
    cells = counts.withColumn("cell", F.floor(before / F.lit(max(1, cell_rows // 2)))).groupBy("t", "cell").agg(F.min("sig").alias("first"), F.sum("n").alias("n"))
    table = cells.orderBy("t", "cell").toArrow()
    t, first = table.column("t").to_numpy(), table.column("first").to_numpy()
    parts = -(-table.column("n").to_numpy() // cell_rows)
    out, number = [], 0
    for k in range(len(planes)):
        own = t == k
        out.append((first[own], parts[own], number))
        number += int(parts[own].sum())
    return out


def _searched(rows: DataFrame, planes: np.ndarray, cells, k: int) -> DataFrame:
    """Neighbours within the cells of all tables: id, nbr, dist.  ``rows`` has
    id, v and reach, beyond which a row needs no neighbour (below 0: none at all)."""
    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            for sig, (first, parts, number) in zip(_signatures(_vectors(b.column(1)), planes), cells):
                cell = np.searchsorted(first, sig, "right") - 1
                starts = number + np.cumsum(parts) - parts
                mixed = (ids * np.int64(0x9E3779B1) ^ (ids >> 15)) & 0x7FFFFFFF
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts[cell] + mixed % parts[cell])], names=["id", "v", "reach", "g"])

    def within(group):
        ids, v, reach = group.column("id").to_numpy(), _vectors(group.column("v")), group.column("reach").to_numpy()
        asks = reach >= 0
        own, reach = ids[asks], reach[asks]
        i, j, d = _nearest(v[asks], own, v, ids, k) if len(ids) > 1 and len(own) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        near = d <= reach[i]
        return pa.table([pa.array(own[i[near]]), pa.array(ids[j[near]]), pa.array(d[near])], names=["id", "nbr", "dist"])

    return rows.mapInArrow(deal, "id long, v array<double>, reach double, g long").groupBy("g").applyInArrow(within, FOUND)


def knn_lsh(df: DataFrame, vec: str = "features", id_col: str = "id", k: int = 30, recall: float = 0.93, cell_rows: int | None = None,
            batch: int = 8, max_tables: int = 96, pilots: int = 256, seed: int = SEED, asks: Column | None = None) -> tuple[DataFrame, float]:
    """G5, LSH mode: ``(id, nbr, dist, rank)`` like ``knn``, with exact distances,
    and the recall measured on the pilots.  Runs jobs while the plan is built:
    three per batch of tables, and the tables come one batch after the other.
    With ``asks``, a condition on ``id``, all rows are in the tables, but only those
    it holds for (and pilots among them) are searched for.  Missing or non-finite
    vectors fail the query; ids are unique."""
    asks = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    spark = df.sparkSession
    base, n, mean = _centred(df, vec, id_col)
    if not n:
        return spark.createDataFrame([], NEIGHBOURS), 1.0
    centred = F.zip_with("v", F.lit(mean.tolist()), lambda x, m: x - m)
    rows = materialized(base.select("id", centred.alias("v")), "lsh-rows")
    cell_rows = cell_rows or min(max(CELL_ROWS[0], math.ceil(8 * math.sqrt(n))), CELL_ROWS[1])
    bits = min(60, max(1, math.ceil(math.log2(max(2, n / cell_rows)))) + 6)
    ids, truth = _pilots(rows, k, pilots, asks)
    wanted = len(ids) * min(k, n - 1)
    best, reached, tables = None, 0.0, 0
    while reached < recall and tables < max_tables:
        planes = np.random.default_rng([seed, tables]).normal(size=(min(batch, max_tables - tables), bits, len(mean)))
        if best is None:
            todo = rows.withColumn("reach", F.when(asks, float("inf")).otherwise(-1.0))
        else:
            far = best.groupBy("id").agg(F.max("dist").alias("dist"), F.count(F.lit(1)).alias("n"))
            todo = rows.join(far, "id", "left").select("id", "v", F.when(~asks, -1.0).when(F.col("n") >= k, F.col("dist")).otherwise(float("inf")).alias("reach"))
        found = _searched(todo, planes, _cells(rows, planes, cell_rows), k)
        if best is not None:
            found = best.select("id", "nbr", "dist").unionByName(found)
        best = materialized(_merged(found, k), "lsh-best")
        tables += len(planes)
        if not wanted:
            return best, 1.0
        own = best.filter(F.col("id").isin([int(i) for i in ids])).toArrow()   # at most pilots * k rows
        far = truth[np.searchsorted(ids, own.column("id").to_numpy())]
        reached = float((own.column("dist").to_numpy() <= far * (1 + 1e-9) + 1e-12).sum()) / wanted
    return best, reached


def recall_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours that were found, by distance (a neighbour as
    near as the true last one counts): ``n, n_true, n_found, recall``."""
    last = truth.groupBy("id").agg(F.max("dist").alias("last"), F.count(F.lit(1)).alias("n_true"))
    hit = found.join(last, "id").groupBy("id").agg(F.count_if(F.col("dist") <= F.col("last") * (1 + 1e-9) + 1e-12).alias("hits"))
    per = last.join(hit, "id", "left").select("n_true", F.least(F.coalesce("hits", F.lit(0)), "n_true").alias("hits"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.sum("n_true").alias("n_true"), F.sum("hits").alias("n_found")) \
        .withColumn("recall", F.try_divide(F.col("n_found").cast("double"), F.col("n_true")))
