"""Distributions, projection and neighbours of predictions.

The plots of the original pipeline become tables: histogram counts, a fitted
normal curve, 2-D PCA points, class balance, a k-nearest-neighbour table and
neighbour label agreement.  Rendering is left to the caller.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COMPARTMENTS, HIST_BINS
from ..functions.arrays import confidence, dominant, probs
from ..session import materialized


def hist_edges(bins: int = HIST_BINS) -> list[float]:
    """Bin edges ``i * (1/bins)`` over [0, 1] computed as ``i * step`` in double
    (so the third of ten edges is 0.30000000000000004, as an arange gives)."""
    step = 1.0 / bins if bins != 10 else 0.1
    return [i * step for i in range(bins + 1)]


def bin_index(v, edges: Sequence[float]) -> F.Column:
    """Histogram bin of ``v``: ``[e_i, e_i+1)``, the last bin closed, NULL outside."""
    nb = len(edges) - 1
    inside = (v >= F.lit(edges[0])) & (v <= F.lit(edges[-1]))
    idx = sum((F.when(v >= F.lit(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when(inside, F.least(idx, F.lit(nb - 1)))


def prob_histograms(df: DataFrame, by: Sequence[str] = (), labels: Sequence[str] = COMPARTMENTS,
                    bins: int = HIST_BINS) -> DataFrame:
    """G1: per label the probability range, row count and histograms of the
    positive and negative rows (``ARRAY<BIGINT>[bins]``).

    Cells are exploded only inside the map side of one partial aggregation;
    what is shuffled is one partial row per (task, group, label)."""
    edges = hist_edges(bins)
    cells = df.select(*by, F.posexplode(F.arrays_zip(probs("logits").alias("p"), F.col("targets").alias("y"))))
    cells = cells.select(*by, F.col("pos").alias("label_idx"), F.col("col.p").alias("p"), F.col("col.y").alias("y")) \
        .withColumn("_bin", bin_index(F.col("p"), edges))
    aggs = [F.min("p").alias("confidence_range_min"), F.max("p").alias("confidence_range_max"),
            F.count(F.lit(1)).alias("count")]
    for cls, name in ((1, "pos"), (0, "neg")):
        aggs += [F.count_if((F.col("y") == cls) & (F.col("_bin") == b)).alias(f"{name}{b}") for b in range(bins)]
    g = cells.groupBy(*by, "label_idx").agg(*aggs)
    names = F.array(*[F.lit(x) for x in labels])
    return g.select(*by, "label_idx", F.element_at(names, F.col("label_idx") + 1).alias("label"),
                    "confidence_range_min", "confidence_range_max", "count",
                    F.array(*[F.col(f"pos{b}") for b in range(bins)]).alias("positive_hist"),
                    F.array(*[F.col(f"neg{b}") for b in range(bins)]).alias("negative_hist"))


def confidence_distribution(df: DataFrame, by: Sequence[str] = (), bins: int = HIST_BINS) -> DataFrame:
    """Histogram of row confidence (E4), mean, sample std and count."""
    edges = hist_edges(bins)
    c = df.select(*by, confidence("logits").alias("c")).withColumn("_bin", bin_index(F.col("c"), edges))
    g = c.groupBy(*by).agg(F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"), F.count(F.lit(1)).alias("n"),
                           *[F.count_if(F.col("_bin") == b).alias(f"h{b}") for b in range(bins)])
    return g.select(*by, F.array(*[F.col(f"h{b}") for b in range(bins)]).alias("counts"), "mean", "std", "n")


def normal_curve(dist: DataFrame, by: Sequence[str] = (), points: int = 100, bin_width: float = 0.1) -> DataFrame:
    """The fitted normal scaled to the histogram: ``pdf(x) * n * bin_width``
    at ``points`` evenly spaced x in [0, 1]; NULL when std is 0 or undefined."""
    x = F.col("i") / F.lit(points - 1)
    sd = F.col("std")
    pdf = F.exp(-(x - F.col("mean")) ** 2 / (2 * sd * sd)) / (sd * F.lit(math.sqrt(2 * math.pi)))
    return dist.select(*by, "mean", "std", "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")) \
        .select(*by, "i", x.alias("x"),
                F.when(sd > 0, pdf * F.col("n") * F.lit(bin_width)).alias("y"))


def pca_points(df: DataFrame, features: str = "features", k: int = 2, id_col: str = "id",
               targets: str = "targets", labels: Sequence[str] = COMPARTMENTS):
    """Centred principal-component scores ``(id, x, y, class)`` and the
    explained variance ``(component, explained_variance)``.

    MLlib's PCA does not centre scores, so features are centred first
    (``StandardScaler(withMean, not withStd)``).  Signs are fixed so that the
    largest absolute loading of each component is positive.  The loadings
    (features x k, bounded by the feature width) are read back to fix signs.
    """
    v = df.withColumn("_v", array_to_vector(F.col(features)))
    sc = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v)
    cen = sc.transform(v)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(cen)
    pc = model.pc.toArray()                      # d x k
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(k)]
    pts = model.transform(cen).withColumn("_pa", vector_to_array("_p"))
    names = ["x", "y", "z"][:k] if k <= 3 else [f"pc{j + 1}" for j in range(k)]
    points = pts.select(id_col, *[(F.element_at("_pa", j + 1) * F.lit(signs[j])).alias(names[j]) for j in range(k)],
                        dominant(targets, labels).alias("class"), targets)
    spark = df.sparkSession
    ev = spark.createDataFrame(
        [(j + 1, float(x)) for j, x in enumerate(model.explainedVariance.toArray())],
        "component int, explained_variance double")
    return points, ev


def class_balance(df: DataFrame, label: int = 0, targets: str = "targets", labels: Sequence[str] = COMPARTMENTS) -> DataFrame:
    """Rows with the label 0 and 1."""
    return df.groupBy(F.element_at(targets, label + 1).alias("value")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("label", F.lit(labels[label]))


BROADCAST_BLOCKS = 1_000_000   # two integers each
NEAREST_CELLS = 1 << 20        # distances held at once
SEARCH_BLOCKS, SEARCH_ROWS = 64, 65_536   # blocks that a search of few rows wants, and the rows they are cut at


def _check_finite(v: Column) -> Column:
    """The vector; a missing or non-finite value fails the query."""
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, v).otherwise(F.raise_error(F.lit("knn needs finite vectors")).cast("array<double>"))


def _vectors(column) -> np.ndarray:
    """An Arrow list column as a matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _nearest(Q: np.ndarray, qid: np.ndarray, R: np.ndarray, rid: np.ndarray, k: int):
    """(row of Q, row of R, distance) of each query's k nearest, self excluded,
    ties by neighbour id.  The expansion of the squared distance chooses the
    candidates; everything within its rounding error of the k-th is measured
    again exactly."""
    rows, cols, dists = [], [], []
    rr = (R * R).sum(1)
    step = max(1, min(512, NEAREST_CELLS // max(1, len(R))))
    for at in range(0, len(Q), step):
        q, ids = Q[at:at + step], qid[at:at + step]
        qq = (q * q).sum(1)
        d2 = qq[:, None] + rr[None, :] - 2.0 * (q @ R.T)
        slack = 8 * np.finfo(float).eps * (R.shape[1] + 4) * (qq[:, None] + rr[None, :])
        own = ids[:, None] == rid[None, :]
        d2[own] = np.inf
        if k < d2.shape[1]:
            cut = np.partition(d2 + slack, k - 1, axis=1)[:, k - 1:k]
            near = (d2 - slack <= cut) & ~own
        else:
            near = ~own
        i, j = np.nonzero(near)
        exact = np.sqrt(((R[j] - q[i]) ** 2).sum(1))
        order = np.lexsort((rid[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        rows.append(i[keep] + at)
        cols.append(j[keep])
        dists.append(exact[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``x``: the first, then always the farthest from those taken."""
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


class Exchange:
    """What the exact search sends: ``queries`` and ``references``, both with
    (block, part), and the number of blocks.

    Vectors are centred (subtracting large offsets loses digits).  Every row
    joins the cell of its nearest pivot (one per ``block_rows`` rows, at most
    ``pivots``; of twice as many drawn rows, each the farthest from those before
    it, so that no cluster is without); cells are cut into blocks of about
    ``block_rows``.  A row's k-th distance within its own block bounds
    how far its neighbours can be, and by the triangle inequality only cells with
    ``d(row, pivot) - radius`` within that bound can hold one: rows are queries
    in the blocks of those cells alone.

    References follow the queries: the queries that reach each block are counted,
    the block gets one part per ``16 * block_rows`` of them, and its rows are
    joined to that table of (block, part).  A block that few rows ask is sent
    once, one that none asks not at all.  With ``asks`` (a condition on ``id``)
    only the rows that it holds for are queries.
    """

    def __init__(self, base: DataFrame, mean: np.ndarray, n: int, k: int, block_rows: int, pivots: int, asks: Column | None = None):
        # cells of about a block, so that a row's own block can bound its k-th distance
        wanted = min(pivots, math.ceil(n / block_rows))
        drawn = base.orderBy(F.xxhash64("id"), "id").limit(2 * wanted).select("v").toArrow().column("v")
        P = _spread_out(_vectors(drawn) - mean, wanted)
        pp = (P * P).sum(1)

        def place(batches):
            for b in batches:
                v = _vectors(b.column(1)) - mean if b.num_rows else np.zeros((0, len(mean)))
                cell = ((v * v).sum(1)[:, None] + pp[None, :] - 2 * (v @ P.T)).argmin(1) if len(v) else np.zeros(0, np.int64)
                near = np.sqrt(((v - P[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(near)],
                                                 names=["id", "v", "cell", "near"])

        placed = materialized(base.mapInArrow(place, "id long, v array<double>, cell int, near double"), "knn-cells")
        cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("r")).orderBy("cell").collect()   # at most ``pivots``
        blocks = {c["cell"]: max(1, math.ceil(c["n"] / block_rows)) for c in cells}
        first, total = {}, 0
        for c in sorted(blocks):
            first[c], total = total, total + blocks[c]
        radius = np.full(len(P), -np.inf)
        for c in cells:
            radius[c["cell"]] = c["r"]
        where = F.create_map(*[F.lit(x) for c in sorted(blocks) for x in (c, first[c])])
        count = F.create_map(*[F.lit(x) for c in sorted(blocks) for x in (c, blocks[c])])
        asking = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
        dealt = placed.select("id", "v", (F.element_at(where, F.col("cell")) + F.pmod(F.xxhash64("id"), F.element_at(count, F.col("cell"))).cast("int")).alias("block"))

        def bound(group):
            v, ids, asks = _vectors(group.column("v")), np.asarray(group.column("id")), np.asarray(group.column("asks"))
            group = group.filter(group.column("asks"))
            reach = np.full(len(group), np.inf)
            if len(ids) > k and len(group):
                i, _, d = _nearest(v[asks], ids[asks], v, ids, k)
                reach = np.zeros(len(group))
                np.maximum.at(reach, i, d)
            return pa.table([group.column("id"), group.column("v"), pa.array(reach)], names=["id", "v", "reach"])

        reached = materialized(dealt.withColumn("asks", asking).groupBy("block").applyInArrow(bound, "id long, v array<double>, reach double"), "knn-reach")
        of_cell = [list(range(first[c], first[c] + blocks[c])) if c in first else [] for c in range(len(P))]
        slack = 8 * np.finfo(float).eps * (len(mean) + 4)

        def send(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                v, reach = _vectors(b.column(1)), np.asarray(b.column(2))
                for at in range(0, len(v), 256):
                    x = v[at:at + 256]
                    xx = (x * x).sum(1)[:, None]
                    d = np.sqrt(np.maximum(xx + pp[None, :] - 2 * (x @ P.T) - slack * (xx + pp[None, :]), 0))   # rounded down
                    go = d - radius[None, :] <= reach[at:at + 256, None] * (1 + 1e-9) + 1e-9 * d
                    targets = [[t for c in np.flatnonzero(row) for t in of_cell[c]] for row in go]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), b.column(1).slice(at, 256), pa.array(targets, pa.list_(pa.int32()))],
                                                     names=["id", "v", "blocks"])

        self.blocks = total
        sent = materialized(reached.mapInArrow(send, "id long, v array<double>, blocks array<int>"), "knn-sent")
        asked = sent.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        self.requests = materialized(asked.select("block", F.ceil(F.col("n") / F.lit(16 * block_rows)).cast("int").alias("parts")), "knn-requests")
        requests = F.broadcast(self.requests) if total <= BROADCAST_BLOCKS else self.requests
        part = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.col("parts")).cast("int")
        self.queries = sent.select("id", "v", F.explode("blocks").alias("block")).join(requests, "block").select("id", "v", "block", part.alias("part"))
        self.references = dealt.join(requests, "block").select("id", "v", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _centred(df: DataFrame, vec: str, id_col: str) -> tuple[DataFrame, int, np.ndarray]:
    """The rows as (id, v), their number and the mean vector."""
    base = df.select(F.col(id_col).cast("long").alias("id"), _check_finite(F.col(vec).cast("array<double>")).alias("v"))
    if base.isEmpty():   # there is no mean of nothing
        return base, 0, np.zeros(0)
    size = base.agg(Summarizer.mean(array_to_vector("v")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    return base, size["n"], size["m"].toArray()


def knn(df: DataFrame, vec: str = "features", id_col: str = "id", k: int = 30, block_rows: int | None = None,
        pivots: int = 4096, fan: int = 32, asks: Column | None = None) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, self excluded, ties by
    neighbour id): ``(id, nbr, dist, rank)``.

    ``Exchange`` says which rows meet.  Each (block, part) is one group, where
    NumPy keeps the k best per query, so no pair is ever emitted; the survivors
    of a row are merged as a tree of ``fan`` blocks at a time.  Well-separated
    data visits few cells; data without clusters visits them all, which is the
    cost of an exact search.  Missing or non-finite vectors fail the query; ids
    are unique.

    With ``asks``, a condition on ``id``, only those rows are searched for, among
    all rows.  Blocks are then larger (by default 64 of them, of at most 65,536
    rows), as each query is copied to every block it can't rule out.
    """
    spark = df.sparkSession
    base, n, mean = _centred(df, vec, id_col)
    if not n:
        return spark.createDataFrame([], "id long, nbr long, dist double, rank int")
    if block_rows is None:
        block_rows = 2048 if asks is None else min(max(2048, -(-n // SEARCH_BLOCKS)), SEARCH_ROWS)
    sent = Exchange(base, mean, n, k, block_rows, pivots, asks)

    def top_k(group):
        is_q = np.asarray(group.column("q"))
        ids, v = np.asarray(group.column("id")), _vectors(group.column("v"))
        qid, rid = ids[is_q], ids[~is_q]
        if len(qid) and len(rid):
            i, j, d = _nearest(v[is_q], qid, v[~is_q], rid, k)
        else:
            i = j = np.zeros(0, np.int64)
            d = np.zeros(0)
        block = np.full(len(i), group.column("block")[0].as_py(), np.int64)
        return pa.table([pa.array(qid[i]), pa.array(rid[j]), pa.array(d), pa.array(block)], names=["id", "nbr", "dist", "_g"])

    both = sent.queries.withColumn("q", F.lit(True)).unionByName(sent.references.withColumn("q", F.lit(False)))
    cand = both.groupBy("block", "part").applyInArrow(top_k, "id long, nbr long, dist double, _g long")
    # tree merge of each row's survivors: no window group exceeds fan * k rows
    groups = sent.blocks
    while groups > fan:
        cand = cand.withColumn("_g", F.floor(F.col("_g") / F.lit(fan)))
        w = Window.partitionBy("id", "_g").orderBy("dist", "nbr")
        cand = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
        groups = math.ceil(groups / fan)
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    return cand.drop("_g").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def neighbour_purity(nbrs: DataFrame, classes: DataFrame, id_col: str = "id", cls: str = "class") -> DataFrame:
    """Per class, the mean share of a row's neighbours in the same class
    (rows without a class are left out)."""
    c = classes.select(F.col(id_col).alias("id"), F.col(cls).alias("_c")).filter(F.col("_c").isNotNull())
    cn = c.select(F.col("id").alias("nbr"), F.col("_c").alias("_nc"))
    per = nbrs.join(c, "id").join(cn, "nbr", "left") \
        .groupBy("id", "_c").agg(F.avg(F.coalesce((F.col("_c") == F.col("_nc")).cast("double"), F.lit(0.0))).alias("_s"))
    return per.groupBy(F.col("_c").alias(cls)).agg(F.avg("_s").alias("purity"), F.count(F.lit(1)).alias("n"))
