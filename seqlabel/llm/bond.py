"""Hard negatives by a branch-and-bound scan of columnar vectors (BOND).

Vectors become integers and are stored as blocks: some 4,096 rows, sorted by
label, with one array per dimension and each dimension's least and greatest
value.  An anchor reads a block's dimensions in descending order of its own
magnitudes, a few at a time.  What the dimensions not read yet can still add lies
between the sums of their least and greatest contributions, so every row's score
has a lower and an upper bound, and rows that can't matter leave the candidates:

* positives (same label): rows whose upper bound is below the k-th best lower
  bound, of this block or of the blocks before it;
* negatives (other labels): rows whose bounds miss every window.  A window is the
  range of scores that one positive allows; once ``per_pair`` rows surely lie in
  it, rows below the last of them miss it too.

When all dimensions are read the bounds are the exact scores.  Sums are exact:
they stay below 2**53 in doubles, else 64-bit integers are used.

Blocks are the rows of a table, ``BLOCKS_PER_TASK`` to a task, and never
shuffled.  Anchors come in rounds of at most ``ROUND_BYTES``, which are broadcast
one after the other; each task keeps the best rows of an anchor over all its
blocks and returns only those, so what is shuffled doesn't depend on the pairs
seen.  The anchors are a stated fraction of the rows, so an exact search costs
(rows x anchors) bound checks at worst, whatever its method.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; shorter vectors count as filled up with zeros; rows of
one id count once, as the least (label, vector) among them; ties go to the
smaller id; an anchor without positives, or a positive without negatives in its
window, has no rows; an empty table gives none.  Components are limited so that
a score fits 64 bits; a table beyond that fails.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, saved

SCALE = 256
BLOCK = 4096
BLOCKS_PER_TASK = 64
ROUND_BYTES = 16 << 20
STEP = 8
NONE = -(1 << 62)
BLOCKS = "ids binary, labels binary, kind string, low binary, high binary, columns array<binary>"


def quantised(vectors: DataFrame, vec_id: str, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """The rows that take part: id, label and v, the vector in integers."""
    v = F.col("__v")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(vectors[vec_id].cast("long").alias("id"), label.cast("long").alias("label"), vectors[vector].cast("array<double>").alias("__v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & sound)
    # a long holds what the scan can use; beyond it the scan's own check must fail, not the cast
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-2.0**62)), F.lit(2.0**62))))
    rows = rows.select("id", F.struct("label", whole.alias("v")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def blocked(rows: DataFrame, n: int, dims: int) -> DataFrame:
    """The rows as blocks sorted by label, written once."""
    parts = min(-(-n // BLOCK), max(buckets(rows.sparkSession), -(-n // (BLOCK * BLOCKS_PER_TASK))))
    keys = ["label", F.xxhash64("id"), "id"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                m = np.ascontiguousarray(matrix(part.column(2), dims).T)
                # whose magnitude fits: abs() of the least long is negative
                kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or (not m.size) or max(m.max(), -m.min()) < 1 << 8 * int(k[2]) - 1)
                low, high = (m.min(1), m.max(1)) if dims else (m[:, 0], m[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (part.column(0).to_numpy().tobytes(), part.column(1).to_numpy().tobytes(), kind, low.tobytes(), high.tobytes())]
                    + [pa.array([[c.astype(kind).tobytes() for c in m]], pa.list_(pa.binary()))], names=["ids", "labels", "kind", "low", "high", "columns"])

    ordered = rows.repartitionByRange(max(1, parts), *keys).sortWithinPartitions(*keys)
    return saved(ordered.mapInArrow(pack, BLOCKS), "bond-blocks")


class Block:
    """A block's columns, in doubles where all sums are exact in them."""

    def __init__(self, row: dict, largest: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.low, self.high = np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64)
        bound = max([0, *map(abs, self.low.tolist()), *map(abs, self.high.tolist())]) * largest * max(1, len(self.low))
        if bound >= 1 << 55:
            raise OverflowError("scores of these vectors don't fit 64 bits")
        self.kind = np.float64 if bound < 1 << 53 else np.int64
        self.columns = np.array([np.frombuffer(c, row["kind"]) for c in row["columns"]], self.kind).reshape(len(self.low), len(self.ids))

    def label(self, label: int) -> tuple[int, int]:
        return np.searchsorted(self.labels, label, "left"), np.searchsorted(self.labels, label, "right")


class Anchors:
    """Anchors' vectors with each one's order of dimensions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.argsort(-np.abs(vectors), axis=1, kind="stable").astype(np.int32)
        self.steps = list(range(0, vectors.shape[1], STEP)) or [0]
        self.largest = int(np.abs(vectors).max(initial=0))

    def remaining(self, block: Block, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the anchors ``own`` and each step, the least and greatest
        sums that the dimensions from that step on can add."""
        q = self.vectors[own]
        a, b = q * block.low, q * block.high
        out = []
        for side in (np.minimum(a, b), np.maximum(a, b)):
            inner = np.take_along_axis(side, self.order[own].astype(np.int64), 1)
            sums = np.zeros((len(own), q.shape[1] + 1), np.int64)
            sums[:, :-1] = np.cumsum(inner[:, ::-1], 1)[:, ::-1]
            out.append(sums[:, [*self.steps, q.shape[1]]])
        return out[0], out[1]


def scanned(anchors: Anchors, k: int, block: Block, rows: np.ndarray, low: np.ndarray, high: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are left when anchor ``k`` has read all dimensions, and
    their exact scores.  ``shrink(sums, low, high)`` says which stay."""
    q, order = anchors.vectors[k], anchors.order[k]
    sums = np.zeros(len(rows), block.kind)
    everything = len(rows) == len(block.ids)
    for s, at in enumerate(anchors.steps):
        dims = order[at : at + STEP]
        part = block.columns[dims]
        sums = sums + q[dims].astype(block.kind) @ (part if everything else part[:, rows])
        stay = shrink(sums, low[s + 1], high[s + 1])
        if not stay.all():
            rows, sums, everything = rows[stay], sums[stay], False
            if not len(rows):
                break
    return rows, sums.astype(np.int64)


def nth_largest(values: np.ndarray, n: int) -> int:
    return int(np.partition(values, len(values) - n)[len(values) - n])


def kept_best(scores: np.ndarray, ids: np.ndarray, new: np.ndarray, new_ids: np.ndarray) -> None:
    """Replaces a ranked list, in place, by the best of it and the new ones."""
    scores_, ids_ = np.concatenate([scores, new]), np.concatenate([ids, new_ids])
    order = np.lexsort((ids_, -scores_))[: len(scores)]
    scores[:], ids[:] = scores_[order], ids_[order]


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def positives(blocks: DataFrame, shared, k: int) -> DataFrame:
    """Each task's best ``k`` rows of the anchor's own label: anchor_id, id, score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        scores = np.full((len(anchors.ids), k), NONE, np.int64)
        ids = np.zeros((len(anchors.ids), k), np.int64)
        for row in rows_of(batches):
            block = Block(row, anchors.largest)
            here = np.flatnonzero(np.isin(anchors.labels, block.labels))
            for at in range(0, len(here), BLOCK):
                own = here[at : at + BLOCK]
                low, high = anchors.remaining(block, own)
                for i, a in enumerate(own.tolist()):
                    if high[i, 0] < scores[a, -1]:
                        continue
                    start, stop = block.label(anchors.labels[a])
                    mine = np.arange(start, stop)
                    mine = mine[block.ids[mine] != anchors.ids[a]]

                    def shrink(sums, least, most):
                        floor = scores[a, -1]
                        if len(sums) > k:
                            floor = max(floor, nth_largest(sums, k) + least)
                        return sums + most >= floor

                    found, exact = scanned(anchors, a, block, mine, low[i], high[i], shrink)
                    if len(found):
                        kept_best(scores[a], ids[a], exact, block.ids[found])
        at, rank = np.nonzero(scores > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[at]), pa.array(ids[at, rank]), pa.array(scores[at, rank])], names=["anchor_id", "id", "score"])

    return blocks.mapInArrow(run, "anchor_id long, id long, score long")


def negatives(blocks: DataFrame, shared, windows, per_pair: int) -> DataFrame:
    """Each task's best ``per_pair`` rows of other labels in each window:
    anchor_id, nth (the window), id, score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (floors, tops) = shared.value, windows.value
        n, m = floors.shape
        scores = np.full((n, m, per_pair), NONE, np.int64)
        ids = np.zeros((n, m, per_pair), np.int64)
        for row in rows_of(batches):
            block = Block(row, anchors.largest)
            everything = np.arange(len(block.ids))
            for at in range(0, n, BLOCK):
                own = np.arange(at, min(at + BLOCK, n))
                low, high = anchors.remaining(block, own)
                for i, a in enumerate(own.tolist()):
                    need = np.maximum(floors[a], scores[a, :, -1])
                    if not ((high[i, 0] >= need) & (low[i, 0] <= tops[a]) & (need <= tops[a])).any():
                        continue
                    start, stop = block.label(anchors.labels[a])
                    others = np.concatenate([everything[:start], everything[stop:]]) if stop > start else everything

                    def shrink(sums, least, most):
                        stay = np.zeros(len(sums), bool)
                        for j in range(m):
                            if need[j] > tops[a, j]:
                                continue
                            if most - least <= tops[a, j] - floors[a, j]:
                                sure = sums[(sums + least >= floors[a, j]) & (sums + most <= tops[a, j])]
                                if len(sure) >= per_pair:
                                    need[j] = max(need[j], nth_largest(sure, per_pair) + least)
                            stay |= (sums + most >= need[j]) & (sums + least <= tops[a, j])
                        return stay

                    found, exact = scanned(anchors, a, block, others, low[i], high[i], shrink)
                    for j in range(m) if len(found) else ():
                        fits = (exact >= need[j]) & (exact <= tops[a, j])
                        if fits.any():
                            kept_best(scores[a, j], ids[a, j], exact[fits], block.ids[found[fits]])
        at, nth, rank = np.nonzero(scores > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[at]), pa.array(nth.astype(np.int32)), pa.array(ids[at, nth, rank]), pa.array(scores[at, nth, rank])],
                                         names=["anchor_id", "nth", "id", "score"])

    return blocks.mapInArrow(run, "anchor_id long, nth int, id long, score long")


def first(rows: DataFrame, keys: list[str], n: int, rank: str) -> DataFrame:
    """The best ``n`` rows of each key, of the few that each task returned."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def mined(vectors: DataFrame, label: Column, is_anchor: Column, low: int = 50, high: int = 95, n_positives: int = 5, per_pair: int = 3,
          vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per anchor, positive and rank: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.  ``is_anchor`` is a condition on
    the column ``id``; negatives score from ``low`` to ``high`` percent of the
    positive."""
    spark = vectors.sparkSession
    rows = saved(quantised(vectors, vec_id, vector, label, scale), "bond-rows")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.count_if(is_anchor).alias("anchors")).first()
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not size["anchors"]:
        return out
    dims = size["dims"]
    blocks = blocked(rows, size["n"], dims)
    most = max(1, round_bytes // (8 * max(1, dims)))
    rounds = -(-size["anchors"] // most)
    anchors = rows.filter(is_anchor)
    while rounds > 1 and anchors.groupBy(F.pmod(F.xxhash64("id"), F.lit(rounds))).count().agg(F.max("count")).first()[0] > most:
        rounds += 1
    done = []
    for r in range(rounds):
        own = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).toArrow().combine_chunks()  # at most ``most`` rows
        if not own.num_rows:
            continue
        own = own.sort_by("id").combine_chunks()
        lists = own.column("v").chunk(0)
        shared = spark.sparkContext.broadcast(Anchors(own.column("id").to_numpy(), own.column("label").to_numpy(), matrix(lists, dims)))
        best = saved(first(positives(blocks, shared, n_positives), ["anchor_id"], n_positives, "nth"), "bond-positives")
        found = best.toArrow()  # at most ``n_positives`` rows an anchor
        place = np.searchsorted(shared.value.ids, found.column("anchor_id").to_numpy())
        floors, tops = (np.full((own.num_rows, n_positives), x, np.int64) for x in (1, 0))  # a missing positive: an empty window
        nth, score = found.column("nth").to_numpy() - 1, found.column("score").to_numpy()
        floors[place, nth], tops[place, nth] = -(-low * score // 100), high * score // 100
        windows = spark.sparkContext.broadcast((floors, tops))
        hard = first(negatives(blocks, shared, windows, per_pair).withColumn("nth", F.col("nth") + 1), ["anchor_id", "nth"], per_pair, "rank")
        pairs = best.select("anchor_id", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        done.append(saved(hard.join(pairs, ["anchor_id", "nth"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "bond-negatives"))
        shared.unpersist()
        windows.unpersist()
    for d in done:
        out = out.unionByName(d)
    return out
