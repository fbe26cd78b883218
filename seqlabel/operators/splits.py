"""Reproducible exact-size samples and splits.

All are driven by ``global_rank`` over ``md5('<seed>:<id>')``: membership
depends only on the seed and the ids, never on partitioning or row order, and
sizes are exact (``DataFrame.sample`` / ``randomSplit`` are neither).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import KFOLDS, SEED, TEST_SIZE, VAL_SHARE
from ..session import materialized
from .rank import global_rank, md5_key, ordered_rank


#: A boundary bucket of at most so many ids is ranked; a larger one is cut further.
BUCKET_ROWS = 50_000


def first_of(df: DataFrame, n_of: Callable[[int], int], seed: int = SEED, id_col: str = "id") -> tuple[Column | None, int]:
    """A condition for the first ``n_of(rows)`` rows in the seeded order, and the
    number of rows.

    Selection, not ranking: ids are counted per prefix of their hash, the prefix
    that holds the n-th row is counted again by a longer one until it has few
    ids, and only those are sorted.  Everything else is told by comparing with
    the n-th (hash, id), so rows are never shuffled.  Jobs read the ids only;
    the driver gets at most 65,536 counts a step.  None if several rows share the
    n-th id, which no condition can tell apart.
    """
    key = md5_key(seed, id_col)
    ids = df.select(key.alias("_h"), F.col(id_col).alias("_id"))
    prefix, before, total, n = "", 0, None, 0
    while total is None or (size > BUCKET_ROWS and len(prefix) < 32):
        counts = ids.filter(F.col("_h").startswith(prefix)).groupBy(F.substring("_h", 1, len(prefix) + 4).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        table = counts.toArrow().sort_by("p")
        sizes, names = table.column("n").to_numpy(), table.column("p")
        if total is None:
            total = int(sizes.sum())
            n = n_of(total)
            if n <= 0 or n >= total:
                return F.lit(n > 0), total
        ends = before + sizes.cumsum()
        at = int((ends < n).sum())      # the first bucket that reaches the n-th row
        prefix, size, before = names[at].as_py(), int(sizes[at]), int(ends[at] - sizes[at])
    bucket = ids.filter(F.col("_h").startswith(prefix))
    last = bucket.orderBy("_h", "_id").limit(n - before).agg(F.max(F.struct("_h", "_id")).alias("k")).first()["k"]
    h, same = F.lit(last["_h"]), bucket.filter((F.col("_h") == last["_h"]) & (F.col("_id") == F.lit(last["_id"])))
    if same.count() > 1:
        return None, total
    return (key < h) | ((key == h) & (F.col(id_col) <= F.lit(last["_id"]))), total


def sample_exact(df: DataFrame, n: int, seed: int = SEED, id_col: str = "id", check: bool = True) -> DataFrame:
    """Exactly ``n`` rows, seeded, without replacement.  ``n`` larger than
    the table is an error (checked while the plan is built).  Only the rows
    chosen are ranked."""
    chosen, total = first_of(df, lambda _: n, seed, id_col)
    if check and n > total:
        raise ValueError(f"cannot take a sample of {n} from {total} rows without replacement")
    return global_rank(df if chosen is None else df.filter(chosen), md5_key(seed, id_col), id_col).filter(F.col("rank") <= n)


def split(df: DataFrame, test: float = TEST_SIZE, seed: int = SEED, id_col: str = "id",
          out: str = "split") -> DataFrame:
    """Adds ``split`` = 'test' for the first ``ceil(test * N)`` rows of the
    seeded order, 'train' for the rest (the sizes of the usual library split).
    A projection: the rows stay where they are."""
    chosen, _ = first_of(df, lambda n: math.ceil(float(test) * n), seed, id_col)
    if chosen is not None:
        return df.withColumn(out, F.when(chosen, F.lit("test")).otherwise(F.lit("train")))
    ranked = global_rank(df, md5_key(seed, id_col), id_col, total="_n")
    n_test = F.ceil(F.lit(float(test)) * F.col("_n"))
    return ranked.withColumn(out, F.when(F.col("rank") <= n_test, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("_n", "rank")


def split_shape(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows and columns per split (the printed shapes)."""
    ncols = len(df.columns) - 1
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(ncols))


def kfold(df: DataFrame, k: int = KFOLDS, val: float = VAL_SHARE, seed: int = SEED,
          id_col: str = "id") -> DataFrame:
    """K-fold assignment with a validation share inside each training part.

    Output ``fold, <id>, role`` with role in test / val / train: fold ``f``
    tests on ``floor((rank-1)*k/N) = f``; of the remaining rows the first
    ``ceil(val * n_rest)`` of a second, fold-salted order validate.
    """
    ranked = global_rank(df.select(id_col), md5_key(seed, id_col), id_col, total="_n")
    home = ranked.select(id_col, F.floor((F.col("rank") - 1) * k / F.col("_n")).cast("int").alias("_home"))
    home = materialized(home, "folds")      # ids and folds: ranked once for both branches
    tests = home.select(F.col("_home").alias("fold"), id_col, F.lit("test").alias("role"))
    rest = home.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("fold <> _home")
    inner = global_rank(rest, md5_key(seed, id_col, "fold"), id_col, partition_by=["fold"],
                        partition_card=k, total="_m", out="_r2")
    n_val = F.ceil(F.lit(float(val)) * F.col("_m"))
    trainval = inner.select("fold", id_col, F.when(F.col("_r2") <= n_val, F.lit("val")).otherwise(F.lit("train")).alias("role"))
    return tests.unionByName(trainval)


def assign_batches(df: DataFrame, batch_size: int, epochs: int = 1, seed: int = SEED, id_col: str = "id",
                   shuffle: bool = True) -> DataFrame:
    """C4: mini-batch ids per epoch.

    ``shuffle``: a new seeded permutation per epoch (salted by epoch);
    otherwise the evaluation order (by id).  ``batch_id = floor((rank-1)/B)``;
    the last batch may be short.  Output ``epoch, <id>, rank, batch_id``.
    """
    if shuffle:
        ep = df.select(id_col, F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
        ranked = global_rank(ep, md5_key(seed, id_col, "epoch"), id_col, partition_by=["epoch"], partition_card=epochs)
    else:
        # every epoch has the same order: rank once, then repeat the rows
        ranked = ordered_rank(df.select(id_col), [id_col]).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return ranked.select("epoch", id_col, "rank",
                         F.floor((F.col("rank") - 1) / F.lit(batch_size)).cast("bigint").alias("batch_id"))


def shard_write(batches: DataFrame, path: str, shards: int = 16) -> None:
    """C4: write batches in ``shards`` folders per epoch (rerun-safe overwrite).
    A batch lies whole in shard ``batch_id % shards`` and keeps its ``batch_id``
    as a column, so the number of folders does not grow with the data."""
    cut = batches.withColumn("shard", (F.col("batch_id") % shards).cast("int"))
    cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "shard").parquet(path)
