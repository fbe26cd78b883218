"""Exact global ranks without a single-task window.

A ``row_number()`` with no ``partitionBy`` pulls every row into one task.
Both primitives here cut the order into many buckets, count the buckets
(a small table whose size is bounded by the bucket count, not the data),
turn the counts into running offsets, and add a per-bucket rank.

* ``global_rank``: order by ``md5(salt)`` then id.  Buckets are md5 prefixes,
  so they are uniform whatever the keys are; a seeded, partitioning-
  independent shuffle.  Two passes (count, rank), one shuffle of the rows.
* ``ordered_rank``: order by arbitrary columns.  A range repartition (Spark
  samples the boundaries) gives sorted, balanced partitions, written once to
  the shared checkpoint folder; the partition index from
  ``monotonically_increasing_id`` is the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

# A bucket table above this many rows is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 2_000_000


def md5_key(seed: int | str, id_col: str | Column, *salt: str | Column) -> Column:
    """``md5('<seed>:[<salt>:]<id>')`` as hex text: the shuffle order."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    parts: list[Column] = [F.lit(f"{seed}:")]
    for s in salt:
        parts += [(F.col(s) if isinstance(s, str) else s).cast("string"), F.lit(":")]
    parts.append(idc.cast("string"))
    return F.md5(F.concat(*parts))


def global_rank(df: DataFrame, order_key: Column, id_col: str = "id", partition_by: Sequence[str] = (),
                digits: int = 4, partition_card: int = 1, out: str = "rank",
                total: str | None = None) -> DataFrame:
    """Adds ``out`` = 1-based rank of each row by (``order_key``, ``id_col``)
    within ``partition_by``.

    ``order_key`` should be a well-mixed hex string (``md5_key``); its first
    ``digits`` hex characters form 16**digits buckets.  ``partition_card`` is an
    upper bound on the number of ``partition_by`` groups; the offset table
    (``partition_card * 16**digits`` rows at most) is broadcast only below
    ``BROADCAST_ROWS``.  With ``total`` the group size is added as well.
    """
    part = list(partition_by)
    keyed = df.withColumn("_h", order_key).withColumn("_b", F.substring("_h", 1, digits))
    counts = keyed.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*part).orderBy("_b")
    offsets = counts.select(
        *part, "_b",
        F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        *( [F.sum("_cnt").over(Window.partitionBy(*part)).alias(total)] if total else []),
    )
    if partition_card * 16 ** digits <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    wb = Window.partitionBy(*part, "_b").orderBy("_h", id_col)
    ranked = keyed.join(offsets, [*part, "_b"]).withColumn(out, F.row_number().over(wb) + F.col("_off"))
    return ranked.drop("_h", "_b", "_off")


def ordered_rank(df: DataFrame, order_cols: Sequence[str], out: str = "rank",
                 num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = 1-based rank of each row in the total order ``order_cols``
    (which must be unique, e.g. end with an id).

    Range-repartition + sort, then the classic exact zip-with-index: a tiny
    per-partition count table (one row per partition) gives the offsets.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = list(order_cols)
    srt = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols) \
        .withColumn("_mid", F.monotonically_increasing_id())
    # Range bounds are sampled per exchange (the sample seed depends on the RDD),
    # so two branches reading the same range repartition may cut it differently.
    # Write the sorted, numbered rows once to the shared checkpoint folder: both
    # the count table and the rows then come from the same partitions, and a lost
    # executor re-reads them instead of re-sampling.
    shared_dir(spark)
    srt = srt.checkpoint(eager=True)
    srt = srt.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = counts.select("_pid", F.coalesce(
        F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # one row per range partition: bounded by the partition count
    return srt.join(F.broadcast(offs), "_pid").withColumn(out, F.col("_off") + F.col("_loc") + 1) \
        .drop("_mid", "_pid", "_loc", "_off")
