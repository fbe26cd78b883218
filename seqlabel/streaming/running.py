"""Structured Streaming forms of the accumulating loops (H1-H3).

* ``running_metrics``: the loop's counters (confusion, loss, accuracy) as
  streaming aggregation state, one row per (group, label); the state is
  bounded by groups x labels, so no watermark is needed.
* ``score_stream``: resumable scoring — file source -> batch model -> parquet
  sink with a checkpoint; a restart continues after the last committed
  micro-batch, no row lost or doubled.
* ``batch_log``: per micro-batch loss / accuracy rows written with the batch id
  as partition, so a replayed batch overwrites itself (idempotent).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import COMPARTMENTS, THRESHOLD
from ..functions.arrays import bce_cells, predict, probs
from ..operators.score import score


def _cells(stream: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    p = probs("logits")
    return stream.select(*by, F.posexplode(F.arrays_zip(
        F.col("targets").alias("y"), predict(p, threshold).alias("h"), predict(p, mode="round").alias("r"),
        bce_cells("logits", "targets").alias("b"))))


def running_metrics(stream: DataFrame, by: Sequence[str] = ("run",), labels: Sequence[str] = COMPARTMENTS,
                    threshold: float = THRESHOLD) -> DataFrame:
    """H1: streaming confusion counts, loss and accuracy per (by, label)."""
    by = list(by)
    c = _cells(stream, by, threshold)
    y, h, r = F.col("col.y"), F.col("col.h"), F.col("col.r")
    g = c.groupBy(*by, F.col("pos").alias("label_idx")).agg(
        F.count_if((y == 1) & (h == 1)).alias("tp"), F.count_if((y == 0) & (h == 1)).alias("fp"),
        F.count_if((y == 1) & (h == 0)).alias("fn"), F.count_if((y == 0) & (h == 0)).alias("tn"),
        F.count(y).alias("n"), F.sum("col.b").alias("bce_sum"), F.count_if(y == r).alias("n_eq_round"))
    names = F.array(*[F.lit(x) for x in labels])
    return g.withColumn("label", F.element_at(names, F.col("label_idx") + 1).cast("string"))


MARKS = "-commits"


def committed(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The newest version with a mark (older than ``below``)."""
    try:
        marks = spark.read.parquet(path + MARKS)
    except AnalysisException:       # none yet
        return None
    return marks.filter(F.lit(True) if below is None else F.col("version") < below).agg(F.max("version")).first()[0]


def run_to_table(stream_df: DataFrame, path: str, checkpoint: str, mode: str = "complete", keys: Sequence[str] = ()) -> None:
    """Drive an aggregating stream to completion.  Each micro-batch writes the
    whole (small: groups x labels) result as a version of its own and then a mark
    that the version is complete, beside the table; ``latest`` reads the newest
    version with a mark, so it never meets one that is being written.  A replayed
    batch rewrites its version.

    With ``mode="update"`` a batch brings only the groups it has changed: they
    replace those of the last complete version with the same ``keys``."""
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a group")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if mode == "update":
            before = committed(spark, path, batch_id)
            if before is not None:
                old = spark.read.schema(batch.schema).parquet(f"{path}/version={before}")
                batch = old.join(batch.select(*keys), [*keys], "left_anti").select(*batch.columns).unionByName(batch)
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        spark.range(1).write.mode("overwrite").parquet(f"{path}{MARKS}/version={batch_id}")

    q = stream_df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
        .foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table that ``run_to_table`` keeps."""
    newest = committed(spark, path)
    if newest is None:
        raise ValueError(f"{path} has no complete version")
    return spark.read.parquet(f"{path}/version={newest}")


def score_stream(stream: DataFrame, inputs: str, model_loader: Callable, n_out: int, dim: int, out: str,
                 checkpoint: str, keep: Sequence[str] = ("id",), batch_size: int = 256) -> None:
    """H2: score every arriving row once: parquet sink + checkpoint,
    ``availableNow`` trigger; rerun after a stop to continue where it left off."""
    scored = score(stream, inputs, model_loader, n_out, dim, batch_size).select(*keep, "logits")
    q = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def batch_log(stream: DataFrame, out: str, checkpoint: str, threshold: float = THRESHOLD) -> None:
    """H3: one row per micro-batch: ``batch_id, n, loss, acc`` (loss = mean BCE
    over annotated cells, acc = rounded-label cell accuracy)."""
    def log(batch: DataFrame, batch_id: int) -> None:
        c = _cells(batch, [], threshold)
        y = F.col("col.y")
        out_df = c.agg(F.count(y).alias("n_cells"), F.sum("col.b").alias("_b"),
                       F.count_if(y == F.col("col.r")).alias("_eq"), F.count_if(F.col("pos") == 0).alias("n")) \
            .select((F.col("_b") / F.col("n_cells")).alias("loss"), (F.col("_eq") / F.col("n_cells")).alias("acc"),
                    "n", F.lit(batch_id).cast("bigint").alias("batch_id"))
        out_df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(log) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
