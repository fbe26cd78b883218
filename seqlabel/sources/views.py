"""Stand-in inputs over the generated test tables.

Each builder reads the given parquet tables (so its work grows with them) and
returns a lazily-planned DataFrame in the shape an operator expects:

* ``seq_v``    labelled sequence table (id, sequence, lang, source, en, de, es, fr, quality, toxic)
* ``ref_v``    reference sequences for similarity exclusion (the ``benchmark`` table)
* ``pred_v``   five runs of ten-label logits and targets over ``embeddings``
* ``pos_v``    per-position vectors, 16 positions per key, with a length mask
* ``series_v`` ordered series (``events`` by user)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import NUM_RUNS
from ..session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


SPREAD_MIN_BYTES = 4 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least the cluster's default parallelism.

    A table stored as one file with one row group is read by one task; every
    per-row step above it (regex over whole texts, symbol explode, pair checks)
    would then run single-threaded.  Only such under-split scans are
    redistributed (round-robin); a real multi-file table already yields more
    partitions than cores and is left untouched, so this never adds a shuffle
    at scale.  Counting partitions of a scan plans it without running a job.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SPREAD_MIN_BYTES:
        return df                      # a few MB: one task is faster than a shuffle
    have = df._jdf.rdd().getNumPartitions()
    return df.repartition(want) if have < want else df


def letters(text_col) -> F.Column:
    """Letters of a text, upper-cased: the sequence alphabet of the stand-ins."""
    return F.upper(F.regexp_replace(text_col, "[^A-Za-z]", ""))


def seq_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    lang = F.col("d.lang")
    out = d.alias("d").join(lab.alias("l"), F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        F.col("d.doc_id").alias("id"),
        letters(F.col("d.text")).alias("sequence"),
        lang.alias("lang"),
        F.col("d.source").alias("source"),
        *[(lang == F.lit(x)).cast("int").alias(x) for x in ("en", "de", "es", "fr")],
        F.col("l.quality").alias("quality"),
        F.col("l.toxic").alias("toxic"),
    )
    return out


def ref_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), letters(F.col("text")).alias("sequence"))


def pred_v(spark: SparkSession, sf_dir: str, runs: int = NUM_RUNS) -> DataFrame:
    """run, id, logits ARRAY<DOUBLE>[10], targets ARRAY<INT>[10] (one or two positives)."""
    return pred_from_embeddings(table(spark, sf_dir, "embeddings"), runs)


def pred_from_embeddings(e: DataFrame, runs: int = NUM_RUNS) -> DataFrame:
    """The pred_v projection over any embeddings frame (batch or streaming)."""
    r = e.select("vec_id", "embedding", "label", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    vid, lab = F.col("vec_id"), F.col("label")
    logits = F.transform(F.slice("embedding", F.col("run") * 10 + 1, 10), lambda x: x.cast("double") * 10)
    targets = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda j: ((lab == j) | ((vid % 3 == 0) & ((lab + 1) % 10 == j))).cast("int"),
    )
    return r.select(F.col("run").cast("int").alias("run"), vid.alias("id"), logits.alias("logits"), targets.alias("targets"))


def pos_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, pos, vec ARRAY<DOUBLE>[64], mask (true length 4..16 per key)."""
    e = table(spark, sf_dir, "embeddings")
    key = F.floor(F.col("vec_id") / 16).cast("bigint")
    pos = (F.col("vec_id") % 16).cast("bigint")
    return e.select(
        key.alias("key"), pos.alias("pos"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
        (pos < F.lit(4) + key % 13).alias("mask"),
    )


def series_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), "ts", "event_id", "value")


EMBEDDINGS_SCHEMA = "vec_id bigint, embedding array<float>, label int"


def embeddings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a file stream, whether the table is one file or a folder
    of parts: a plain path to one file is refused by the source, a glob is not."""
    return spark.readStream.schema(EMBEDDINGS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/[e]mbeddings.parquet")


def embeddings_files(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """``embeddings`` as a stream of ``files`` files, one per micro-batch."""
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    path = fresh_path(spark, "embeddings-files")
    e.repartition(files).write.parquet(path)
    return spark.readStream.schema(EMBEDDINGS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
