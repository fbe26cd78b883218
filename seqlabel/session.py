"""Session helpers for tests, the bench and local runs.

Library operators never create a session; only entry points call these.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "seqlabel") -> SparkSession:
    """A local session tuned like a cluster job: AQE on, UI off, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SEQLABEL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Read from the session; only when it is unset on a local master (tests) a
    fresh folder is created and registered, so later jobs reuse it.  On a
    cluster an unset folder is an error: a machine-local one would not be
    visible to the other executors.
    """
    d = spark.sparkContext.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder is not visible to other executors
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="seqlabel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


_FOLDERS: dict[str, str] = {}   # this process's folder, by application


def session_dir(spark: SparkSession) -> str:
    """A folder of this application under the shared one, which the file system
    deletes when the driver's JVM ends."""
    import uuid

    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        path = f"{shared_dir(spark)}/seqlabel-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm       # Spark has no public handle on the file system
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(place)
        fs.deleteOnExit(place)              # only what exists can be registered
        _FOLDERS[app] = path
    return _FOLDERS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the application's folder.  What is written there
    goes when the application ends."""
    import uuid

    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared folder and read back.  Runs a job
    while the plan is built; what reads it later neither recomputes nor depends
    on the executors that made it.  The folder goes when the application ends."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cluster_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Settings for a cluster run sized to the input.

    Shuffle partitions follow the data (about ``partition_bytes`` each, never
    fewer than two waves of cores) so partitions fit executor memory at any
    scale; AQE coalesces small ones and splits skewed join partitions at run
    time.  Apply with ``SparkSession.builder.config(map=...)`` or
    ``spark.conf.set`` before the jobs.
    """
    import math

    parts = max(2 * total_cores, math.ceil(input_bytes / partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.ui.enabled": "false",
    }
