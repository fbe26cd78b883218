"""A4 / A5: result tables and the per-epoch run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """A4: write a result table.

    With ``partition`` (e.g. run, split) only the partitions present in ``df``
    are replaced (dynamic partition overwrite), so re-running one run or one
    epoch is idempotent and leaves the others alone.  ``fmt='csv'`` writes a
    header row; CSV has no arrays, so array columns become JSON text
    (``[1,2,3]``), which ``from_json`` reads back.
    """
    if fmt == "csv":
        arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
        df = df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in arrays})
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition:
        w = w.partitionBy(*partition)
    if fmt == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def run_log(wide: DataFrame, keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """A5: a wide per-epoch metrics frame as ``(*keys, metric, value)`` rows
    (every non-key numeric column becomes one metric)."""
    metrics = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), metrics, "metric", "value").filter(F.col("value").isNotNull())


def append_log(log: DataFrame, path: str, keys: Sequence[str] = ("epoch",)) -> None:
    """A5: append log rows, replacing only the epochs being written (resumable)."""
    write_table(log, path, partition=list(keys))
