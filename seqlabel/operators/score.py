"""Scoring and training on feature tables.

* ``score``: batch inference through ``predict_batch_udf`` — the model is
  loaded once per Python worker, rows arrive as Arrow batches, logits go back
  as an array column; the id travels with the row.
* ``linear_head``: the same thing for a small constant head, as a SQL
  expression (no Python at all).
* ``fit_multilabel``: mean BCE over labels of a linear head on fixed features
  separates into one logistic regression per label; each fit is MLlib's
  distributed L-BFGS over a cached frame.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import COMPARTMENTS
from ..functions.arrays import linear


def rule_head(n_out: int, dim: int) -> tuple[list[list[float]], list[float]]:
    """Deterministic test head: ``w[l][j] = ((3l + 5j) mod 7 - 3) / 10``, ``b[l] = (l - 4) / 10``."""
    w = [[((3 * l + 5 * j) % 7 - 3) / 10.0 for j in range(dim)] for l in range(n_out)]
    b = [(l - 4) / 10.0 for l in range(n_out)]
    return w, b


def numpy_linear_loader(weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Callable:
    """A model loader for ``score``: returns a batch function ``X -> X W^T + b``."""
    W = np.asarray(weights, dtype=np.float64)
    b = np.asarray(bias, dtype=np.float64)

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return x.astype(np.float64) @ W.T + b
        return predict
    return make


def score(df: DataFrame, inputs: str, model_loader: Callable, n_out: int, dim: int, batch_size: int = 256,
          out: str = "logits") -> DataFrame:
    """Batch scoring with a user model loader (called once per worker)."""
    udf = predict_batch_udf(model_loader, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[dim]])
    return df.withColumn(out, udf(F.col(inputs)))


def linear_head(df: DataFrame, vec: str, weights: Sequence[Sequence[float]], bias: Sequence[float],
                out: str = "logits") -> DataFrame:
    """``logits = W x + b`` as one projection."""
    return df.withColumn(out, linear(vec, weights, bias))


def fit_multilabel(df: DataFrame, features: str = "features", targets: str = "targets",
                   labels: Sequence[str] = COMPARTMENTS, reg: float = 0.0, max_iter: int = 50, tol: float = 1e-6,
                   at_once: int = 4) -> DataFrame:
    """One logistic model per label on the same features.

    Output ``label_idx, label, weights ARRAY<DOUBLE>, bias, objective_first,
    objective_last, iterations`` — weights feed ``linear_head``.  The
    feature frame is cached for all labels (one pass per iteration per label
    happens on executors; only the coefficients come back).  ``at_once`` labels
    are fitted side by side, each from a thread with a scheduler pool of its own,
    so that one label's short passes fill the cores that another leaves idle.
    """
    base = df.select(array_to_vector(F.col(features)).alias("_x"), F.col(targets).alias("_y")).persist()
    spark = df.sparkSession

    def fitted(i: int, name: str) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"label-{i}")
        d = base.select("_x", F.element_at("_y", i + 1).cast("double").alias("_yi")).filter(F.col("_yi").isNotNull())
        lr = LogisticRegression(featuresCol="_x", labelCol="_yi", regParam=reg, maxIter=max_iter,
                                tol=tol, standardization=False)
        m = lr.fit(d)
        hist = m.summary.objectiveHistory
        return (i, name, [float(x) for x in m.coefficients.toArray()], float(m.intercept),
                float(hist[0]), float(hist[-1]), int(m.summary.totalIterations))

    try:
        base.count()        # cached once, before the labels start
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            rows = list(pool.map(inheritable_thread_target(spark)(fitted), range(len(labels)), labels))
    finally:
        base.unpersist()
    schema = "label_idx int, label string, weights array<double>, bias double, objective_first double, " \
             "objective_last double, iterations int"
    return spark.createDataFrame(rows, schema)


__all__ = ["rule_head", "numpy_linear_loader", "score", "linear_head", "fit_multilabel",
           "vector_to_array"]
