"""Column expressions over label / score / vector arrays.

All of these are built-in Spark higher-order functions, so they stay inside
whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LN_EPS, THRESHOLD


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sigmoid(x: Column) -> Column:
    """Logistic function of one DOUBLE."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def probs(logits: str | Column) -> Column:
    """Elementwise sigmoid of a logit array."""
    return F.transform(_c(logits), sigmoid)


def hard_label(p: Column, threshold: float | Column = THRESHOLD, mode: str = "threshold") -> Column:
    """0/1 decision for one probability.

    ``threshold``: ``p >= t`` (0.5 -> 1).  ``round``: half-to-even rounding
    (0.5 -> 0, the behaviour of ``numpy.round``).  NaN always predicts 0.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if mode == "threshold":
        hit = (p >= t) & ~F.isnan(p)
    elif mode == "round":
        hit = (F.rint(p) >= F.lit(1.0)) & ~F.isnan(p)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(hit, F.lit(1)).otherwise(F.lit(0))


def predict(prob_arr: str | Column, threshold: float | Sequence[float] = THRESHOLD,
            mode: str = "threshold") -> Column:
    """0/1 label array from a probability array.

    ``threshold`` may be one number or one number per label.
    """
    arr = _c(prob_arr)
    if isinstance(threshold, (list, tuple)):
        ts = F.array(*[F.lit(float(t)) for t in threshold])
        return F.transform(arr, lambda p, i: hard_label(p, F.element_at(ts, i + 1), mode))
    return F.transform(arr, lambda p: hard_label(p, threshold, mode))


def confidence(logits: str | Column) -> Column:
    """Largest softmax probability of a logit array (max-shifted)."""
    z = _c(logits)
    m = F.array_max(z)
    denom = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return F.lit(1.0) / denom


def bce_cells(logits: str | Column, targets: str | Column) -> Column:
    """Per-cell binary cross entropy with logits, stable form
    ``max(z,0) - z*y + log1p(exp(-|z|))``; NULL where the target is NULL."""
    return F.zip_with(
        _c(logits), _c(targets),
        lambda z, y: F.greatest(z, F.lit(0.0)) - z * y.cast("double") + F.log1p(F.exp(-F.abs(z))),
    )


def dot(vec: str | Column, weights: Sequence[float] | Column) -> Column:
    """D3: dot product of a vector column with a constant (or column) vector."""
    w = weights if isinstance(weights, Column) else F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(_c(vec), w, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def with_layer_norm(df, vec: str, out: str, eps: float = LN_EPS):
    """D2 on a table: mean and centred variance as per-row columns, then the
    elementwise map; each statistic is computed once per row, not per element."""
    v = F.col(vec)
    n = F.size(v).cast("double")
    d = df.withColumn("_ln_mu", F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n)
    d = d.withColumn("_ln_sd", F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - F.col("_ln_mu")) * (x - F.col("_ln_mu"))) / n
                                      + F.lit(eps)))
    return d.withColumn(out, F.transform(v, lambda x: (x - F.col("_ln_mu")) / F.col("_ln_sd"))).drop("_ln_mu", "_ln_sd")


def linear(vec: str | Column, weight_rows: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """``W x + b`` for a small constant head (one output per weight row)."""
    v = _c(vec)
    outs = [dot(v, row) + F.lit(float(b)) for row, b in zip(weight_rows, bias)]
    return F.array(*outs)


def space_symbols(seq: str | Column) -> Column:
    """The symbols of a string joined by one blank ("ABC" -> "A B C")."""
    return F.array_join(F.filter(F.split(_c(seq), ""), lambda s: s != F.lit("")), " ")


def dominant(arr: str | Column, labels: Sequence[str] | None = None, on_empty: str = "null") -> Column:
    """Index (or name) of the first maximum of an array.

    An all-zero (or empty) row has no dominant label: NULL by default,
    ``on_empty="first"`` gives label 0, like an unguarded argmax.
    """
    a = _c(arr)
    if on_empty not in ("null", "first"):
        raise ValueError(f"unknown on_empty {on_empty!r}")
    pos = F.array_position(a, F.array_max(a)).cast("int")      # 1-based, first maximum
    if labels is None:
        out = pos - F.lit(1)
    else:
        out = F.element_at(F.array(*[F.lit(x) for x in labels]), F.greatest(pos, F.lit(1)))
    # the guard wraps the lookup itself (a NULL index must not reach element_at)
    return F.when(F.array_max(a) > F.lit(0), out) if on_empty == "null" else out


def predicted_names(pred: str | Column, labels: Sequence[str]) -> Column:
    """Names of the labels predicted 1, in label order (empty array if none)."""
    names = F.array(*[F.lit(x) for x in labels])
    p = _c(pred)
    kept = F.filter(F.arrays_zip(names.alias("name"), p.alias("pred")), lambda s: s["pred"] == F.lit(1))
    return F.transform(kept, lambda s: s["name"])


def round_array(arr: str | Column, digits: int = 6) -> Column:
    return F.transform(_c(arr), lambda x: F.round(x, digits))
