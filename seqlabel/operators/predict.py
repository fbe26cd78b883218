"""Prediction post-processing.

Scored frames carry ``id``, grouping keys (``run`` / ``split`` / ``epoch``),
``logits`` and ``targets``.  Everything is expressions, equi-joins on the row
id and partial aggregations; no positional alignment of rows is ever assumed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COMPARTMENTS, THRESHOLD
from ..functions.arrays import confidence, predict, predicted_names, probs


def score_columns(df: DataFrame, logits: str = "logits", threshold: float = THRESHOLD) -> DataFrame:
    """E1 + E2 + E4: adds ``probs``, ``pred`` (``p >= threshold``) and ``confidence``."""
    return df.withColumn("probs", probs(logits)) \
        .withColumn("pred", predict("probs", threshold)) \
        .withColumn("confidence", confidence(logits))


def attach(df: DataFrame, scored: DataFrame, id_col: str = "id") -> DataFrame:
    """E5: scores joined back onto their source rows by id (not by position)."""
    return df.join(scored, id_col, "inner")


def unmatched(df: DataFrame, scored: DataFrame, id_col: str = "id") -> DataFrame:
    """E5: ids present on one side only: ``side`` = 'source' or 'scores'."""
    a = df.select(id_col).join(scored.select(id_col), id_col, "left_anti").withColumn("side", F.lit("source"))
    b = scored.select(id_col).join(df.select(id_col), id_col, "left_anti").withColumn("side", F.lit("scores"))
    return a.unionByName(b)


def misclassified(df: DataFrame, label: int | str = 0, labels: Sequence[str] = COMPARTMENTS,
                  title: str = "id", by: Sequence[str] = ("run",), threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose prediction for ``label`` differs from the truth.

    ``label`` is an index, a name, or ``"any"`` (one row per wrong cell).
    Output ``*by, title, label, true_label, predicted_label, confidence``;
    an empty result keeps this schema.
    """
    s = score_columns(df, threshold=threshold)
    cells = s.select(*by, F.col(title).alias("title"), "confidence",
                     F.posexplode(F.arrays_zip(F.col("targets").alias("t"), F.col("pred").alias("p"))))
    if label != "any":
        idx = labels.index(label) if isinstance(label, str) else int(label)
        # only one cell per row: take it by index instead of exploding
        cells = s.select(*by, F.col(title).alias("title"), "confidence", F.lit(idx).alias("pos"),
                         F.struct(F.element_at("targets", idx + 1).alias("t"),
                                  F.element_at("pred", idx + 1).alias("p")).alias("col"))
    names = F.array(*[F.lit(x) for x in labels])
    return cells.filter(F.col("col.t").isNotNull() & (F.col("col.t") != F.col("col.p"))).select(
        *by, "title", F.element_at(names, F.col("pos") + 1).alias("label"),
        F.col("col.t").alias("true_label"), F.col("col.p").alias("predicted_label"), "confidence")


def error_counts(wrong: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """False negatives (truth 1) and false positives (truth 0) per group."""
    return wrong.groupBy(*by, "label").agg(
        F.count_if(F.col("true_label") == 1).alias("n_false_negative"),
        F.count_if(F.col("true_label") == 0).alias("n_false_positive"),
    )


def compare_runs(a: DataFrame, b: DataFrame, key: str = "id", order: str | None = None, label: int = 0,
                 only_errors: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """Compare two runs' predictions for one label, matched on ``key``.

    The right side keeps its *first* row per key by ``order`` (e.g. the row's
    position in its source; without an order a repeated key fails the query), reduced with
    ``min_by`` — a partial aggregate, so a hot key is combined map-side.
    Duplicate keys on the left all stay.  Outcome: ``both_right``,
    ``both_wrong``, ``fixed`` (a wrong, b right) or ``broken`` (a right, b
    wrong).  ``only_errors`` reproduces the narrow form of the original loop:
    both inputs are first reduced to their wrong rows.
    """
    def cells(df):
        s = score_columns(df, threshold=threshold)
        return s.select(key, *( [order] if order and order != key else []),
                        F.element_at("targets", label + 1).alias("true_label"),
                        F.element_at("pred", label + 1).alias("pred"), "confidence")

    left, right = cells(a), cells(b)
    if only_errors:
        left = left.filter(F.col("true_label") != F.col("pred"))
        right = right.filter(F.col("true_label") != F.col("pred"))
    first = right.groupBy(key).agg(F.min_by(F.struct("pred", "confidence"), F.col(order or key)).alias("_r"), F.count(F.lit(1)).alias("_k"))
    if order is None:      # without an order no row of a repeated key is the first
        first = first.withColumn("_r", F.when(F.col("_k") == 1, F.col("_r")).otherwise(
            F.raise_error(F.lit("compare_runs needs an order: a key repeats on the right")).cast(first.schema["_r"].dataType)))
    first = first.drop("_k")
    j = left.join(first, key, "inner")
    y, p1, p2 = F.col("true_label"), F.col("pred"), F.col("_r.pred")
    outcome = (F.when((p1 == y) & (p2 == y), "both_right").when((p1 != y) & (p2 != y), "both_wrong")
               .when(p2 == y, "fixed").otherwise("broken"))
    return j.select(key, "true_label", p1.alias("predicted_label_a"), p2.alias("predicted_label_b"),
                    F.col("confidence").alias("confidence_a"), F.col("_r.confidence").alias("confidence_b"),
                    (p1 == p2).alias("same"), outcome.alias("outcome"))


def compare_summary(cmp: DataFrame) -> DataFrame:
    """Rows per (outcome, same, true_label)."""
    return cmp.groupBy("outcome", "same", "true_label").agg(F.count(F.lit(1)).alias("n"))


def mean_confidence(df: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Mean confidence and row count per group."""
    return df.withColumn("_c", confidence("logits")).groupBy(*by).agg(
        F.avg("_c").alias("mean_confidence"), F.count(F.lit(1)).alias("n"))


def with_names(df: DataFrame, labels: Sequence[str] = COMPARTMENTS, threshold: float = THRESHOLD) -> DataFrame:
    """Predicted label names per row (empty array when none)."""
    return df.withColumn("predicted", predicted_names(predict(probs("logits"), threshold), labels))


def feature_table(scored_by_split: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """Logits as features next to targets, all splits stacked."""
    parts = [df.select(id_col, F.lit(name).alias("split"), F.col("logits").alias("features"), "targets")
             for name, df in scored_by_split.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
