"""Evaluation of multi-label predictions.

Input frames carry one row per scored item with ``logits ARRAY<DOUBLE>`` and
``targets ARRAY<INT>`` in label order, plus grouping keys (``run``,
``split``, ``epoch`` ...).

Everything derives from one base aggregate per (group, label):
``tp, fp, fn, tn, n, n_null, n_eq_round, bce_sum``.  It is computed *wide*:
one aggregation with a handful of sums per label over the array elements, so
the data is never exploded to N x L rows; partial (map-side) aggregation cuts
each task's output to one row per group before the shuffle, and only the
tiny result is un-pivoted to one row per label.  A hot group therefore costs
nothing extra: it is combined on the map side like every other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COMPARTMENTS, THRESHOLD
from ..functions.arrays import bce_cells, hard_label, predict, probs, sigmoid


def _div(a: Column, b: Column) -> Column:
    """a / b in DOUBLE, 0 where undefined (library default of the reports)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _row_right(y: Column, h: Column) -> Column:
    """Whether every annotated label of a row is right; NULL when none is."""
    known = F.exists(y, lambda v: v.isNotNull())
    return F.when(known, F.forall(F.zip_with(y, h, lambda v, p: v.isNull() | (v == p)), lambda ok: ok))


# --------------------------------------------------------------------- F0
def confusion(df: DataFrame, by: Sequence[str] = ("run",), labels: Sequence[str] = COMPARTMENTS,
              logits: str = "logits", targets: str = "targets", threshold: float = THRESHOLD,
              pred: str | None = None) -> DataFrame:
    """confusion counts per (by, label).

    Output: ``*by, label_idx, label, tp, fp, fn, tn, n, n_null, n_eq_round, bce_sum,
    n_rows, n_exact`` (the last two are per group: rows, rows with all labels right).
    ``n`` counts annotated cells (NULL target = not annotated, excluded).
    ``n_eq_round`` counts cells whose half-to-even rounded probability equals
    the truth (the elementwise accuracy of the training loop).  When ``pred``
    names a 0/1 array column it is used instead of thresholding the logits
    (ensembles); then ``bce_sum`` and ``n_eq_round`` are NULL.  A row counts in
    ``n_exact`` when its annotated labels are all right and in ``n_rows`` when it
    has any annotated label; rows without one say nothing about accuracy.
    """
    by = list(by)
    L = len(labels)
    y = F.col(targets)
    if pred is None:
        z = F.col(logits)
        p = probs(z)
        yhat = predict(p, threshold)
        yrnd = predict(p, mode="round")
        bce = bce_cells(z, y)
    else:
        yhat = F.col(pred)
        yrnd = bce = None
    base = df.select(*by, y.alias("_y"), yhat.alias("_h"),
                     *( [yrnd.alias("_r"), bce.alias("_b")] if pred is None else []))
    # group-level: rows, and rows with every label right (subset accuracy)
    aggs = [F.count(_row_right(F.col("_y"), F.col("_h"))).alias("_rows"), F.count_if(_row_right(F.col("_y"), F.col("_h"))).alias("_exact")]
    for i in range(L):
        yi = F.element_at("_y", i + 1)
        hi = F.element_at("_h", i + 1)
        ok = yi.isNotNull()
        aggs += [
            F.count_if(ok & (yi == 1) & (hi == 1)).alias(f"tp{i}"),
            F.count_if(ok & (yi == 0) & (hi == 1)).alias(f"fp{i}"),
            F.count_if(ok & (yi == 1) & (hi == 0)).alias(f"fn{i}"),
            F.count_if(ok & (yi == 0) & (hi == 0)).alias(f"tn{i}"),
            F.count_if(~ok).alias(f"nn{i}"),
        ]
        if pred is None:
            aggs += [
                F.count_if(ok & (yi == F.element_at("_r", i + 1))).alias(f"eq{i}"),
                F.sum(F.element_at("_b", i + 1)).alias(f"b{i}"),
            ]
    wide = base.groupBy(*by).agg(*aggs)
    rows = []
    for i, name in enumerate(labels):
        fields = [
            F.lit(i).alias("label_idx"), F.lit(name).alias("label"),
            F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
            F.col(f"fn{i}").alias("fn"), F.col(f"tn{i}").alias("tn"),
            (F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}") + F.col(f"tn{i}")).alias("n"),
            F.col(f"nn{i}").alias("n_null"),
            (F.col(f"eq{i}") if pred is None else F.lit(None).cast("bigint")).alias("n_eq_round"),
            (F.col(f"b{i}") if pred is None else F.lit(None).cast("double")).alias("bce_sum"),
            F.col("_rows").alias("n_rows"), F.col("_exact").alias("n_exact"),
        ]
        rows.append(F.struct(*fields))
    return wide.select(*by, F.inline(F.array(*rows)))


# --------------------------------------------------------------------- F5 / F8
def label_report(conf: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """F5 + F8 from F0: precision, recall, F1, support and MCC per label.

    Undefined ratios are 0; MCC is 0 when any margin is 0.  Products are in
    DOUBLE (BIGINT products overflow at scale).
    """
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    denom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return conf.select(
        *by, "label_idx", "label", "tp", "fp", "fn", "tn", "n", "n_eq_round", "n_rows", "n_exact",
        _div(tp, tp + fp).alias("precision"),
        _div(tp, tp + fn).alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
        F.when(denom > 0, (tp * tn - fp * fn) / denom).otherwise(F.lit(0.0)).alias("mcc"),
    )


# --------------------------------------------------------------------- F6
def avg_report(conf: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """micro (pooled counts), macro (plain mean) and weighted (support-weighted) averages."""
    return _averages(label_report(conf, by), by)


def _averages(rep: DataFrame, by: Sequence[str]) -> DataFrame:
    g = rep.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.sum(F.col("precision") * F.col("support")).alias("_wp"),
        F.sum(F.col("recall") * F.col("support")).alias("_wr"),
        F.sum(F.col("f1") * F.col("support")).alias("_wf"),
        F.sum("support").alias("support"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return g.select(
        *by,
        _div(tp, tp + fp).alias("micro_precision"),
        _div(tp, tp + fn).alias("micro_recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        "macro_precision", "macro_recall", "macro_f1",
        _div(F.col("_wp"), F.col("support")).alias("weighted_precision"),
        _div(F.col("_wr"), F.col("support")).alias("weighted_recall"),
        _div(F.col("_wf"), F.col("support")).alias("weighted_f1"),
        "support",
    )


# --------------------------------------------------------------------- F1 / F2
def bce_loss(df: DataFrame, by: Sequence[str] = ("run",), logits: str = "logits",
             targets: str = "targets", batch: str | None = None) -> DataFrame:
    """mean BCE-with-logits.

    Without ``batch``: mean over all annotated cells (= mean of per-row means
    when rows are complete, the batch-size-1 case).  With ``batch``: mean over
    batches of the per-batch cell mean (two-level grouping, both partial).
    """
    by = list(by)
    cells = F.aggregate(F.filter(bce_cells(logits, targets), lambda x: x.isNotNull()),
                        F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n")),
                        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n")))
    rows = df.select(*by, *( [batch] if batch else []), cells.alias("_c"))
    if batch is None:
        return rows.groupBy(*by).agg(_div(F.sum("_c.s"), F.sum("_c.n")).alias("loss"))
    per_batch = rows.groupBy(*by, batch).agg(_div(F.sum("_c.s"), F.sum("_c.n")).alias("_bl"))
    return per_batch.groupBy(*by).agg(F.avg("_bl").alias("loss"))


def cell_accuracy(conf: DataFrame, by: Sequence[str] = ("run",), mode: str = "round") -> DataFrame:
    """equal cells / annotated cells.  ``round`` = half-to-even labels (training loop);
    ``threshold`` = ``p >= 0.5`` labels."""
    num = F.sum("n_eq_round") if mode == "round" else F.sum(F.col("tp") + F.col("tn"))
    return conf.groupBy(*by).agg(_div(num, F.sum("n")).alias("accuracy"))


# --------------------------------------------------------------------- F3 / F4
def subset_accuracy(df: DataFrame, by: Sequence[str] = ("run",), pred: str = "pred",
                    targets: str = "targets") -> DataFrame:
    """share of rows with every annotated label right; rows without an
    annotated label are left out."""
    right = _row_right(F.col(targets), F.col(pred))
    return df.groupBy(*by).agg(F.avg(right.cast("double")).alias("subset_accuracy"))


def sample_metrics(df: DataFrame, by: Sequence[str] = ("run",), pred: str = "pred",
                   targets: str = "targets") -> DataFrame:
    """per-row precision / recall / F1 averaged over rows ("samples" average).

    Labels that are not annotated (NULL target) are left out of a row, with
    their predictions; a row without any annotated label is left out of the
    averages.  A row with no true and no predicted label scores 0 (library
    default)."""
    cells = F.filter(F.arrays_zip(F.col(targets).alias("y"), F.col(pred).alias("h")), lambda c: c["y"].isNotNull())
    count = lambda test: F.size(F.filter("_cells", test)).cast("bigint")
    rows = df.select(*by, cells.alias("_cells")).filter(F.size("_cells") > 0).select(
        *by, F.size("_cells").alias("_n"),
        count(lambda c: (c["y"] == 1) & (c["h"] == 1)).alias("_tp"), count(lambda c: c["h"] == 1).alias("_pred"),
        count(lambda c: c["y"] == 1).alias("_true"), count(lambda c: c["y"] == c["h"]).alias("_eq"))
    tp, npred, ntrue = F.col("_tp"), F.col("_pred"), F.col("_true")
    return rows.groupBy(*by).agg(
        F.avg(_div(tp, npred)).alias("samples_precision"),
        F.avg(_div(tp, ntrue)).alias("samples_recall"),
        F.avg(_div(2 * tp, npred + ntrue)).alias("samples_f1"),
        F.avg(_div(F.col("_eq"), F.col("_n"))).alias("samples_accuracy"),
        F.sum(ntrue).alias("support"),
    )


# --------------------------------------------------------------------- F7
def f1_vector(conf: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """F1 per label as one array in label order (sorted by index, never by
    collection order)."""
    rep = label_report(conf, by)
    return rep.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("label_idx", "f1"))), lambda s: s["f1"]).alias("f1_per_label")
    )


def _ordered(col: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("label_idx", col))), lambda s: s[col])


# --------------------------------------------------------------------- F9
def run_results(df: DataFrame, labels: Sequence[str] = COMPARTMENTS, run: str = "run",
                wide: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """one row per run: accuracy (rounded labels), macro / micro F1,
    MCC per label, and per-label F1 / precision / recall.

    ``wide=False`` returns the long per-label table instead of pivoted columns.
    """
    conf = confusion(df, [run], labels, threshold=threshold)
    rep = label_report(conf, [run])
    if not wide:
        return rep
    # one aggregation over the (runs x labels) report: no re-scan per statistic
    g = rep.groupBy(run).agg(*_report_aggs(labels))
    return g.select(
        F.col(run), _div(F.col("_eq"), F.col("_n")).alias("test_accuracy"), "macro_f1", "micro_f1", "mcc_per_label",
        *[f"{name} {t}" for name in labels for t in ("F1", "Precision", "Recall")],
    )


def _report_aggs(labels: Sequence[str], mcc_name: str = "mcc_per_label") -> list[Column]:
    tp, fp, fn = (F.sum(c).cast("double") for c in ("tp", "fp", "fn"))
    return [
        F.sum("n_eq_round").alias("_eq"), F.sum("n").alias("_n"),
        F.first("n_exact").alias("_exact"), F.first("n_rows").alias("_rows"),
        F.avg("f1").alias("macro_f1"),
        _div(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        _ordered("mcc").alias(mcc_name),
        *[F.max(F.when(F.col("label_idx") == i, F.col(m))).alias(f"{name} {t}")
          for i, name in enumerate(labels)
          for m, t in (("f1", "F1"), ("precision", "Precision"), ("recall", "Recall"))],
    ]


# --------------------------------------------------------------------- F10
def summarize_runs(results: DataFrame, labels: Sequence[str] = COMPARTMENTS) -> DataFrame:
    """mean and population std over runs for accuracy, macro / micro F1,
    and MCC per label.  Output long: ``metric, mean, std, n_runs``."""
    cols = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
            for m in ("test_accuracy", "macro_f1", "micro_f1")]
    cols += [F.struct(F.lit(f"mcc {name}").alias("metric"), F.element_at("mcc_per_label", i + 1).alias("v"))
             for i, name in enumerate(labels)]
    long = results.select(F.inline(F.array(*cols)))
    return long.groupBy("metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("n_runs"))


# --------------------------------------------------------------------- F11 / F12
def ensemble(preds: DataFrame, labels: Sequence[str] = COMPARTMENTS, key: str = "id", run: str = "run",
             mode: str = "vote", threshold: float = THRESHOLD, check: bool = False) -> DataFrame:
    """combine runs per item.

    ``vote``: mean of the 0/1 votes, ``> 0.5`` strictly (a tie predicts 0).
    ``prob``: mean probability, ``>= threshold``.  Targets are those of the
    lowest run.  ``n_runs`` is kept; ``check=True`` raises when items were
    scored a different number of times (runs no not line up).
    """
    L = len(labels)
    src = preds.select(key, run, F.col("targets"),
                       (predict(probs("logits"), threshold) if mode == "vote" else probs("logits")).alias("_v"))
    g = src.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_runs"),
        # one number per (run, label) keeps the buffer fixed-width, so the aggregate hashes:
        # 3 * run + (0, 1 or 2 for not annotated); the least belongs to the lowest run
        *[F.min(F.col(run).cast("bigint") * 3 + F.coalesce(F.element_at("targets", i + 1), F.lit(2))).alias(f"t{i}") for i in range(L)],
        *[F.avg(F.element_at("_v", i + 1).cast("double")).alias(f"m{i}") for i in range(L)],
    ).withColumn("targets", F.array(*[F.nullif(F.pmod(F.col(f"t{i}"), F.lit(3)).cast("int"), F.lit(2)) for i in range(L)]))
    if mode == "vote":
        pred = F.array(*[(F.col(f"m{i}") > 0.5).cast("int") for i in range(L)])
    else:
        pred = F.array(*[hard_label(F.col(f"m{i}"), threshold) for i in range(L)])
    out = g.select(key, "n_runs", "targets", pred.alias("pred"))
    if check:
        bad = out.agg(F.min("n_runs").alias("lo"), F.max("n_runs").alias("hi")).first()
        if bad is not None and bad["lo"] != bad["hi"]:
            raise ValueError(f"runs do not line up: items scored {bad['lo']}..{bad['hi']} times")
    return out


def ensemble_report(preds: DataFrame, labels: Sequence[str] = COMPARTMENTS, key: str = "id",
                    run: str = "run") -> DataFrame:
    """the F3 + F5 + F6 + F8 report on the F11 vote, one wide row."""
    ens = ensemble(preds, labels, key, run).withColumn("_g", F.lit(0))
    rep = label_report(confusion(ens, ["_g"], labels, pred="pred"), ["_g"])
    g = rep.groupBy("_g").agg(*_report_aggs(labels, "Ensemble MCC per Label"))
    return g.select(
        _div(F.col("_exact"), F.col("_rows")).alias("Ensemble Test Accuracy"),
        F.col("macro_f1").alias("Ensemble Macro F1"),
        F.col("micro_f1").alias("Ensemble Micro F1"),
        "Ensemble MCC per Label",
        *[f"{name} {t}" for name in labels for t in ("F1", "Precision", "Recall")],
    )


# --------------------------------------------------------------------- F13 / F14
def history(scored: DataFrame, by: Sequence[str] = ("epoch",), split: str = "split",
            labels: Sequence[str] = COMPARTMENTS) -> DataFrame:
    """loss and accuracy per (by, split), pivoted to ``<split>_loss`` / ``<split>_acc``."""
    return history_from_confusion(confusion(scored, [*by, split], labels), by, split)


def history_from_confusion(conf: DataFrame, by: Sequence[str] = ("epoch",), split: str = "split") -> DataFrame:
    """F14 from an F0 table grouped by (by, split), so one base aggregate can
    feed the history and other reports of the same epochs."""
    by = list(by)
    g = conf.groupBy(*by, split).agg(
        _div(F.sum("n_eq_round"), F.sum("n")).alias("acc"),
        _div(F.sum("bce_sum"), F.sum("n")).alias("loss"),
    )
    splits = ["train", "test"]
    return g.groupBy(*by).pivot(split, splits).agg(F.first("acc").alias("acc"), F.first("loss").alias("loss"))


def store_epochs(scored: DataFrame, path: str, epoch: str = "epoch", split: str = "split",
                 labels: Sequence[str] = COMPARTMENTS) -> DataFrame:
    """F14, resumable: the F0 counts of the epochs that ``path`` does not hold
    yet are added to it, one partition each, and the whole history is returned.

    Counts are additive, so the stored table is all that an earlier epoch's
    predictions are needed for: they are read once, when the epoch is added.  A
    run that stopped is repeated as it is; an epoch is there as a whole or not
    at all, and one that is written again replaces itself."""
    spark = scored.sparkSession
    try:
        done = [r[0] for r in spark.read.parquet(path).select(epoch).distinct().collect()]   # one row per epoch
    except AnalysisException:       # nothing is stored yet
        done = []
    todo = scored.filter(~F.col(epoch).isin(done)) if done else scored
    counts = confusion(todo, [epoch, split], labels)
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(epoch).parquet(path)
    return history_from_confusion(spark.read.schema(counts.schema).parquet(path), [epoch], split)


def best_so_far(hist: DataFrame, metric: str, order: str = "epoch", by: Sequence[str] = ()) -> DataFrame:
    """running best of ``metric``: a new best only when strictly greater
    than every earlier value (ties keep the first), starting from 0.

    The window runs over the (tiny) history table, one row per epoch."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1) if by else \
        Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(metric).over(w), F.lit(0.0))
    return hist.withColumn("best_before", before) \
        .withColumn("is_new_best", F.col(metric) > F.col("best_before")) \
        .withColumn("best", F.greatest(F.col(metric), F.col("best_before")))


def with_predictions(df: DataFrame, logits: str = "logits", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``probs`` and ``pred`` (threshold labels) to a scored frame."""
    return df.withColumn("probs", probs(logits)).withColumn("pred", predict("probs", threshold))


__all__ = [
    "confusion", "label_report", "avg_report", "bce_loss", "cell_accuracy", "subset_accuracy",
    "sample_metrics", "f1_vector", "run_results", "summarize_runs", "ensemble", "ensemble_report",
    "history", "best_so_far", "with_predictions", "sigmoid",
]
