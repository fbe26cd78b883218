"""Curation of labelled sequence tables.

Sequences can be long (tens of thousands of symbols), so grouping by
sequence never shuffles the text: rows are keyed by ``sha2(sequence)`` plus
its length, and only that fixed-size key, the id and the labels move.  All
groupings are partial aggregations (a key holding a third of the rows is
combined map-side); joins back onto rows are equi-joins that AQE can split
when one key is hot.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MIN_SEQ_LEN


# --------------------------------------------------------------------- A2 / A3
def project(df: DataFrame, seq: str = "sequence", labels: Sequence[str] | None = None,
            drop: Iterable[str] = (), id_col: str | None = "id", out: str = "combined") -> DataFrame:
    """A2: keep id and labels, rename the sequence to ``out`` and move it last."""
    drop = set(drop)
    keep = [c for c in (labels if labels is not None else df.columns) if c not in drop and c not in (seq, id_col)]
    front = [id_col] if id_col and id_col in df.columns else []
    return df.select(*front, *keep, F.col(seq).alias(out))


def label_columns(df: DataFrame, reserved: Iterable[str] = ("id", "sequence", "combined")) -> list[str]:
    """A3: label columns = every column that is not reserved (schema only, no job)."""
    res = set(reserved)
    return [c for c in df.columns if c not in res]


def validate(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A3: one row per label: ``column, n, n_null, n_pos, n_not_binary`` in a single pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(labels):
        col = F.col(f"`{c}`")
        aggs += [F.count_if(col.isNull()).alias(f"nn{i}"), F.count_if(col == 1).alias(f"np{i}"),
                 F.count_if(col.isNotNull() & ~col.isin(0, 1)).alias(f"nb{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col("_n").alias("n"), F.col(f"nn{i}").alias("n_null"),
                     F.col(f"np{i}").alias("n_pos"), F.col(f"nb{i}").alias("n_not_binary"))
            for i, c in enumerate(labels)]
    return one.select(F.inline(F.array(*rows)))


def sequence_report(df: DataFrame, seq: str = "sequence", id_col: str = "id") -> DataFrame:
    """A3: rows, null and empty sequences, and ids used more than once (one row).

    One grouping by id (partial) followed by a global sum over its output."""
    s = F.col(seq)
    per_id = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_c"), F.count_if(s.isNull()).alias("_nn"),
                                    F.count_if(F.length(s) == 0).alias("_ne"))
    return per_id.agg(F.sum("_c").alias("n"), F.sum("_nn").alias("n_null_sequence"),
                      F.sum("_ne").alias("n_empty_sequence"), F.count_if(F.col("_c") > 1).alias("n_duplicate_ids"))


# --------------------------------------------------------------------- B1 / B2 / B5
def eligible(df: DataFrame, seq: str = "sequence", min_len: int = MIN_SEQ_LEN,
             exclude: Mapping[str, Sequence] | None = None, require: Mapping[str, Sequence] | None = None) -> DataFrame:
    """B1: length >= ``min_len``, no excluded value (e.g. kingdom, fragment flag),
    a required value where asked (e.g. evidence code).  Pushed to the scan where
    the predicates allow it."""
    cond = F.length(seq) >= min_len
    for c, vals in (exclude or {}).items():
        cond = cond & (F.col(c).isNull() | ~F.col(c).isin(list(vals)))
    for c, vals in (require or {}).items():
        cond = cond & F.col(c).isin(list(vals))
    return df.filter(cond)


def keep_levels(df: DataFrame, col: str, levels: Sequence) -> DataFrame:
    """B2: keep rows whose annotation level is one of ``levels``."""
    return df.filter(F.col(col).isin(list(levels)))


def restrict_labels(df: DataFrame, labels: Sequence[str], keep: Sequence[str], on_empty: str = "flag",
                    flag: str = "no_label") -> DataFrame:
    """Keep only the ``keep`` labels; rows left without a positive label are
    flagged (``on_empty='flag'``) or dropped (``'drop'``).  NULL counts as not positive."""
    others = [c for c in df.columns if c not in labels]
    has = F.greatest(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in keep]) > 0 if len(keep) > 1 \
        else F.coalesce(F.col(f"`{keep[0]}`"), F.lit(0)) > 0
    out = df.select(*others, *[F.col(f"`{c}`") for c in keep])
    if on_empty == "flag":
        return out.withColumn(flag, ~has)
    if on_empty == "drop":
        return out.filter(has)
    raise ValueError(f"unknown on_empty {on_empty!r}")


# --------------------------------------------------------------------- B3
def seq_key(seq: str | Column = "sequence") -> Column:
    """Fixed-size grouping key of a sequence: sha-256 and length; NULL for a
    missing sequence, which is no sequence and equals none."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.concat(F.sha2(s, 256), F.lit(":"), F.length(s).cast("string"))


def dedup_exact(df: DataFrame, labels: Sequence[str], seq: str = "sequence", id_col: str = "id",
                mode: str = "first", keep_sequence: bool = True) -> DataFrame:
    """One row per distinct sequence.

    Survivor = smallest id.  ``mode='first'``: the survivor's own labels;
    ``'union'``: a label is 1 if any copy has it (NULL only if no copy is
    annotated).  Output ``id, n_copies, *labels[, sequence]``.  Rows without a
    sequence are not copies of each other: each stays, with ``n_copies`` 1.
    Ids are unique.

    The aggregation holds fixed-width values only (ids, counts, labels), so it
    hashes and never sorts texts; the survivors' own labels and (with
    ``keep_sequence``) texts are fetched by a join on their ids.
    """
    keyed = df.select(id_col, seq_key(seq).alias("_k"), *[F.col(f"`{c}`") for c in labels]) \
        .withColumn("_solo", F.when(F.col("_k").isNull(), F.col(id_col)))
    if mode not in ("first", "union"):
        raise ValueError(f"unknown mode {mode!r}")
    own = labels if mode == "first" else []
    lab = [F.max(F.col(f"`{c}`")).alias(c) for c in labels if c not in own]
    out = keyed.groupBy("_k", "_solo").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n_copies"), *lab).drop("_k", "_solo")
    fetch = [*own, *([seq] if keep_sequence else [])]
    return out.join(df.select(id_col, *[F.col(f"`{c}`") for c in fetch]), id_col) if fetch else out


# --------------------------------------------------------------------- B6
def merge_annotations(sources: Mapping[str, DataFrame] | DataFrame, key: str, labels: Sequence[str],
                      source_col: str = "source") -> DataFrame:
    """Merge several annotation tables on ``key``.

    A label is positive if any source says so (max), ``<label>_conflict`` marks
    sources that disagree (max <> min over non-null values), and ``sources``
    lists the contributing source names, sorted.  Missing label columns in a
    source count as not annotated.  Rows without a key describe no common thing:
    each stays a row of its own.
    """
    if isinstance(sources, DataFrame):   # one table whose rows name their source
        tagged = sources.withColumn("_src", F.col(source_col))
    else:
        tagged = None
        for name, d in sources.items():
            t = d.withColumn("_src", F.lit(name))
            tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    aggs = []
    for c in labels:
        col = F.col(f"`{c}`")
        aggs += [F.max(col).alias(c), (F.max(col) != F.min(col)).alias(f"{c}_conflict")]
    # rows without a key are told apart by a number; all others share the null
    tagged = tagged.withColumn("_solo", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    return tagged.groupBy(key, "_solo").agg(*aggs, F.array_sort(F.collect_set("_src")).alias("sources")).drop("_solo")


# --------------------------------------------------------------------- B7
def cooccurrence(a: DataFrame, b: DataFrame, key: str, a_labels: Sequence[str], b_labels: Sequence[str]) -> DataFrame:
    """For each label of ``a`` (signal), the share of its positive rows that
    carry each label of ``b`` (compartment), joined on ``key``.

    Output ``signal, target, n_both, n_signal, pct, rank`` with rank 1 = the
    most frequent target (ties by target name).  Per-key positives are
    pre-aggregated to one row per key before the join; the ranking window runs
    on the small (signal x target) result.
    """
    def pos(df, labels, name):
        arr = F.filter(F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in labels]), lambda x: x.isNotNull())
        return df.select(key, F.explode(arr).alias(name)).distinct()

    sa, sb = pos(a, a_labels, "signal"), pos(b, b_labels, "target")
    n_sig = sa.groupBy("signal").agg(F.count(F.lit(1)).alias("n_signal"))
    both = sa.join(sb, key).groupBy("signal", "target").agg(F.count(F.lit(1)).alias("n_both"))
    out = both.join(n_sig, "signal").withColumn(
        "pct", F.round(F.col("n_both") * 100.0 / F.col("n_signal"), 1))
    w = Window.partitionBy("signal").orderBy(F.desc("n_both"), "target")
    return out.withColumn("rank", F.row_number().over(w))


# --------------------------------------------------------------------- B11
def label_counts(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per label value: ``*by, label, n_0, n_1`` (NULL cell when a value
    is absent; unannotated rows are not counted), one pass, no explode."""
    aggs = []
    for i, c in enumerate(labels):
        col = F.col(f"`{c}`")
        aggs += [F.count_if(col == 0).alias(f"z{i}"), F.count_if(col == 1).alias(f"o{i}")]
    g = df.groupBy(*by).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("label"),
                     F.when(F.col(f"z{i}") > 0, F.col(f"z{i}")).alias("n_0"),
                     F.when(F.col(f"o{i}") > 0, F.col(f"o{i}")).alias("n_1"))
            for i, c in enumerate(labels)]
    return g.select(*by, F.inline(F.array(*rows)))
