"""Attention pooling over per-position vectors (D2-D7), as table operations.

Input is long: one row per (key, position) with a vector.  Group-level
statistics (softmax max and sum, pooled vector) are partial aggregations whose
states merge, brought back to the rows by ``join_back`` where rows need them,
never windows over a whole key, so a key holding a third of the rows is still
spread over many tasks.  The only ordered step, the
Gaussian smoothing along positions, runs in windows over fixed-size chunks of
a key (with a halo of ``sigma`` rows from each neighbouring chunk).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LN_EPS, SMOOTH_SIGMA
from ..functions.arrays import dot, with_layer_norm
from ..session import materialized
from .rank import ordered_rank

CHUNK = 65_536   # positions per smoothing window partition
SALTS = 16       # parts that a key's rows are dealt to where its statistic can't be broadcast
UNIT = 64 * math.log(2)   # a step of the softmax scale: weights within it are 1 to 2**64
BROADCAST_KEYS = 200_000   # keys whose statistics (two numbers each) are broadcast


def gaussian_weights(sigma: int) -> list[float]:
    """Normalised Gaussian kernel on offsets -sigma..sigma (truncated at one
    sigma); sigma = 0 is the identity."""
    if sigma == 0:
        return [1.0]
    raw = [math.exp(-(k * k) / (2.0 * sigma * sigma)) for k in range(-sigma, sigma + 1)]
    s = sum(raw)
    return [x / s for x in raw]


def join_back(df: DataFrame, stats: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``df`` with the per-key columns of ``stats`` (one row per key).

    The statistics are written once.  Up to ``BROADCAST_KEYS`` keys they are
    broadcast and the rows stay where they are; beyond, the rows are dealt over
    ``salts`` parts of their key and each statistic is copied to all of them, so
    no task gets more than about a ``salts``-th of a hot key."""
    stats = materialized(stats, "stats")
    if stats.count() <= BROADCAST_KEYS:
        return df.join(F.broadcast(stats), key, how)
    salted = df.withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def gaussian_smooth(df: DataFrame, key: str, order: Sequence[str] | str, value: str, sigma: int = SMOOTH_SIGMA,
                    out: str = "smoothed", dense_pos: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Gaussian smoothing of ``value`` along ``order`` within each ``key``,
    edges replicated (the first / last value stands in beyond the ends).

    ``dense_pos`` names a column already holding 0..n-1 within the key;
    otherwise positions come from an exact global rank over (key, order) minus
    the key's first rank (a partial aggregate joined back).  The window runs
    over (key, chunk of ``chunk`` positions); each chunk also receives the
    ``sigma`` rows on either side as a halo, which are dropped afterwards.
    """
    if sigma < 0 or int(sigma) != sigma:
        raise ValueError("sigma must be a non-negative integer")
    sigma = int(sigma)
    if sigma == 0:
        return df.withColumn(out, F.col(value).cast("double"))
    order = [order] if isinstance(order, str) else list(order)
    if dense_pos is None:
        ranked = ordered_rank(df, [key, *order], out="_g")
        base = join_back(ranked, ranked.groupBy(key).agg(F.min("_g").alias("_lo")), key).withColumn("_pos", F.col("_g") - F.col("_lo")).drop("_g", "_lo")
    else:
        base = df.withColumn("_pos", F.col(dense_pos).cast("bigint"))
    c = F.lit(chunk)
    home = F.floor(F.col("_pos") / c)
    off = F.col("_pos") % c
    # own chunk (halo flag false), plus copies for the neighbours
    targets = F.array(
        F.struct(home.alias("_chunk"), F.lit(False).alias("_halo")),
        F.when(off < sigma, F.struct((home - 1).alias("_chunk"), F.lit(True).alias("_halo"))),
        F.when(off >= chunk - sigma, F.struct((home + 1).alias("_chunk"), F.lit(True).alias("_halo"))),
    )
    rep = base.withColumn("_t", F.explode(F.filter(targets, lambda t: t.isNotNull() & (t["_chunk"] >= 0)))) \
        .select("*", "_t._chunk", "_t._halo").drop("_t")
    w = Window.partitionBy(key, "_chunk").orderBy("_pos")
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col(value).cast("double")
    first, last = F.first(v).over(wall), F.last(v).over(wall)
    wts = gaussian_weights(sigma)
    acc = F.lit(wts[sigma]) * v
    for k in range(1, sigma + 1):
        acc = acc + F.lit(wts[sigma - k]) * F.coalesce(F.lag(v, k).over(w), first)
        acc = acc + F.lit(wts[sigma + k]) * F.coalesce(F.lead(v, k).over(w), last)
    res = rep.withColumn(out, acc).filter(~F.col("_halo")).drop("_chunk", "_halo")
    return res if dense_pos is not None else res.drop("_pos")


def _scaled(score: str, ok: Column) -> tuple[Column, Column]:
    """A score's step on a scale of ``UNIT`` and ``exp`` of what is left of it:
    the parts of a softmax that can be summed before its maximum is known.  Sums
    of one step are added as they are, and steps are brought together by
    ``exp((step - top) * UNIT)``, so partial states merge in any order.  No step
    for masked and missing scores and for -inf, which weigh nothing."""
    s = F.col(score).cast("double")
    bad = F.isnan(s) | (s == float("inf"))      # as in exp(inf - inf): the whole key is NaN
    live = ok & s.isNotNull() & (bad | (s > float("-inf")))
    step = F.when(live, F.when(bad, F.lit(1 << 40)).otherwise(F.floor(F.when(bad, 0.0).otherwise(s) / F.lit(UNIT))))
    return step, F.when(bad, F.lit(float("nan"))).otherwise(F.exp(s - step * F.lit(UNIT)))


def _softmax_stats(df: DataFrame, key: str, score: str, ok: Column) -> DataFrame:
    """Per key the top step and the sum of the weights relative to it, from one
    partial aggregate over the rows; a key without live rows has nulls."""
    step, part = _scaled(score, ok)
    by_step = df.select(key, step.alias("_e"), part.alias("_w")).groupBy(key, "_e").agg(F.sum("_w").alias("_w"))
    states = by_step.groupBy(key).agg(F.max("_e").alias("_top"), F.collect_list(F.when(F.col("_e").isNotNull(), F.struct("_e", "_w"))).alias("_all"))
    total = F.aggregate("_all", F.lit(0.0), lambda z, x: z + x["_w"] * F.exp((x["_e"] - F.col("_top")) * F.lit(UNIT)))
    return states.select(key, "_top", F.when(F.col("_top").isNotNull(), total).alias("_z"))


def group_softmax(df: DataFrame, key: str, score: str, mask: str | None = None, out: str = "weight") -> DataFrame:
    """Softmax of ``score`` within each key; masked rows get weight 0, the
    rest sum to 1; a key with every row masked gets NULL weights.

    One pass gives each key's maximum and sum together (``_scaled``); they return
    to the rows by ``join_back``."""
    ok = F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True)
    e = join_back(df, _softmax_stats(df, key, score, ok), key)
    weight = F.when(ok, F.exp(F.col(score) - F.col("_top") * F.lit(UNIT)) / F.col("_z")).otherwise(F.lit(0.0))
    return e.withColumn(out, F.when(F.col("_top").isNotNull(), weight)).drop("_top", "_z")


def _smoothed(pos_df: DataFrame, q: Sequence[float], key: str, pos: str, vec: str, mask: str | None, sigma: int, eps: float) -> DataFrame:
    """Unmasked positions with their normalised vector and smoothed score.  The
    unmasked prefix is dense (0 to its length), so no ranking is needed."""
    base = with_layer_norm(pos_df, vec, "_ln", eps).withColumn("_s", dot("_ln", q))
    live = base.filter(F.col(mask)) if mask else base
    return gaussian_smooth(live.select(key, pos, "_ln", "_s"), key, pos, "_s", sigma, out="_ss", dense_pos=pos)


def pooled_vectors(pos_df: DataFrame, q: Sequence[float], key: str = "key", pos: str = "pos", vec: str = "vec",
                   mask: str | None = "mask", sigma: int = SMOOTH_SIGMA, eps: float = LN_EPS) -> DataFrame:
    """Layer norm -> score = dot(q) -> smoothing over the unmasked positions
    -> masked softmax -> weighted sum of the normalised vectors: ``(key, pooled
    ARRAY<DOUBLE>)``, NULL for a key with every position masked.

    One lazy plan, one pass over the positions: each step's weights and weighted
    vectors are summed by a partial aggregate (MLlib's ``Summarizer``, any
    width), and a key's few steps are brought to its top one, which needs neither
    the maximum nor the sum beforehand."""
    step, part = _scaled("_ss", F.lit(True))
    live = _smoothed(pos_df, q, key, pos, vec, mask, sigma, eps).select(key, "_ln", step.alias("_e"), part.alias("_w")).filter(F.col("_e").isNotNull())
    sums = live.groupBy(key, "_e").agg(
        Summarizer.metrics("mean").summary(array_to_vector("_ln"), F.col("_w")).alias("_m"), F.sum("_w").alias("_w"))
    parts = sums.select(key, F.struct("_e", "_w", vector_to_array(F.col("_m.mean")).alias("_v")).alias("_p"))
    keys = pos_df.select(key, F.lit(None).cast(parts.schema["_p"].dataType).alias("_p")).distinct() if mask else None
    states = (parts if keys is None else parts.unionByName(keys)).groupBy(key).agg(F.max("_p._e").alias("_top"), F.collect_list("_p").alias("_all"))
    scale = lambda x: F.exp((x["_e"] - F.col("_top")) * F.lit(UNIT))
    total = F.aggregate("_all", F.lit(0.0), lambda z, x: z + x["_w"] * scale(x))
    first = F.transform(F.element_at("_all", 1)["_v"], lambda _: F.lit(0.0))
    vector = F.aggregate("_all", first, lambda acc, x: F.zip_with(acc, x["_v"], lambda a, v: a + v * x["_w"] * scale(x)))
    return states.select(key, F.when(F.col("_top").isNotNull(), F.transform(vector, lambda v: v / total)).alias("pooled"))


def attention_weights(pos_df: DataFrame, q: Sequence[float], key: str = "key", pos: str = "pos", vec: str = "vec",
                      mask: str | None = "mask", sigma: int = SMOOTH_SIGMA, eps: float = LN_EPS) -> DataFrame:
    """The attention of each position, ``(key, pos, attn)``.  Masked positions
    have 0; a key with every position masked has NULLs."""
    sm = _smoothed(pos_df, q, key, pos, vec, mask, sigma, eps).select(key, pos, "_ss")
    attention = group_softmax(sm, key, "_ss", None, out="attn").select(key, pos, "attn")
    if mask:
        some = pos_df.groupBy(key).agg(F.max(F.col(mask).cast("int")).alias("_some"))
        dead = join_back(pos_df.filter(~F.col(mask)).select(key, pos), some, key)
        attention = attention.unionByName(dead.select(key, pos, F.when(F.col("_some") == 1, F.lit(0.0)).alias("attn")))
    return attention


def attention_pool(pos_df: DataFrame, q: Sequence[float], key: str = "key", pos: str = "pos", vec: str = "vec",
                   mask: str | None = "mask", sigma: int = SMOOTH_SIGMA, eps: float = LN_EPS):
    """``(pooled, attention)``, see ``pooled_vectors`` and ``attention_weights``."""
    args = (pos_df, q, key, pos, vec, mask, sigma, eps)
    return pooled_vectors(*args), attention_weights(*args)


def attention_scores(df: DataFrame, q: Sequence[float], vec: str = "vec", eps: float = LN_EPS,
                     out: str = "score") -> DataFrame:
    """D3: ``dot(layer_norm(vec), q)`` per position."""
    return with_layer_norm(df, vec, "_ln", eps).withColumn(out, dot("_ln", q)).drop("_ln")
