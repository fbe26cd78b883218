"""Quality rules with risk-controlled cutoffs.

Every rule is an integer statistic of a document and a cutoff; a document at or
above the cutoff is rejected.  Cutoffs are not set by hand.  For each stratum
(``lang``) and rule a fixed grid is walked from lenient to strict over the
labelled holdout.  With ``n`` good documents of which ``x`` would be rejected, a
cutoff is certified while the exact binomial test holds:
``P(Bin(n, alpha_rule) <= x) <= delta / (strata * rules)``, which is the same as
the Clopper-Pearson upper bound being at most ``alpha_rule``.  Walking a fixed
sequence and stopping at the first failure needs no correction along the grid;
Bonferroni covers strata and rules.  So with probability ``1 - delta`` no
stratum loses more than ``alpha`` of its good documents to the rules.  Among
certified cutoffs the one with the largest (low-quality caught - good lost) is
taken, the most lenient on ties; a rule that gains nothing, or a stratum with
too few labels to certify anything, rejects nothing.

Defined cases: null or empty text has no words and fails the base rule; a null
stratum is a stratum of its own; strata beyond the ``max_strata`` with most
labels are pooled; labels that repeat an id count once with their least quality,
null labels and labels without a document are ignored; empty tables give no
cutoffs; repeated documents are judged row by row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, bytes_of, fresh_name, saved

MIN_WORDS = 50
ALPHA = 0.05
DELTA = 0.05
CUT = "__cut_"
#: Strata with cutoffs up to which their table (some 100 bytes a row) is broadcast.
BROADCAST_STRATA = 200_000
SALTS = 32
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Rule -> (value as SQL over the statistics, cutoffs from lenient to strict).
#: Per mille, but word lengths in hundredths; only integers, so engines agree.
RULES = {
    "symbols": ("1000 * n_symbols DIV greatest(n_words, 1)", list(range(2000, 0, -50))),
    "dup_lines": ("1000 * n_dup_lines DIV greatest(n_lines, 1)", list(range(1000, 0, -50))),
    "repeats": ("1000 * n_repeat_words DIV greatest(n_words, 1)", list(range(1000, 0, -50))),
    "long_words": ("100 * word_chars DIV greatest(n_words, 1)", list(range(3000, 300, -50))),
    "short_words": ("1000 - 100 * word_chars DIV greatest(n_words, 1)", list(range(900, 400, -20))),
}


def repeat_words(codes: np.ndarray) -> int:
    """Words covered by a 3-word window that the text has twice or more."""
    n = len(codes) - 2
    if n < 2:
        return 0
    if int(codes.max()) < 1 << 21:
        keys = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    else:
        pair = np.unique(codes[:-1] * (int(codes.max()) + 1) + codes[1:], return_inverse=True)[1]
        keys = pair[:-1] * (int(codes.max()) + 1) + codes[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= twice
    return int(covered.sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The values of ``STATS`` for one whole text."""
    words = text.split()
    seen: dict[bytes, int] = {}
    add = seen.setdefault
    codes = np.fromiter([add(w, len(seen)) for w in words], np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    tight = text.translate(None, SPACES)
    chars = len(tight) if tight.isascii() else len(tight.decode("utf-8", "replace"))
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeat_words(codes), len(lines))


def _measure(texts: pa.Array) -> list[pa.Array]:
    rows = [statistics(t) for t in bytes_of(texts)]
    return [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[] for _ in STATS])]


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the statistics of its texts, from one Arrow pass."""
    return append(docs, [text], _measure, [T.StructField(prefix + s, T.LongType()) for s in STATS])


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= x) for ``x`` below the mean: summed from the largest term
    down, as long as terms count, which are some multiple of sqrt(n)."""
    term = math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p))
    terms = []
    for i in range(x, -1, -1):
        terms.append(term)
        if term <= 1e-18 * terms[0]:
            break
        term *= i / (n - i + 1) * (1 - p) / p
    return math.fsum(terms)


def certified(n: int, lost: list[int], alpha: float, level: float) -> int:
    """How many cutoffs, from the lenient end, pass the exact test."""
    for k, x in enumerate(lost):
        if n == 0 or x >= n * alpha or binomial_tail(x, n, alpha) > level:
            return k
    return len(lost)


def fit(stats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: s (the stratum) and a column of each rule's cutoff, null
    without one; strata without any cutoff have no row.

    One aggregation counts good and low-quality documents per (stratum, rule,
    number of cutoffs that reject them); each stratum is tested in a task, over
    at most rules x (grid + 1) rows, and only the number of strata, which the
    correction needs, reaches the driver.
    """
    held = labels.groupBy("doc_id").agg(F.min("quality").alias("__quality")).filter(F.col("__quality").isNotNull())
    marks = F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(f"size(filter(array({','.join(map(str, cuts))}), c -> {value} >= c))").alias("reach"))
                      for r, (value, cuts) in RULES.items()])
    rows = (stats.filter(~base_failed()).join(held, "doc_id")
            .select(F.col(stratum).alias("s"), "__quality", F.explode(marks).alias("m")))
    counts = rows.groupBy("s", "m.rule", "m.reach").agg(
        F.count_if(F.col("__quality") == 1).alias("good"), F.count_if(F.col("__quality") == 0).alias("bad"))
    counts = saved(counts, "quality-counts")
    level = delta / max(1, counts.select("s").distinct().count() * len(RULES))
    kind = stats.schema[stratum].dataType
    schema = T.StructType([T.StructField("s", kind), *[T.StructField(CUT + r, T.LongType()) for r in RULES]])

    def tested(group: pa.Table) -> pa.Table:
        cut: dict[str, int | None] = dict.fromkeys(RULES)
        rule, reach = group.column("rule").to_pylist(), group.column("reach").to_numpy()
        for r, (_, cuts) in RULES.items():
            own = np.flatnonzero([x == r for x in rule])
            # a document reaches the strictest cutoffs first
            good, bad = (np.bincount(reach[own], group.column(c).to_numpy()[own], len(cuts) + 1).astype(np.int64)[::-1] for c in ("good", "bad"))
            lost, caught = np.cumsum(good)[:-1], np.cumsum(bad)[:-1]
            k = certified(int(good.sum()), lost.tolist(), alpha / len(RULES), level)
            gain = (caught - lost)[:k]
            if k and gain.max() > 0:
                cut[r] = cuts[int(gain.argmax())]
        some = any(c is not None for c in cut.values())
        return pa.table([group.column("s").slice(0, int(some)), *[pa.array([c][: int(some)], pa.int64()) for c in cut.values()]], names=schema.names)

    return saved(counts.groupBy("s").applyInArrow(tested, schema), "quality-cutoffs")


def with_cutoffs(rows: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``rows`` with their stratum's cutoffs.  Up to ``BROADCAST_STRATA`` strata
    they are broadcast; beyond, a stratum's rows are dealt over salted parts."""
    if cutoffs.count() <= BROADCAST_STRATA:
        return rows.join(F.broadcast(cutoffs), F.col(stratum).eqNullSafe(F.col("s")), "left").drop("s")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns[:1], F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    same = F.col(stratum).eqNullSafe(F.col("s")) & (F.col("__salt") == F.col("__part"))
    return dealt.join(cutoffs.withColumn("__part", salt), same, "left").drop("s", "__salt", "__part")


def rejected() -> Column:
    """Whether a cutoff of its stratum rejects the row."""
    verdict = F.lit(False)
    for rule, (value, _) in RULES.items():
        verdict = verdict | F.coalesce(F.expr(f"{value} >= {CUT}{rule}"), F.lit(False))
    return verdict


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed and kept."""
    stats = saved(measured(docs.select("doc_id", F.col(stratum).alias("__stratum"), F.col(text).alias("__text")), "__text")
                  .drop("__text"), "quality-stats")
    out = with_cutoffs(stats, fit(stats, labels, "__stratum", **options), "__stratum")
    return out.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~rejected()).drop("__stratum", *[CUT + r for r in RULES])


def filtered(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """The documents that neither the base rule nor a certified cutoff rejects,
    with their own columns.  The texts are measured twice rather than shuffled."""
    small = docs.select("doc_id", F.col(stratum).alias("__stratum"), F.col("text").alias("__text"))
    cutoffs = fit(saved(measured(small, "__text").drop("__text"), "quality-stats"), labels, "__stratum", **options)
    renamed = {c: fresh_name(docs, "__own_" + c) for c in docs.columns if c.lower() in {"s", *STATS, "base_failed", *[CUT + r for r in RULES]}}
    out = measured(docs.withColumnsRenamed(renamed).withColumn("__stratum", F.col(renamed.get(stratum, stratum))))
    out = with_cutoffs(out.filter(~base_failed()), cutoffs, "__stratum").filter(~rejected()).drop("__stratum", *STATS, *[CUT + r for r in RULES])
    return out.withColumnsRenamed({v: k for k, v in renamed.items()}).select(*docs.columns)
