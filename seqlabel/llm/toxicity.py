"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary documents, spell words byte by byte
from the ``ORDER - 1`` bytes before (spaces before the word, a space after it).
Only the highest order is counted per class; all lower orders are Kneser-Ney
continuation counts that both classes share:

    P(b | context) = max(c(context b) - D, 0) / c(context)
                     + D * followers(context) / c(context) * shared(b | shorter context)

So a rare expression gets nearly the same probability from both models, while
spellings that belong to one class, in whatever inflected form, do not.  A word's
evidence is its log-probability under the toxic model less that under the
ordinary one.  Evidence within ``margin`` nats of zero counts as none and no word
counts for more than ``cap``; otherwise the noise of hundreds of ordinary words
would drown a few decisive ones.  A document's evidence divided by its tokens is
the length-normalised comparison; a calibration over ``evidence / tokens`` and
``evidence / sqrt(tokens)`` turns it into a probability.  Margin and cap are
those of ``SHAPES`` whose calibration has the least cross-validated log loss on
the part of the training labels that is held back from the counts.

Bound (parameter): the models are fitted on at most ``sample`` labelled
documents per class, those with the least hash of their id, and hold every byte
n-gram of them; a quarter of the sample is held back from the counts to fit the
calibration.  All documents are scored whole.

Tokens are A-Z lower-cased words without ASCII punctuation at their ends, then
one end token without evidence.  Defined cases: null and empty texts have the
end token alone; repeated labels count once, with their largest value; null
labels are ignored; without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, append, bytes_of, fresh_name, id_remainder, parts, released, saved

THRESHOLD = 0.3
SAMPLE = 20_000
ORDER = 5
DISCOUNT = 0.75
#: Settings of (margin, cap) that every fit chooses from.
SHAPES = [(margin, cap) for margin in (0.0, 1.0, 2.0, 3.0, 4.0, 6.0) for cap in (4.0, 8.0, 16.0)]
FOLDS = 4
CHUNK = 4 << 20
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
END = b" "


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word numbers, text numbers, words); word 0 is the end of a text."""
    words, codes, sizes = {END: 0}, [], []
    raw: dict[bytes, int] = {}
    for text in texts:
        own = []
        for w in text.translate(LOWER).split():
            n = raw.get(w)
            if n is None:
                bare = w.strip(EDGES)
                n = raw[w] = words.setdefault(bare or w, len(words))
            own.append(n)
        own.append(0)
        codes.append(np.array(own, np.int64))
        sizes.append(len(own))
    return (np.concatenate(codes) if codes else np.zeros(0, np.int64), np.repeat(np.arange(len(sizes)), sizes), list(words))


def grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram as a number, word number) at every byte of the words and at the
    space after each; ``order`` is at most 8, so a number holds the whole n-gram."""
    pad = b" " * (order - 1)
    buffer = np.frombuffer(b"".join([pad + w + b" " for w in words]), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(word)) + word * (order - 1)
    key = np.zeros(len(at), np.uint64)
    for k in range(order):
        key = key << np.uint64(8) | buffer[at + k]
    return key, word


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by class, summed per chunk of texts."""
    released()
    for batch in parts(batches, "__text", CHUNK):
        toxic = np.array(batch.column(1).to_pylist(), np.int64)
        codes, docs, words = tokens(bytes_of(batch.column(0)))
        every = np.bincount(codes, minlength=len(words))
        hot = np.bincount(codes, toxic[docs], len(words)).astype(np.int64)
        every[0] = hot[0] = 0
        key, word = grams(words)
        found, place = np.unique(key, return_inverse=True)
        hot_n, n = (np.bincount(place, x[word], len(found)).astype(np.int64) for x in (hot, every))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(hot_n), pa.array(n - hot_n)], names=["key", "toxic", "ordinary"])


def low(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes."""
    return keys & np.uint64((1 << (8 * order)) - 1)


def shared_backoff(keys: np.ndarray, order: int) -> np.ndarray:
    """Kneser-Ney probability of each n-gram's last byte given all but its first,
    from the continuation counts of the distinct n-grams."""
    tables = []
    for n in range(order - 1, 0, -1):
        keys_n, count = np.unique(low(tables[-1][1] if tables else keys, n), return_counts=True)
        tables.append((n, keys_n, count))
    shorter, p = None, None
    for n, keys_n, count in reversed(tables):
        contexts, place = np.unique(keys_n >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(place, count)[place], np.bincount(place)[place]
        below = 1 / 256 if shorter is None else p[np.searchsorted(shorter, low(keys_n, n - 1))]
        shorter, p = keys_n, (count - DISCOUNT) / total + DISCOUNT * kinds / total * below
    return p[np.searchsorted(shorter, low(keys, order - 1))]


class Model:
    """Log ratios of the two classes' probabilities per seen n-gram and, for the
    others, per context; in a context that a class has not seen it backs off
    without loss, and the shared part cancels."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        self.keys, self.shape = keys, SHAPES[0]
        self.contexts, place = np.unique(keys >> np.uint64(8), return_inverse=True)
        below = shared_backoff(keys, ORDER)
        logs, backs = [], []
        for c in (toxic, ordinary):
            total, kinds = np.bincount(place, c), np.bincount(place, c > 0)
            back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            logs.append(np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(total[place], 1) + back[place] * below))
            backs.append(np.log(back))
        self.ratio, self.back = logs[0] - logs[1], backs[0] - backs[1]
        self.weights, self.losses = np.array([math.log(0.1), 30.0, 1.0]), []

    def word_evidence(self, words: list[bytes]) -> np.ndarray:
        key, word = grams(words)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out = np.where(self.keys[at] == key, self.ratio[at], 0)
        missed = np.flatnonzero(self.keys[at] != key)
        context = key[missed] >> np.uint64(8)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        out[missed] = np.where(self.contexts[at] == context, self.back[at], 0)
        return np.bincount(word, out, len(words))

    def evidence(self, texts: list[bytes], shapes: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, its evidence under each of the shapes)."""
        codes, docs, words = tokens(texts)
        by_word = self.word_evidence(words)
        by_word[0] = 0
        shaped = [np.sign(by_word) * np.clip(np.abs(by_word) - margin, 0, cap) for margin, cap in shapes]
        n = np.maximum(np.bincount(docs, minlength=len(texts)), 1)
        return n, np.stack([np.bincount(docs, x[codes], len(texts)) for x in shaped], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        n, evidence = self.evidence(texts, [self.shape])
        return logistic(features(n, evidence[:, 0]) @ self.weights)


def features(n: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    return np.stack((np.ones(len(n)), evidence / n, evidence / np.sqrt(n)), 1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps, halved until the loss falls; columns
    are brought to one scale first, so the penalty treats them alike."""
    scale = np.maximum(np.abs(x).max(0, initial=0), 1e-12)
    x, w = x / scale, np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * w @ w)

    for _ in range(100):
        p = logistic(x @ w)
        gradient = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        while loss(w + step) > loss(w) and np.abs(step).max() >= 1e-8:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        w = w + step
    return w / scale


def cross_validated(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """Mean log loss of each fold under the calibration of the others."""
    loss = np.zeros(len(y))
    for f in np.unique(fold):
        out = fold == f
        p = logistic(x[out] @ calibrated(x[~out], y[~out]))
        loss[out] = -np.log(np.where(y[out] == 1, p, 1 - p))
    return float(loss.mean())


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, held) of at most ``sample`` labelled documents per class:
    those with the least hash of their id, ranked in hash ranges first so that
    no task sorts a class."""
    train = labels.filter(id_remainder(4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic IN (0, 1)")
    rank = F.xxhash64(F.col("doc_id"), F.lit(17))
    cut = train.withColumn("h", rank).withColumn("range", F.pmod(F.col("h"), F.lit(64)))
    # a class's least hashes are among the least of every 64th part
    cut = cut.withColumn("r", F.row_number().over(Window.partitionBy("toxic", "range").orderBy("h", "doc_id"))).filter(F.col("r") <= sample)
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    whole = cut
    if sizes and max(sizes.values()) > sample:
        whole = cut.withColumn("q", F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id"))).filter(F.col("q") <= sample)
    chosen = whole.select(F.col("doc_id").alias("__id"), "toxic", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(4)) == 0).alias("held"),
                          F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(FOLDS)).alias("fold"))
    own = docs.select(F.col("doc_id"), F.col("text").alias("__text"))
    return saved(own.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("__text", "toxic", "held", "fold"), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The fitted model, or None without both classes."""
    rows = labelled(docs, labels, sample)
    counted = rows.filter("NOT held").select("__text", F.col("toxic").cast("long")).mapInArrow(_count, "key long, toxic long, ordinary long")
    sums = counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    # the sample bounds what reaches the driver
    top = sums.toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    toxic, ordinary = (top.column(c).to_numpy()[order].astype(float) for c in ("toxic", "ordinary"))
    if not toxic.sum() or not ordinary.sum():
        return None
    model = Model(keys[order], toxic, ordinary)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(texts: pa.Array) -> list[pa.Array]:
        n, evidence = shared.value.evidence(bytes_of(texts), SHAPES)
        return [pa.array(n.astype(float)), pa.array(list(evidence), pa.list_(pa.float64()))]

    held = append(rows.filter("held"), ["__text"], measure, [T.StructField("n", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.DoubleType()))])
    table = held.select("toxic", "fold", "n", "evidence").toArrow()  # some numbers for a quarter of the sample
    y, fold, n = (table.column(c).to_numpy().astype(float) for c in ("toxic", "fold", "n"))
    if 0 < y.sum() < len(y):
        x = [features(n, e) for e in np.array(table.column("evidence").to_pylist()).T]
        model.losses = [cross_validated(a, y, fold) for a in x]
        best = int(np.argmin(model.losses))
        model.shape, model.weights = SHAPES[best], calibrated(x[best], y)
    shared.destroy()
    return model


def with_score(docs: DataFrame, model: Model | None, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of being toxic."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        values, out = bytes_of(texts), [np.zeros(0)]
        for at in range(0, len(values), 1024):
            out.append(shared.value.scores(values[at : at + 1024]))
        return [pa.array(np.concatenate(out))]

    return append(docs, [text], run, [T.StructField(name, T.DoubleType())])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    own = docs.select("doc_id", "text")
    out = with_score(own, fit(own, labels, **options))
    return out.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents not predicted toxic, with their own columns."""
    name = fresh_name(docs, "__toxic")
    return with_score(docs, fit(docs, labels, **options), name).filter(F.col(name) < threshold).drop(name)
