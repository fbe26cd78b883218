"""Document fingerprints by winnowing.

All ``k``-grams of a text's code points get a rolling hash; from every window of
``window`` consecutive hashes the least is kept, the rightmost of equals, with
its position.  Any ``k + window - 1`` code points that two texts share therefore
leave a common entry in both fingerprints, at positions that differ by the
passage's shift; nothing shorter than ``k`` ever matches.  A text with fewer
hashes than a window has one window of all of them, a text shorter than ``k``
one hash of all of it, an empty text no entry.

A fingerprint is written as 16 hex digits per entry in text order: the 32-bit
hash, then the 32-bit position.  Likeness is the Dice coefficient of the two sets
of hashes: twice those in common by the sum of both sizes; 1 if both are empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M64, buckets, mix, parts

K = 16
WINDOW = 32
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 2 << 20
STEP = 1 << 20


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for texts of usual length."""
    table = _POWERS.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 17), base & M64, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if n <= 1 << 21:
            _POWERS[base] = table
    return table[:n]


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram (at least one: the whole if it is shorter).  A prefix
    sum weighted with inverse powers gives every gram's polynomial at once."""
    k = min(k, len(codes))
    n = len(codes) - k + 1
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, len(codes)), out=prefix[1:], dtype=np.uint64)
    return mix((prefix[k:] - prefix[:n]) * powers(BASE, n) + np.uint64(k))


def kept(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that are some window's least hash, rightmost of equals.
    Windows slide over the row by doubling spans of minima."""
    n, out, w = len(hashes), [], min(window, len(hashes))
    for at in range(0, n - w + 1, STEP):
        part = hashes[at : at + STEP + w - 1] >> np.uint64(32) << np.uint64(32)
        # the low half makes a later place of the same hash the lesser
        keys = part | np.arange(len(part) - 1, -1, -1, dtype=np.uint64)
        span = 1
        while 2 * span <= w:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < w:
            keys = np.minimum(keys[: len(keys) - (w - span)], keys[w - span :])
        changes = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        out.append(at + len(part) - 1 - (changes & np.uint64(0xFFFFFFFF)).astype(np.int64))
    out = np.concatenate(out)
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def winnowed(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes, positions) of a text's fingerprint."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes = rolling(codes, k)
    at = kept(hashes, window)
    return (hashes[at] >> np.uint64(32)).astype(np.uint32), at


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    return np.stack((print_[0], print_[1].astype(np.uint32)), 1).astype(">u4").tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    x, y = np.unique(a[0]), np.unique(b[0])
    if not len(x) + len(y):
        return 1.0
    return 2.0 * len(np.intersect1d(x, y, assume_unique=True)) / (len(x) + len(y))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


PRINTS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _consecutive(k: int, window: int):
    """Rows of (part, guest, doc_id, text) sorted by part and id: each row but a
    guest is compared with the next of its part; a part's guest, its last row, is
    the first row of the next part that has any."""

    def row(doc, text, own, following, other):
        new = edited(text, following)
        print_ = winnowed(new, k, window)
        return (doc, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), written(own), written(print_),
                likeness(own, print_), likeness(own, other))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: part, id, text, fingerprint
        for batch in parts(batches, "__text", CHUNK):
            rows = []
            for part, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                print_ = winnowed(text, k, window)
                if held and held[0] == part:
                    rows.append(row(*held[1:], text, print_))
                held = None if guest else (part, doc, text, print_)
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=PRINTS.replace(",", "").split()[::2])

    return run


def compared(docs: DataFrame, k: int = K, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and its
    likeness to that and to the next document by id (the first after the last).

    Ids are cut into ranges by quantiles; each range goes to one task, sorted,
    with the first row of the next range as a guest, so the texts are shuffled
    once and no task holds more than two texts.  Rows with one id follow each
    other by text; null ids come first.  A single row is its own next.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    n = buckets(spark)
    # as many boundaries as partitions; their places need not be exact
    own = own.withColumn("__place", F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf)))
    bounds = own.filter("doc_id IS NOT NULL").approxQuantile("__place", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    # Bucketizer searches the boundaries in the JVM, whatever their number
    cut = Bucketizer(splits=[-math.inf, *sorted(set(bounds or [0.0])), math.inf], inputCol="__place", outputCol="__part")
    dealt = cut.transform(own).withColumn("part", F.col("__part").cast("int")).drop("__part", "__place")
    # one row per range: its least id, and the range whose guest that row is
    key = F.struct(F.col("doc_id"), F.coalesce("__text", F.lit("")).alias("t"))
    ranges = dealt.groupBy("part").agg(F.min(F.struct("doc_id")).alias("least"))
    at = [(r["part"], r["least"]["doc_id"]) for r in ranges.orderBy("part").collect()]
    if not at:
        return spark.createDataFrame([], PRINTS)
    before = {b[0]: a[0] for a, b in zip([at[-1], *at[:-1]], at)}
    links = spark.createDataFrame([(p, first, before[p]) for p, first in at], "of int, least long, host int")
    firsts = dealt.join(F.broadcast(links), F.expr("part = of AND doc_id <=> least")).groupBy("host").agg(
        F.min(key).alias("row"))
    guests = firsts.select(F.col("host").alias("part"), F.lit(True).alias("guest"), "row.doc_id", F.col("row.t").alias("__text"))
    every = dealt.select("part", F.lit(False).alias("guest"), "doc_id", F.coalesce("__text", F.lit("")).alias("__text")).unionByName(guests)
    return (every.repartition(n, "part").sortWithinPartitions("part", "guest", F.asc_nulls_first("doc_id"), "__text")
            .mapInArrow(_consecutive(k, window), PRINTS))
