"""SimHash near-duplicates by ball hashing, meeting in the middle.

Fingerprints within ``radius`` bits share a variant when each emits all values
within half the radius of itself.  Over all 64 bits that is 1 + 64 + 2016 rows a
fingerprint for radius 4 (measured need: see the README), so the search first
applies the pigeonhole over three blocks: of the three pairs of blocks one
differs in at most ``2 * radius // 3`` bits (each differing bit lies in two of
the three pairs).  Within that pair, 42 or 43 bits wide, both fingerprints emit
the ball of half that smaller radius: 131 variants, and a shuffle on the
variants brings every pair within the radius together at least once.  Colliding
pairs are verified on all 64 bits.

A variant held by more than ``bucket`` distinct fingerprints is not compared
pair by pair: its fingerprints emit their whole-width balls of half the radius
instead, where sharing a variant already proves the distance, so a chain to
the least member links the group exactly with no pairs at all.  An odd radius
takes the larger half; a variant then links to its least member within the
smaller half, and without one it links nothing.  Copies never
reach the search: it runs on distinct fingerprints.

Defined cases: no words (null and empty texts) give fingerprint zero, linked like
any other; fewer words than a shingle give one shingle of all of them; repeated
documents share a component; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, append, bytes_of, fresh_name, released, saved
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET = 1024
BLOCKS = ((0, 21), (21, 42), (42, 64))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :]
    return np.fromiter([h(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist())], np.uint64, n)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Each bit is 1 if set in over half the hashes (unsigned)."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with its texts' fingerprints as a (signed) long."""
    def run(texts: pa.Array) -> list[pa.Array]:
        bits = np.fromiter((fingerprint(t, shingle) for t in bytes_of(texts)), np.uint64, len(texts))
        return [pa.array(bits.view(np.int64))]

    return append(docs, [text], run, [T.StructField(name, T.LongType())])


def ball(mask: int, radius: int) -> list[int]:
    """All differences of at most ``radius`` bits within ``mask``."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(c) for r in range(radius + 1) for c in combinations(bits, r)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_variants(fps: DataFrame, radius: int) -> DataFrame:
    """(key, fp): the balls of half the pair's radius, tagged by the pair in the
    bits that the pair leaves free."""
    half = -(-(2 * radius // 3) // 2)
    parts = [sum(1 << i for i in range(a, b)) for a, b in BLOCKS]
    out = []
    for tag, (a, b) in enumerate(combinations(parts, 2)):
        free = next(p for p in parts if p not in (a, b))
        mark = (free & -free) * tag
        out += [(signed(a | b), signed(x | mark)) for x in ball(a | b, half)]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(x)) for m, x in out])
    return fps.select(F.explode(keys).alias("key"), "fp")


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of one bucket's fingerprints."""
    n, rest, us, vs = len(fp), np.arange(len(fp)), [], []
    while len(rest) > 1:
        seen, frontier = rest[:1], rest[:1]
        rest = rest[1:]
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(frontier), 256):
                near |= (np.bitwise_count(fp[frontier[at : at + 256], None] ^ fp[None, rest]) <= radius).any(0)
            frontier, rest = rest[near], rest[~near]
            seen = np.concatenate((seen, frontier))
        us.append(np.repeat(seen[:1], len(seen) - 1))
        vs.append(seen[1:])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if n > 1 else (empty, empty)


def _links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole runs of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    two = starts[sizes == 2]
    near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
    us, vs = [fps[two][near]], [fps[two + 1][near]]
    for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        run = np.unique(fps[at : at + n])
        u, v = _forest(run, radius)
        us.append(run[u])
        vs.append(run[v])
    return np.concatenate(us), np.concatenate(vs)


SEARCH = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("hot", pa.bool_())])


def _search(radius: int, bucket: int):
    """Links of the sorted (key, fp) rows of a partition.  A run is held only up
    to ``bucket`` rows; the fingerprints of a longer one are passed on as hot."""

    def out(u: np.ndarray, v: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(u), hot))], schema=SEARCH)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        passing = None  # the key of a long run that is being passed on
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if passing is not None:
                n = int(np.searchsorted(k != passing, True))
                yield out(f[:n], f[:n], True)
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                passing = None
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            long = np.repeat(sizes > bucket, sizes)
            if long.any():
                yield out(fps[long], fps[long], True)
                if long[-1]:
                    passing = keys[-1]
            last = len(keys) if long[-1] else int(starts[-1])
            whole = ~long[:last]
            yield out(*_links(keys[:last][whole], fps[:last][whole], radius), False)
            keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield out(*_links(keys, fps, radius), False)

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v) over distinct fingerprints: enough pairs within ``radius`` bits to
    connect whatever such pairs connect."""
    found = (block_variants(fps, radius).repartition("key").sortWithinPartitions("key")
             .mapInArrow(_search(radius, bucket), "u long, v long, hot boolean"))
    found = saved(found.distinct(), "simhash-links")
    hot = found.filter("hot").select(F.col("u").alias("fp"))
    # the whole-width ball as balls of one bit each, so that the plan stays small
    balls = hot.select("fp", F.col("fp").alias("key"))
    for _ in range(-(-radius // 2)):
        balls = balls.select("fp", F.explode(F.array(*[
            F.col("key").bitwiseXOR(F.lit(signed(x))) for x in ball((1 << 64) - 1, 1)])).alias("key"))
    balls = balls.distinct()
    if not found.filter("hot").isEmpty():
        least = saved(balls, "simhash-balls")
        near = F.col("fp") if radius % 2 == 0 else F.when(F.bit_count(F.col("key").bitwiseXOR(F.col("fp"))) <= radius // 2, F.col("fp"))
        chain = least.join(least.groupBy("key").agg(F.min(near).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "key")
        found = found.filter("NOT hot").select("u", "v").unionByName(
            chain.filter("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")))
        return found.distinct()
    return found.filter("NOT hot").select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reachable over links (itself included)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    prints = saved(fingerprints(own, shingle, "__text").drop("__text"), "simhash")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius, bucket))
    rooted = saved(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    first = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-first")
    names = saved(rooted.join(first, "root").select("fp", "component_id"), "simhash-names")
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id") -> DataFrame:
    """The documents whose doc_id is the smallest of their component, with their
    own columns.  Rows of one doc_id are one document and stay or go together;
    rows without a doc_id stay."""
    first = near_duplicates(docs, shingle, radius, doc_id=doc_id).filter("component_id = doc_id").select(
        F.col("component_id").alias(keep := fresh_name(docs, "__first"))).distinct()
    out = docs.join(first, F.col(doc_id) == F.col(keep), "left").filter(F.col(keep).isNotNull() | F.col(doc_id).isNull()).drop(keep)
    return out.select(*docs.columns)
