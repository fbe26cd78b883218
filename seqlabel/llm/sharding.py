"""Shards by a hierarchical weighted hash tree (region, rack, shard).

A document descends from the root.  Every region draws ``-ln(u) / capacity``,
``u`` being a hash of the document's id and the node, and the least draw is taken
first.  Below a node with draw ``t`` its children draw the same way, ``e`` each,
and stand at ``t + e - min(e)``: the least of them is the node's own draw, and the
others lie beyond it as they would if all had drawn by themselves (what an
exponential draw exceeds a bound by is an exponential draw again).  So only the
children of the nodes on the path draw.  A shard draws a place in its capacity,
too: below its weight the document stays there; otherwise the shard's next draw
is one over the part below that place, and so on.  Where a subtree has nothing
below the next best draw (places of shards not there yet, or over the weights),
the descent goes on in that next best subtree.

All draws depend on the id, the node and the capacities, never on which shards
are there or what they weigh.  A shard gets documents in proportion to its weight;
a raised weight or an added shard takes rows only into itself, a lowered weight
gives rows away from its shard only, and no other row moves.

Defined cases: null and empty texts have no bytes; a null id is a key like any
other; repeated rows share a shard and get slots of their own; empty tables give
no rows; a weight over the capacity, or a tree without weight, is an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, buckets, mix, saved

SHARDS = 40
SHARDS_PER_RACK = 5
RACKS_PER_REGION = 2
CAPACITY = 2.0
ROW_BYTES = 16
REGION, RACK, SHARD, PLACE, AGAIN = range(5)


def uniform(key: np.ndarray, kind: int, node: np.ndarray, step: int = 0) -> np.ndarray:
    """A number in (0, 1) for each key and node."""
    code = mix(np.uint64(kind << 56 | step << 32) | np.asarray(node, np.uint64))
    return ((mix(key[:, None] + code) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


class HashTree:
    """``shards`` shards, filled rack by rack.  ``weights`` by shard number (else
    1), each at most ``capacity``, which must stay as it is while weights change."""

    def __init__(self, shards: int, weights: dict[int, float] | None = None, capacity: float = CAPACITY,
                 per_rack: int = SHARDS_PER_RACK, per_region: int = RACKS_PER_REGION):
        self.weights = np.array([float((weights or {}).get(s, 1.0)) for s in range(shards)])
        if not shards or self.weights.min() < 0 or self.weights.max() > capacity or not self.weights.any():
            raise ValueError(f"weights must lie in 0 to {capacity}, one of them above 0")
        self.capacity, self.per_rack, self.per_region = capacity, per_rack, per_region

    def racks(self, region: int) -> np.ndarray:
        return np.arange(region * self.per_region, (region + 1) * self.per_region)

    def shards(self, rack: int) -> np.ndarray:
        return np.arange(rack * self.per_rack, (rack + 1) * self.per_rack)

    def placed(self, key: np.ndarray) -> np.ndarray:
        """The shard of each key (unsigned 64-bit hashes of the ids)."""
        regions = np.arange(-(-len(self.weights) // (self.per_rack * self.per_region)))
        at = -np.log(uniform(key, REGION, regions)) / (self.capacity * self.per_rack * self.per_region)
        return self._least(key, at, regions, self._in_region)[1]

    def _in_region(self, region: int, key: np.ndarray, at: np.ndarray):
        return self._least(key, self._beyond(key, at, RACK, self.racks(region)), self.racks(region), self._in_rack)

    def _in_rack(self, rack: int, key: np.ndarray, at: np.ndarray):
        if rack * self.per_rack >= len(self.weights):
            return np.full(len(key), np.inf), np.full(len(key), -1)
        return self._least(key, self._beyond(key, at, SHARD, self.shards(rack)), self.shards(rack), self._in_shard)

    def _in_shard(self, shard: int, key: np.ndarray, at: np.ndarray):
        weight = self.weights[shard] if shard < len(self.weights) else 0.0
        if not weight:
            return np.full(len(key), np.inf), np.full(len(key), -1)
        at, node, step = at.copy(), np.array([shard]), 0
        place = self.capacity * uniform(key, PLACE, node)[:, 0]
        while len(over := np.flatnonzero(place >= weight)):
            step += 1
            at[over] -= np.log(uniform(key[over], AGAIN, node, step)[:, 0]) / place[over]
            place[over] *= uniform(key[over], PLACE, node, step)[:, 0]
        return at, np.full(len(key), shard)

    def _beyond(self, key: np.ndarray, at: np.ndarray, kind: int, nodes: np.ndarray) -> np.ndarray:
        """The children's draws, the least of them being their parent's."""
        own = -np.log(uniform(key, kind, nodes)) / (self.capacity * (self.per_rack if kind == RACK else 1))
        return at[:, None] + (own - own.min(1, keepdims=True))

    @staticmethod
    def _least(key: np.ndarray, at: np.ndarray, nodes: np.ndarray, below: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Least draw and shard below some nodes with draws ``at``, best node first;
        a node is entered only by keys that have no lesser draw yet."""
        best, shard = np.full(len(key), np.inf), np.full(len(key), -1)
        order = np.argsort(at, axis=1, kind="stable")
        for turn in range(len(nodes)):
            child = order[:, turn]
            draw = at[np.arange(len(key)), child]
            live = draw < best
            for c in np.unique(child[live]).tolist():
                rows = np.flatnonzero(live & (child == c))
                found, place = below(int(nodes[c]), key[rows], draw[rows])
                better = found < best[rows]
                best[rows[better]], shard[rows[better]] = found[better], place[better]
        return best, shard


def numbered(rows: DataFrame, shard: str = "shard", row: str = "__row") -> DataFrame:
    """``rows`` (a written table with a number of its own for each row) with
    ``slot``, gapless from 0 in each shard.  Shards are cut into hash buckets of
    that number, so copies of a row spread as well; buckets are ranked apart and
    their counts give each one's first slot."""
    n = buckets(rows.sparkSession, 4)
    cut = rows.withColumn("__bucket", F.pmod(F.xxhash64(row), F.lit(n)))
    firsts = cut.groupBy(shard, "__bucket").agg(F.count("*").alias("__n")).withColumn(
        "__first", F.sum("__n").over(Window.partitionBy(shard).orderBy("__bucket")) - F.col("__n")).drop("__n")
    rank = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(row))
    return (cut.withColumn("__rank", rank).join(firsts, [shard, "__bucket"])
            .withColumn("slot", F.col("__first") + F.col("__rank") - 1).drop("__bucket", "__rank", "__first", row))


def sharded(docs: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None, capacity: float = CAPACITY,
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (``key``), region,
    rack, shard, slot and grown_shard, its shard with one shard more."""
    now, grown = HashTree(shards, weights, capacity), HashTree(shards + 1, weights, capacity)

    def place(keys: pa.Array) -> list[pa.Array]:
        key = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        own = now.placed(key)
        rack = own // now.per_rack
        return [pa.array(x.astype(np.int32)) for x in (rack // now.per_region, rack, own, grown.placed(key))]

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
                       F.xxhash64(F.col(doc_id)).alias("__key"), F.monotonically_increasing_id().alias("__row"))
    rows = append(rows, ["__key"], place, [T.StructField(c, T.IntegerType()) for c in ("region", "rack", "shard", "grown_shard")])
    return numbered(saved(rows.drop("__key"), "sharded")).select(
        "doc_id", "size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")
