import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF, awkward, clashing, frame

from seqlabel.llm import sharding as H
from seqlabel.llm.queries import QUERIES


QUERY_WEIGHTS = {s: 1.25 for s in range(41) if s // 5 % 2}
KEYS = H.mix(np.arange(6000, dtype=np.uint64))


def brute(key, shards, weights, capacity=H.CAPACITY, per_rack=5, per_region=2):
    """All draws of all nodes, then the least of all shards'."""
    key = np.array([key], np.uint64)
    draw = lambda kind, node, step=0: float(H.uniform(key, kind, np.array([node]), step)[0, 0])
    found = []
    for region in range(math.ceil(shards / per_rack / per_region)):
        top = -math.log(draw(H.REGION, region)) / (capacity * per_rack * per_region)
        racks = {k: -math.log(draw(H.RACK, k)) / (capacity * per_rack) for k in range(region * per_region, (region + 1) * per_region)}
        for k in racks:
            rack = top + racks[k] - min(racks.values())
            leaves = {s: -math.log(draw(H.SHARD, s)) / capacity for s in range(k * per_rack, (k + 1) * per_rack)}
            for s in leaves:
                weight = weights.get(s, 1.0)
                if s < shards and weight:
                    at, place, step = rack + leaves[s] - min(leaves.values()), capacity * draw(H.PLACE, s), 0
                    while place >= weight:
                        step += 1
                        at -= math.log(draw(H.AGAIN, s, step)) / place
                        place *= draw(H.PLACE, s, step)
                    found.append((at, s))
    return min(found)[1]


def check(rows, texts):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = {}
    for r in rows:
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        assert r["rack"] == r["shard"] // 5 and r["region"] == r["rack"] // 2 and r["law"] == "key"
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = QUERIES["op7_sharding"](spark, SF).collect()
    check(out, [tuple(r) for r in docs])
    keys = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "xxhash64(doc_id) AS key").collect()
    key = {r["doc_id"]: r["key"] & (1 << 64) - 1 for r in keys}
    for r in out:
        assert r["shard"] == brute(key[r["doc_id"]], 40, QUERY_WEIGHTS)
        assert r["grown_shard"] == brute(key[r["doc_id"]], 41, QUERY_WEIGHTS)


def test_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] is not None]
    check(H.sharded(clashing(frame(spark, rows))).collect(), [r[:2] for r in rows])
    nulls = H.sharded(frame(spark, awkward())).filter("doc_id IS NULL").collect()
    assert len(nulls) == 2 and len({r["shard"] for r in nulls}) == 1
    assert H.sharded(frame(spark, [])).collect() == []


def test_id_alone_decides(spark):
    a = {r["doc_id"]: r["shard"] for r in H.sharded(frame(spark, [(i, "a", None, None, 1) for i in range(50)])).collect()}
    b = {r["doc_id"]: r["shard"] for r in H.sharded(frame(spark, [(i, "other", "x", "y", 5) for i in range(25, 80)])).collect()}
    assert all(a[i] == b[i] for i in range(25, 50))


@pytest.mark.parametrize("shards, weights", [(1, {}), (4, {0: 0.0}), (13, {3: 2.0, 7: 0.25, 12: 0.1}), (44, {})])
def test_every_placement(shards, weights):
    got = H.HashTree(shards, weights).placed(KEYS[:400])
    assert got.tolist() == [brute(k, shards, weights) for k in KEYS[:400]]


@pytest.mark.parametrize("shards", [1, 4, 9, 10, 41, 44])
def test_one_more_takes_only_into_itself(shards):
    a, b = (H.HashTree(n, {2: 0.5, shards: 1.0}).placed(KEYS) for n in (shards, shards + 1))
    assert ((a == b) | (b == shards)).all()
    assert 0.6 * len(KEYS) / (shards + 1) < (a != b).sum() < 1.6 * len(KEYS) / (shards + 1)


def test_shares_follow_the_weights():
    weights = {s: (0.5, 1.0, 2.0)[s % 3] for s in range(23)}
    keys = H.mix(np.arange(200_000, dtype=np.uint64))
    share = Counter(H.HashTree(23, weights).placed(keys).tolist())
    total = sum(weights.values())
    for s, w in weights.items():
        want = w / total * len(keys)
        assert abs(share[s] - want) < 5 * math.sqrt(want)


def test_a_changed_weight_moves_rows_of_its_shard_only():
    base = {s: 1.0 for s in range(20)}
    a = H.HashTree(20, base).placed(KEYS)
    up, down, gone = (H.HashTree(20, {**base, 7: w}).placed(KEYS) for w in (2.0, 0.3, 0.0))
    assert (up != a).any() and ((up == a) | (up == 7)).all()
    assert (down != a).any() and ((down == a) | (a == 7)).all()
    assert ((gone == a) == (a != 7)).all() and not (gone == 7).any()
    rack = {s: 1.5 for s in range(5, 10)}
    grown = H.HashTree(20, {**base, **rack}).placed(KEYS)
    assert ((grown == a) | (grown // 5 == 1)).all()


def test_only_the_path_draws(monkeypatch):
    """A full tree of equal weights at capacity: regions, one region's racks and
    one rack's shards draw, and the shard's place."""
    drawn, own = [], H.uniform
    monkeypatch.setattr(H, "uniform", lambda key, kind, node, step=0: drawn.append(len(key) * len(node)) or own(key, kind, node, step))
    H.HashTree(40, capacity=1.0).placed(KEYS)
    assert sum(drawn) == len(KEYS) * (4 + 2 + 5 + 1)


def test_bad_weights():
    for shards, weights in ((3, {1: 2.5}), (3, {1: -1.0}), (0, {}), (1, {0: 0.0})):
        with pytest.raises(ValueError):
            H.HashTree(shards, weights)


def test_copies_of_a_row_spread(spark):
    rows = H.sharded(frame(spark, [(1, "same", None, None, 1)] * 500).repartition(4)).collect()
    assert sorted(r["slot"] for r in rows) == list(range(500)) and len({r["shard"] for r in rows}) == 1
