import hashlib

import numpy as np
import pytest
from helpers import SF, awkward, clashing, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlabel.llm import winnowing as W
from seqlabel.llm.queries import QUERIES


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 9))
def test_least_of_every_window_rightmost(values, window):
    hashes = np.array(values, np.uint64) << np.uint64(32)
    w = min(window, len(values))
    want = set()
    for a in range(len(values) - w + 1):
        part = values[a : a + w]
        want.add(a + max(i for i, x in enumerate(part) if x == min(part)))
    assert W.kept(hashes, window).tolist() == sorted(want)


@settings(max_examples=50, deadline=None)
@given(st.text("ab ", min_size=47, max_size=47), st.text("ab", max_size=30), st.text("ab", max_size=30))
def test_match_guarantee(passage, before, after):
    a, b = W.winnowed(before + passage), W.winnowed(passage + after)
    common = set(a[0].tolist()) & set(b[0].tolist())
    assert common
    shift = len(before)
    assert {(h, p - shift) for h, p in zip(*map(np.ndarray.tolist, a))} & set(zip(*map(np.ndarray.tolist, b)))


def test_long_text_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 20, 5000).astype(np.uint64) << np.uint64(32)
    whole = W.kept(hashes, 32).tolist()
    monkeypatch.setattr(W, "STEP", 77)
    assert W.kept(hashes, 32).tolist() == whole


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, r in enumerate(rows):
        text, following = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        prints = [W.winnowed(t) for t in (text, new, following)]
        out.append((r[0], len(text), hashlib.sha256(new.encode()).hexdigest(), W.written(prints[0]), W.written(prints[1]),
                    W.likeness(prints[0], prints[1]), W.likeness(prints[0], prints[2])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_awkward_rows(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = W.compared(clashing(frame(spark, awkward()))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, got), key=repr) == brute(awkward())


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op1_winnowing"](spark, SF)
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert W.compared(frame(spark, [])).collect() == []
