import math
import zlib
from collections import Counter

import numpy as np
from helpers import SF, awkward, clashing, frame

from seqlabel.llm import lm as L
from seqlabel.llm.queries import QUERIES


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows, least=L.LEAST):
    words = [(t or "").encode().translate(L.LOWER).split() + [b" "] for _, t in rows]
    uni, bi = Counter(), Counter()
    for (i, _), w in zip(rows, words):
        if not held(i):
            uni.update(w)
            bi.update(zip([b" ", *w], w))
    n, v = sum(uni.values()), len(uni)
    out = []
    for (i, _), w in zip(rows, words):
        base = [(uni[x] + 1) / (n + v + 1) for x in w]
        score = 0.0
        for before, x, p in zip([b" ", *w], w, base):
            c, seen = bi[before, x], uni[before]
            c = least << (c // least).bit_length() - 1 if c >= least else 0
            score += math.log10(L.LAMBDA * min(c, seen) / seen + (1 - L.LAMBDA) * p if seen >= least else p)
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(map(math.log10, base)), score))
    return out


def agree(got, want):
    key = lambda r: repr((r[0], r[2], round(r[5], 6)))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-9, atol=1e-9)


def test_filter_holds_rounded_counts():
    rng = np.random.default_rng(0)
    keys = L.mix(np.arange(60_000, dtype=np.uint64))
    counts = (rng.pareto(1.0, 60_000) * 2 + 1).astype(np.int64)
    bits = np.zeros((256 << L.PAGE_LOG) // 8, np.uint8)
    for page, body in L.LogFrequencyFilter.page_bytes(keys[:40_000], counts[:40_000], 256, 2).items():
        bits[page * 32 : page * 32 + 32] = np.frombuffer(body, np.uint8)
    got = L.LogFrequencyFilter(bits, 256, 2).counts(keys)
    true = np.where(counts >= 2, 2 << np.maximum(np.log2(counts // 2 + (counts < 2)).astype(int), 0), 0)
    true[40_000:] = 0
    assert (got >= true).all()  # one-sided
    assert (got == true).mean() > 0.97


def test_query(spark, monkeypatch):
    monkeypatch.setattr(L, "BITS_EACH", 400)  # no false positives at this load
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    agree(QUERIES["op5_lm"](spark, SF).collect(), brute(rows))


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "BITS_EACH", 400)
    got = L.scored(clashing(frame(spark, awkward()).repartition(3))).collect()
    agree(got, brute([r[:2] for r in awkward()]))
    assert L.scored(frame(spark, [])).collect() == []
    none = [r for r in awkward() if held(r[0])]
    agree(L.scored(frame(spark, none)).collect(), brute([r[:2] for r in none])) if none else None


def test_more_buckets_than_pages(spark, monkeypatch):
    """Every bucket has a page of its own, however many there are."""
    monkeypatch.setattr(L, "BITS_EACH", 400)
    monkeypatch.setattr(L, "PAGE_LOG", 2)
    agree(L.scored(frame(spark, awkward())).collect(), brute([r[:2] for r in awkward()]))


def test_held_out_beats_the_unigram(spark):
    rows = [r for r in QUERIES["op5_lm"](spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_no_size_bound(spark, monkeypatch):
    """More entries than the 2**28 bits that once bounded every model could hold."""
    monkeypatch.setattr(L, "BITS_EACH", 1 << 17)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    pairs = Counter()
    for i, t in rows:
        if not held(i):
            w = (t or "").encode().translate(L.LOWER).split() + [b" "]
            pairs.update(zip([b" ", *w], w))
    assert sum((c // L.LEAST).bit_length() for c in pairs.values()) * L.BITS_EACH > 1 << 28
    agree(L.scored(docs).collect(), brute(rows, L.LEAST))


def test_bigrams_and_contexts_seen_once_count(spark, monkeypatch):
    monkeypatch.setattr(L, "BITS_EACH", 400)
    train = [i for i in range(20) if not held(i)][:2]
    out = next(i for i in range(20) if held(i))
    rows = [(train[0], "red fox runs home"), (train[1], "blue fox sleeps"), (out, "red fox sleeps")]
    got = L.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    agree(got, brute(rows, 1))
    # each of its bigrams occurs once in training, "red fox" after a context seen once
    row = next(r for r in got if r["held_out"])
    assert row["score"] > row["base_score"]
