import hashlib
import os

import numpy as np
import pytest
from helpers import SF, awkward, clashing, frame

from seqlabel.llm import suffixdedup as D
from seqlabel.llm.queries import QUERIES
from seqlabel.llm.rlbwt import RunLengthIndex
from seqlabel.session import session_dir


def brute(rows):
    first, out = {}, []
    for i, t in rows:
        body = (t or "").encode()
        if i is not None:
            for p in range(len(body) - 49):
                s = body[p : p + 50]
                first[s] = min(i, first.get(s, i))
    for i, t in rows:
        body = (t or "").encode()
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - 49):
            if i is not None and first[body[p : p + 50]] < i:
                gone[p : p + 50] = True
        left = np.frombuffer(body, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(body), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def repetitive(seed):
    """Texts of few letters with shared, shifted and nested passages."""
    rng = np.random.default_rng(seed)
    text = lambda n, k=4: "".join(rng.choice(list("abéd"[:k]), n))
    passages = [text(n) for n in (49, 50, 51, 80, 120, 400)]
    rows = []
    for i in rng.permutation(60).tolist():
        parts = [text(int(rng.integers(0, 90))) for _ in range(3)]
        for p in rng.choice(6, 2):
            cut = int(rng.integers(0, 12))
            parts.insert(int(rng.integers(0, 4)), passages[p][cut:])
        rows.append((i, "".join(parts), "en", "s", 1))
    rows += [(100 + i, "ab" * 60 + text(30), "en", "s", 1) for i in range(8)] + [(200 + i, "z" * (40 + i), "en", "s", 1) for i in range(30)]
    return rows


@pytest.mark.parametrize("hot", [512, 1, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, hot):
    """With a small ``hot`` the anchors' slices are matched string by string."""
    rows = repetitive(seed)
    df = frame(spark, rows).repartition(5)
    assert result(D.deduplicated(df, hot=hot)) == brute([r[:2] for r in rows])


def test_index_streams_least_documents():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 99, rng.integers(6, 30)).astype(np.uint8)) for _ in range(80)]
    docs = rng.permutation(80)
    index = RunLengthIndex(texts, docs, 6)
    least = {}
    for t, d in zip(texts, docs):
        for p in range(len(t) - 5):
            least[t[p : p + 6]] = min(d, least.get(t[p : p + 6], d))
    got = dict(((int(t), int(p)), int(d)) for t, p, d in zip(*index.matching()))
    assert got == {(i, p): least[t[p : p + 6]] for i, t in enumerate(texts) for p in range(len(t) - 5)}
    assert len(index.start) < sum(len(t) - 5 for t in texts)


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(2)
    bodies = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (10, 49, 50, 1000, 333)]
    whole = {(i, lo + j) for i, lo, n in zip(*D.sliced(bodies)[:3]) for j in range(n)}
    monkeypatch.setattr(D, "CHUNK", 128)
    assert {(i, lo + j) for i, lo, n in zip(*D.sliced(bodies)[:3]) for j in range(n)} == whole
    assert whole == {(i, p) for i, b in enumerate(bodies) for p in range(len(b) - 49)}


def test_awkward_rows(spark):
    rows = awkward()
    df = frame(spark, rows)
    assert result(D.deduplicated(df, keep="bytes")) == brute([r[:2] for r in rows])
    assert D.deduplicated(frame(spark, [])).collect() == []


def test_cleaned_keeps_columns(spark):
    rows = awkward()
    df = clashing(frame(spark, rows))
    out = D.cleaned(df)
    assert out.columns == df.columns and out.count() == len(rows)
    want = {r[0]: r for r in brute([r[:2] for r in rows])}
    for r in out.collect():
        assert r["kept"] == "own kept"
        if r["doc_id"] is not None and r["text"] is not None and want[r["doc_id"]][2]:
            assert r["n_chars"] == len(r["text"])
        elif r["text"] is not None:
            assert r["text"] == next(x[1] for x in rows if x[0] == r["doc_id"] and (x[1] is None) == (r["text"] is None))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op6_suffix_dedup"](spark, SF)) == brute(rows)


def test_common_phrases_send_no_bytes(spark):
    """Texts that share phrases of under two thirds of ``SPAN`` bytes have nothing to match."""
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    phrases = [text(30) for _ in range(4)]
    rows = [(i, "".join(text(70) + p for p in rng.permutation(phrases)), "en", "s", 1) for i in range(40)]
    docs = frame(spark, rows).selectExpr("doc_id", "text AS __text")
    assert D.marks(docs).count() == 0
    assert result(D.deduplicated(frame(spark, rows))) == brute([r[:2] for r in rows])


def test_large_ids_and_pages(spark):
    """Pages keep whole ids, and a slice's bytes are deleted once they are matched."""
    rows = [(s * ((1 << 62) + 7 * i), t, *rest) for s in (1, -1) for i, t, *rest in repetitive(5)]
    assert result(D.deduplicated(frame(spark, rows))) == brute([r[:2] for r in rows])
    folder = session_dir(spark).removeprefix("file:")
    names = {x.split("-")[0] for x in os.listdir(folder)}
    assert "matches" in names and "bodies" not in names
