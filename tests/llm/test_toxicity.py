import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import awkward, clashing, frame

from seqlabel.llm import toxicity as X
from seqlabel.llm.queries import QUERIES


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    syllables = ["ba", "lo", "ni", "ter", "sun", "ma", "rik", "pel", "do", "ven"]
    bad = ["gruzz", "gruzzen", "snark", "snarky", "vilp"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(int(rng.integers(20, 80)))]
        toxic = int(i % 5 == 0)
        if toxic:
            for k in range(max(3, len(words) // 12)):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)) + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, toxic))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_grams_spell_words():
    key, word = X.grams([b"ab", b""], 3)
    assert [int(k).to_bytes(3, "big") for k in key] == [b"  a", b" ab", b"ab ", b"   "]
    assert word.tolist() == [0, 0, 0, 1]


def test_probabilities_add_up():
    """The shared backoff and both classes' models sum to one over the bytes."""
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 100, rng.integers(1, 8)).astype(np.uint8)) for _ in range(200)]
    key = np.unique(X.grams(words, X.ORDER)[0])
    context = X.low(key, X.ORDER) >> np.uint64(8)
    below = X.shared_backoff(key, X.ORDER)
    assert ((below > 0) & (below <= 1)).all()
    # all n-grams of one shorter context: their shared probabilities are at most one
    for c in np.unique(X.low(context, X.ORDER - 2)):
        at = X.low(context, X.ORDER - 2) == c
        _, first = np.unique(X.low(key[at], X.ORDER - 1), return_index=True)
        assert below[at][first].sum() <= 1 + 1e-9


def test_held_out_documents(spark):
    docs, labels = corpus()
    out = X.scored(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["held_out"]]
    assert len(held) > 100 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out)


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = (sorted(map(tuple, X.scored(frame(spark, docs), spark.createDataFrame(x, LABELS)).collect())) for x in (labels, flipped))
    assert a == b


def test_sample_bound(spark):
    docs, labels = corpus(300)
    rows = X.labelled(frame(spark, docs), spark.createDataFrame(labels, LABELS), 20)
    assert {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()} == {0: 20, 1: 20}


def test_awkward_rows(spark):
    docs, labels = corpus(300)
    every = clashing(frame(spark, docs + [(1000 + i, *r[1:]) for i, r in enumerate(awkward())] + [(None, None, None, None, None)]))
    odd = spark.createDataFrame([*labels, (5, None, None), (3, 0, 0), (99_999, 1, 1), (None, 1, 1), (1000, 1, 0)], LABELS)
    out = X.scored(every, odd).collect()
    assert len(out) == 300 + len(awkward()) + 1
    by = {r["doc_id"]: r for r in out}
    assert by[1000]["score"] == by[1001]["score"] and by[1000]["predicted"] == 0  # null and empty
    kept = X.filtered(every, odd)
    assert kept.columns == every.columns and kept.count() == sum(r["predicted"] == 0 for r in out)


def test_no_labels_or_documents(spark):
    docs, labels = corpus(20)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in X.scored(frame(spark, docs), none).collect()} == {0.0}
    assert X.scored(frame(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []


def test_query(spark):
    out = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000


def test_every_ngram_of_the_sample_is_kept(spark):
    """More n-grams than the 2**20 that a model once held."""
    rng = np.random.default_rng(4)
    texts = [" ".join(bytes(w).decode() for w in rng.integers(97, 123, (7000, 8)).astype(np.uint8)) for _ in range(40)]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], LABELS)
    used = [r[0].encode() for r in X.labelled(docs, labels, X.SAMPLE).filter("NOT held").collect()]
    want = np.unique(X.grams([X.END, *[w for t in used for w in t.split()]])[0])
    model = X.fit(docs, labels)
    assert len(want) > 1 << 20 and np.array_equal(model.keys, want)


def plain(docs, labels, used):
    """The whole query in plain Python: counts, shared Kneser-Ney backoff, both
    models, margin and cap by cross-validation, calibration, scores.  ``used``:
    (text, label, held, fold) of the labelled sample."""
    order, d = X.ORDER, X.DISCOUNT

    def spelled(text):
        bare = [w.strip(X.EDGES) or w for w in (text or "").encode().translate(X.LOWER).split()]
        return [[(b" " * (order - 1) + w + b" ")[i : i + order] for i in range(len(w) + 1)] for w in bare]

    counts = {0: Counter(), 1: Counter()}
    for text, label, held, _ in used:
        if not held:
            for word in spelled(text):
                counts[label].update(word)
    seen = set(counts[0]) | set(counts[1]) | {g[:order] for g in [b" " * order]}  # the end token's spelling
    levels, below = {}, seen
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[-n:] for g in below)
        below = set(levels[n])

    def shared(gram):
        if not gram:
            return 1 / 256
        table = tables[len(gram)][gram[:-1]]
        return (levels[len(gram)][gram] - d) / table[0] + d * table[1] / table[0] * shared(gram[1:])

    tables = {}
    for n, level in levels.items():
        tables[n] = defaultdict(lambda: [0, 0])
        for g, c in level.items():
            tables[n][g[:-1]][0] += c
            tables[n][g[:-1]][1] += 1
    total = {c: Counter() for c in counts}
    kinds = {c: Counter() for c in counts}
    for c, by in counts.items():
        for g, k in by.items():
            total[c][g[:-1]] += k
            kinds[c][g[:-1]] += 1
    contexts = {g[:-1] for g in seen}

    def ratio(gram):
        back = {c: d * kinds[c][gram[:-1]] / total[c][gram[:-1]] if total[c][gram[:-1]] else 1.0 for c in counts}
        if gram in seen:
            p = {c: max(counts[c][gram] - d, 0) / max(total[c][gram[:-1]], 1) + back[c] * shared(gram[1:]) for c in counts}
            return math.log(p[1]) - math.log(p[0])
        return math.log(back[1]) - math.log(back[0]) if gram[:-1] in contexts else 0.0

    known = {}

    def row(text, margin, cap):
        words, evidence = spelled(text), 0.0
        for w in words:
            key = tuple(w)
            if key not in known:
                known[key] = sum(map(ratio, w))
            evidence += math.copysign(min(max(abs(known[key]) - margin, 0), cap), known[key])
        n = len(words) + 1
        return [1.0, evidence / n, evidence / math.sqrt(n)]

    held = [(t, y, f) for t, y, h, f in used if h]
    y, fold = np.array([h[1] for h in held], float), np.array([h[2] for h in held])
    losses, tried = [], []
    for shape in X.SHAPES:
        x = np.array([row(t, *shape) for t, _, _ in held])
        loss = []
        for f in sorted(set(fold)):
            w = X.calibrated(x[fold != f], y[fold != f])
            p = 1 / (1 + np.exp(-np.clip(x[fold == f] @ w, -30, 30)))
            loss += (-np.log(np.where(y[fold == f] == 1, p, 1 - p))).tolist()
        losses.append(np.mean(loss))
        tried.append(x)
    best = int(np.argmin(losses))
    w = X.calibrated(tried[best], y)
    return {i: float(1 / (1 + math.exp(-min(max(np.dot(row(t, *X.SHAPES[best]), w), -30), 30)))) for i, t in docs}


def test_query_against_plain_python(spark):
    """Every score of the query, from the sample that the operator drew."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    used = [tuple(r) for r in X.labelled(docs, labels, X.SAMPLE).select("__text", "toxic", "held", "fold").collect()]
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["toxic"] in (0, 1)}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    # the sample is every training row, here
    assert Counter((t, y) for t, y, _, _ in used) == Counter((texts[i], y) for i, y in truth.items() if i in texts)
    want = plain(texts.items(), truth, used)
    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert abs(r["score"] - want[i]) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)


def test_shape_is_chosen_on_held_back_training_rows(spark):
    docs, labels = corpus()
    model = X.fit(frame(spark, docs), spark.createDataFrame(labels, LABELS))
    assert len(model.losses) == len(X.SHAPES) and model.shape == X.SHAPES[int(np.argmin(model.losses))]
