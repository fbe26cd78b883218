import itertools
import zlib

import numpy as np
import pytest
from helpers import SF, awkward, clashing, frame

from seqlabel.llm import langid as I
from seqlabel.llm.queries import QUERIES


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    sizes = np.array([0, 5, 1, 6, 0, 3])
    score = rng.normal(0, 3, (sizes.sum(), 3))
    got, at = I.viterbi(score, sizes, 2.0), 0
    for n in sizes:
        value = lambda path, at=at, n=n: sum(score[at + t, x] for t, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        if n:
            best = max(map(value, itertools.product(range(3), repeat=int(n))))
            assert np.isclose(value(got[at : at + n].tolist()), best)
        at += n


def test_words_and_scripts():
    slot, script, first, text = I.words(["Ab c", "", "1 2", "дом α"])
    names = ["other", *[n for n, _ in I.SCRIPTS]]
    assert text.tolist() == [0, 0, 3, 3]
    assert [names[s] for s in script[first]] == ["latin", "latin", "cyrillic", "greek"]
    assert np.diff(np.append(first, len(slot))).tolist() == [2, 1, 3, 1]


def rows():
    en, ru, fr = "the cat sat on the mat and the dog ran", "кошка сидела на ковре и собака бежала", "le chat est sur le tapis et le chien court"
    return [(i, " ".join([(en, ru, fr)[i % 3]] * 5), ("en", "ru", "fr")[i % 3], "s", 1) for i in range(60)]


def test_spans_of_mixed_text(spark):
    model = I.fit(frame(spark, rows()))
    assert model.langs == ["en", "fr", "ru"]
    text, _, count, label = model.spans(["the cat sat on the mat and the dog ran кошка сидела на ковре le chat est sur le tapis et le chien court"])
    assert [model.langs[i] for i in label] == ["en"] * 10 + ["ru"] * 4 + ["fr"] * 10
    # a script that no language was learned in leaves all candidates
    assert model.predict(["γάτα", "", "123", "кошка"])[0][1:] == [I.UNKNOWN, I.UNKNOWN, "ru"]


def test_awkward_rows(spark):
    docs = clashing(frame(spark, rows() + [(1000 + i, *r[1:]) for i, r in enumerate(awkward())]))
    out = I.identified(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, r in enumerate(awkward()):
        g = got[1000 + i]
        assert g["held_out"] == (zlib.crc32(str(1000 + i).encode()) % 3 == 1)
        assert (g["lang_pred"] == "und") == (not any(map(str.isalpha, r[1] or "")))
        assert 0 <= g["score"] <= 1
    assert I.identified(frame(spark, [])).collect() == []
    nothing = I.identified(frame(spark, [(1, "text", None, None, 4)])).collect()
    assert nothing[0]["lang_pred"] == "und"
    nulls = I.identified(frame(spark, awkward())).filter("doc_id IS NULL").collect()
    assert len(nulls) == 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op8_langid"](spark, SF).filter("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95


def test_prediction_ignores_the_labels(spark):
    base = rows()
    model = I.fit(frame(spark, base))
    a = I.with_language(frame(spark, base), model).select("doc_id", "lang_pred").collect()
    b = I.with_language(frame(spark, [(r[0] , r[1], "xx", "other", 1) for r in base]), model).select("doc_id", "lang_pred").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_every_language_is_kept(spark):
    """More than 256 languages, each with words of its own."""
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(30)) for _ in range(300)]
    docs = frame(spark, [(i, t, f"l{i:03}", "s", 1) for i, t in enumerate(texts)])
    model = I.fit(docs)
    assert model.langs == [f"l{i:03}" for i in range(300)]
    assert all(r["lang"] == r["lang_pred"] for r in I.with_language(docs, model).collect())
