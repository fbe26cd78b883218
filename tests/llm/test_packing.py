import zlib

import numpy as np
import pytest
from helpers import SF, awkward, clashing, frame
from tokenizers import Tokenizer

from seqlabel.llm import packing as P
from seqlabel.llm.common import tokenizer_path
from seqlabel.llm.queries import QUERIES


def check(rows, texts):
    """Every id in exactly one piece, sequences gapless, little padding."""
    tok = Tokenizer.from_file(tokenizer_path(P.FILE))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc])
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[doc][p["start"] : at], "<u4").tobytes())
        assert at == len(ids[doc])
    padded = used = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        padded += at if at & (at - 1) == 0 else 4096
        used += at
    assert padded - used < 4096 + 0.01 * used
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("n", [1, 2, 63, 100, 819, 1500, 4095, 4096, 4097, 100_000])
def test_cuts(n):
    cuts = P.cuts(n)
    assert sum(cuts) == n
    assert all(4096 // (4096 // c) == c for c in cuts)


def test_first_fit_keeps_within_capacity():
    sizes = sorted(np.random.default_rng(0).integers(1, 60, 500).tolist(), reverse=True)
    used = {}
    for n, (b, at) in zip(sizes, P.first_fit(sizes, 100)):
        assert at == used.get(b, 0)
        used[b] = at + n
    assert max(used.values()) <= 100 and len(used) <= sum(sizes) / 100 + 2


def test_awkward_rows(spark):
    rows = {r[0]: r for r in awkward() if r[0] is not None}.values()
    out = P.packed(clashing(frame(spark, list(rows)).repartition(3)))
    check(out.collect(), [r[:2] for r in rows])
    assert P.packed(frame(spark, [])).collect() == []


def test_repeated_rows_are_packed_each(spark):
    out = P.packed(frame(spark, [r for r in awkward() if r[0] == 16]))
    assert out.filter("start = 0").count() == 2


def test_query_packs_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(QUERIES["op3_packing"](spark, SF).collect(), [tuple(r) for r in docs])


def test_latin_texts_are_cut_at_once():
    path = tokenizer_path(P.FILE)
    library = Tokenizer.from_file(path)
    every = [chr(c) for c in range(0x2100) if chr(c).isprintable() or chr(c) in "\t\n\r"]
    ids = P.Ids(path)
    latin = [c for c in every if not ids.strange(c)]
    assert len(latin) > 220
    texts = ["", " ", "Don't 'tis ''s we'LL I'd've 'Re o'clock 'x", "a1b22c 3.14 e9", "x...y ?!\n\tz\r\n--", "Ÿ×÷ÆØß ﬁ"[:-2], "l’été «ÇA» ¿qué? ¡sí! 20 € – Łódź…"]
    texts += [f"{c}" for c in latin] + [f"a{c}B{c}{c} 7{c}'s" for c in latin]
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.known.young and not ids.cache.young  # no part was learnt by itself
    # the others go by parts, in the same batch
    texts = ["Word", "İstanbul word", "<|endoftext|> a", "ΟΔΟΣ οδός", "été", "a\x1cb\x85c d", "²½ x٣y", "word"]
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.cache.young
