import hashlib

import pytest
from helpers import SF, awkward, clashing, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqlabel.llm import bpe as B
from seqlabel.llm.common import tokenizer_path
from seqlabel.llm.queries import QUERIES

PATH = tokenizer_path(B.FILE)
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def same(library, texts):
    codec = B.codec(PATH)
    ids = codec.encode_batch(texts)
    for text, own, numbers, decoded in zip(texts, ids, codec.decimals(ids), codec.decode_batch(ids)):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.tolist() == want
        assert numbers.decode() == ",".join(map(str, want))
        assert decoded == library.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sdtlmrev12!.,aé漢🙂　 \x1f\x0b\x85"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4))
def test_encodes_and_decodes_as_the_library(texts):
    same(LIBRARY, texts)


def test_awkward_texts(library):
    same(library, [r[1] or "" for r in awkward()] + ["ab" * 4000, "!" * 5000, "don't we'll THEY'RE", " " * 300 + "x", "a  b", "a \n b "])


def test_cache_bound(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE", 5)
    codec = B.Codec(PATH)
    for text in ("one two three four five six seven", "eight nine ten one two", "a b c d e f g h i j"):
        assert codec.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_leftmost_of_equal_ranks(library):
    for word in ("aaaaaaa", "abababa", "eeeeeeeeeeeeeeeee", "thethethe"):
        assert B.codec(PATH).encode_batch([word])[0].tolist() == library.encode(word, add_special_tokens=False).ids


def expected(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op9_bpe"](spark, SF).collect()), key=repr) == expected(library, rows)


def test_awkward_rows(spark, library):
    got = B.encoded(clashing(frame(spark, awkward()))).collect()
    assert sorted(map(tuple, got), key=repr) == expected(library, [r[:2] for r in awkward()])
    full = B.encoded(frame(spark, awkward()), keep_ids=True).collect()
    assert all(len(r["ids"]) == r["n_tokens"] and hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] for r in full)
    assert B.encoded(frame(spark, [])).collect() == []
