"""Encoding, vocabulary, de-duplication and similarity against brute force."""

import pytest

from seqlabel.operators import curate as C
from seqlabel.operators import encode as E
from seqlabel.operators import similarity as SIM


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_encode_lengths(spark):
    seqs = [(0, ""), (1, "A"), (2, "A" * 511), (3, "A" * 512), (4, "AZ")]
    df = spark.createDataFrame(seqs, "id long, sequence string")
    vocab = spark.createDataFrame([("A", 5, 0.5, 1, 3)], "symbol string, count long, share double, n_docs long, token_id int")
    rows = {r["id"]: r for r in E.encode(df, vocab, max_len=512).collect()}
    for r in rows.values():
        assert len(r["input_ids"]) == 512 and len(r["attention_mask"]) == 512
    assert rows[0]["input_ids"][:2] == [1, 0] and rows[0]["n_tokens"] == 1
    assert rows[1]["input_ids"][:3] == [3, 1, 0]
    assert rows[2]["n_tokens"] == 512 and not rows[2]["truncated"] and rows[2]["input_ids"][-1] == 1
    assert rows[3]["n_tokens"] == 512 and rows[3]["truncated"] and rows[3]["input_ids"][-1] == 1
    assert rows[4]["input_ids"][:3] == [3, 2, 1]                  # unknown symbol -> 2
    assert sum(rows[4]["attention_mask"]) == 3


def test_vocab_counts(spark):
    df = spark.createDataFrame([(0, "ABA"), (1, "BC")], "id long, sequence string")
    v = {r["symbol"]: r for r in E.build_vocab(df).collect()}
    assert (v["A"]["count"], v["A"]["n_docs"]) == (2, 1)
    assert (v["B"]["count"], v["B"]["n_docs"]) == (2, 2)
    assert v["A"]["token_id"] == 3 and v["B"]["token_id"] == 4 and v["C"]["token_id"] == 5


def test_space_symbols(spark):
    df = spark.createDataFrame([(0, "ABC"), (1, "")], "id long, sequence string")
    r = {x["id"]: x["title"] for x in E.spaced(df).collect()}
    assert r == {0: "A B C", 1: ""}


def test_dedup_modes(spark):
    df = spark.createDataFrame([(3, "XY", 1, None), (1, "XY", 0, 1), (2, "Z", 0, 0)],
                               "id long, sequence string, a int, b int")
    first = {r["id"]: r for r in C.dedup_exact(df, ["a", "b"], mode="first").collect()}
    union = {r["id"]: r for r in C.dedup_exact(df, ["a", "b"], mode="union").collect()}
    assert set(first) == {1, 2} and first[1]["n_copies"] == 2
    assert (first[1]["a"], first[1]["b"]) == (0, 1)
    assert (union[1]["a"], union[1]["b"]) == (1, 1)


@pytest.mark.parametrize("t", [0.3, 0.6, 0.85])
def test_similar_pairs_brute_force(spark, t):
    import random

    rnd = random.Random(int(t * 100))
    alpha = "ACDE"
    tested = [(i, "".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 30)))) for i in range(40)]
    ref = [(100 + j, "".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 30)))) for j in range(12)]
    tested += [(90, ref[0][1]), (91, ref[1][1][:-1] + "Q")]
    want = set()
    for i, a in tested:
        for j, b in ref:
            L = max(len(a), len(b))
            if 1 - lev(a, b) / L >= t:
                want.add((i, j))
    a_df = spark.createDataFrame(tested, "id long, sequence string")
    r_df = spark.createDataFrame(ref, "id long, sequence string")
    for bc in (True, False):
        got = {(r["id"], r["ref_id"]) for r in SIM.similar_pairs(a_df, r_df, t, broadcast=bc).collect()}
        assert got == want
    jvm = {(r["id"], r["ref_id"]) for r in SIM.similar_pairs(a_df, r_df, t, kernel="builtin").collect()}
    assert jvm == want
    kept = {r["id"] for r in SIM.exclude_similar(a_df, r_df, t).collect()}
    assert kept == {i for i, _ in tested} - {i for i, _ in want}


def test_cooccurrence_pct(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "id long, SP int")
    b = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 1)], "id long, X int, Y int")
    r = {(x["signal"], x["target"]): x for x in C.cooccurrence(a, b, "id", ["SP"], ["X", "Y"]).collect()}
    assert r[("SP", "X")]["pct"] == 100.0 and r[("SP", "X")]["rank"] == 1
    assert r[("SP", "Y")]["pct"] == 50.0 and r[("SP", "Y")]["rank"] == 2


def test_encode_join_path_equals_map_path(spark, monkeypatch):
    df = spark.createDataFrame([(0, "ABCA"), (1, ""), (2, "ZZ" * 300)], "id long, sequence string")
    vocab = E.build_vocab(df)
    a = {r["id"]: (r["input_ids"], r["attention_mask"], r["n_tokens"]) for r in E.encode(df, vocab, max_len=16).collect()}
    monkeypatch.setattr(E, "MAP_LIMIT", 0)
    b = {r["id"]: (r["input_ids"], r["attention_mask"], r["n_tokens"]) for r in E.encode(df, vocab, max_len=16).collect()}
    assert a == b


@pytest.mark.parametrize("t", [0.7, 0.8, 0.9])
def test_kmer_mode_equals_exact(spark, t):
    import random

    rnd = random.Random(int(t * 1000))
    alpha = "ACDEFG"
    base = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    seqs = list(base)
    for s in base[:20]:                      # planted near copies: a few edits each
        x = list(s)
        for _ in range(rnd.randint(0, 6)):
            if x and rnd.random() < 0.5:
                x[rnd.randrange(len(x))] = rnd.choice(alpha)
            else:
                x.insert(rnd.randrange(len(x) + 1), rnd.choice(alpha))
        seqs.append("".join(x))
    seqs += ["AAAAAAAAAAAA", "AAAAAAAAAAAB", "A", "AB"]   # repeats and very short rows
    rows = [(i, s) for i, s in enumerate(seqs)]
    want = set()
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and 1 - lev(a, b) / max(len(a), len(b)) >= t:
                want.add((i, j))
    df = spark.createDataFrame(rows, "id long, sequence string")
    got = {(r["id"], r["ref_id"]) for r in SIM.similar_pairs_kmer(df, None, t).collect()}
    assert got == want
    # frequent grams left out of the index: still exact
    tight = {(r["id"], r["ref_id"]) for r in SIM.similar_pairs_kmer(df, None, t, max_group=3).collect()}
    assert tight == want
    ref = df.filter("id % 2 = 0")
    want2 = {(i, j) for i, a in rows for j, b in rows if j % 2 == 0 and a and b
             and 1 - lev(a, b) / max(len(a), len(b)) >= t}
    got2 = {(r["id"], r["ref_id"]) for r in SIM.similar_pairs_kmer(df, ref, t).collect()}
    assert got2 == want2
    got3 = {(r["id"], r["ref_id"]) for r in SIM.similar_pairs_kmer(df, ref, t, max_group=2).collect()}
    assert got3 == want2


def test_kmer_mode_refuses_low_threshold(spark):
    df = spark.createDataFrame([(0, "ABC")], "id long, sequence string")
    with pytest.raises(ValueError):
        SIM.similar_pairs_kmer(df, None, 0.3)
