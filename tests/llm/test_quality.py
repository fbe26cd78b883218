import re
from collections import Counter
from fractions import Fraction
from math import comb

import duckdb
from helpers import SF, awkward, clashing, frame

from seqlabel.llm import quality as Q
from seqlabel.llm.queries import ORACLE_SQL, QUERIES


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))


def test_statistics():
    for r in awkward():
        assert Q.statistics((r[1] or "").encode()) == statistics(r[1] or "")


def test_binomial_tail_is_exact():
    for x, n, p in ((0, 10, 0.1), (3, 40, 0.05), (39, 40, 0.5), (7, 200, 0.02)):
        want = sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(x + 1))
        assert abs(Q.binomial_tail(x, n, p) - float(want)) < 1e-9


def test_certified_stops_at_first_failure():
    assert Q.certified(1000, [0, 1, 2, 60, 3], 0.05, 0.01) == 3
    assert Q.certified(10, [0, 0], 0.05, 0.01) == 0
    assert Q.certified(0, [0], 0.05, 0.01) == 0


def table(spark, good, bad):
    """Documents whose share of symbols tells good from bad in one stratum only."""
    word = " ".join(f"w{i} ok" for i in range(60))
    rows = [(i, word, "en", "s", 1) for i in range(good)] + [(good + i, word + " $ % & #" * 12, "en", "s", 1) for i in range(bad)]
    rows += [(10_000 + i, word + " $ % & #" * 12, "xx", "s", 1) for i in range(5)]
    labels = [(i, int(i < good), 0) for i in range(good + bad)] + [(10_000, 0, 0), (10_001, None, None), (99_999, 1, 0), (3, 1, 0)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_per_stratum(spark):
    docs, labels = table(spark, 800, 40)
    out = {r["doc_id"]: r["kept"] for r in Q.judged(docs, labels).collect()}
    assert all(out[i] for i in range(800)) and not any(out[800 + i] for i in range(40))
    assert all(out[10_000 + i] for i in range(5))  # too few labels there: nothing is rejected
    docs, labels = table(spark, 60, 40)
    assert all(r["kept"] for r in Q.judged(docs, labels).collect())


def strata(spark, n, others):
    """``n`` strata of 400 good documents and ``others`` of 300 good and 100 bad,
    which look the same."""
    word = " ".join(f"w{i} ok" for i in range(60))
    rows, labels = [], []
    for s in range(n + others):
        for i in range(400):
            doc, good = s * 1000 + i, s < n or i < 300
            rows.append((doc, word + ("" if good else " $ % & #" * 12), f"l{s}", "s", 1))
            labels.append((doc, int(good), 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_strata_are_never_pooled(spark):
    docs, labels = strata(spark, 64, 6)
    assert all(r["kept"] for r in Q.judged(docs, labels).collect())  # no stratum alone has the labels to certify a cutoff
    alone = {r["doc_id"]: r["kept"] for r in Q.judged(*strata(spark, 0, 1), delta=2.0).collect()}
    assert sum(not k for k in alone.values()) == 100
    # the correction is the only thing that other strata change
    together = {r["doc_id"]: r["kept"] for r in Q.judged(docs, labels, delta=2.0 * 70).collect()}
    assert all(together[s * 1000 + i] == (s < 64 or i < 300) for s in range(70) for i in range(400))


def test_many_strata_are_joined_salted(spark, monkeypatch):
    docs, labels = table(spark, 800, 40)
    docs = docs.unionByName(frame(spark, awkward()))
    want = {repr(r) for r in Q.judged(docs, labels).collect()}, {repr(r) for r in Q.filtered(docs, labels).collect()}
    monkeypatch.setattr(Q, "BROADCAST_STRATA", -1)
    assert ({repr(r) for r in Q.judged(docs, labels).collect()}, {repr(r) for r in Q.filtered(docs, labels).collect()}) == want


def test_filter_agrees_with_verdict_and_keeps_columns(spark):
    docs, labels = table(spark, 800, 40)
    docs = clashing(docs.unionByName(frame(spark, awkward())))
    out = Q.filtered(docs, labels)
    assert out.columns == docs.columns
    kept = sorted((r["doc_id"] for r in Q.judged(docs, labels).filter("kept").collect()), key=repr)
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == kept


def test_empty_tables(spark):
    docs, labels = table(spark, 3, 1)
    none = labels.limit(0)
    assert Q.judged(docs.limit(0), labels).collect() == []
    assert Q.judged(docs, none).filter("kept").count() == docs.count()
    assert Q.filtered(docs.limit(0), none).collect() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = con.execute(ORACLE_SQL["op4_quality"])
    columns = [d[0] for d in sql.description]
    got = QUERIES["op4_quality"](spark, SF)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())
