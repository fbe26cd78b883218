import random
import re

import duckdb
import pytest
from helpers import SF, clashing

from seqlabel.llm import urlfilter as U
from seqlabel.llm.queries import ORACLE_SQL, QUERIES

AWKWARD = [
    (1, None), (2, ""), (3, "no scheme casino"), (4, "http://"), (5, "HTTP://WWW.Example.ORG/ES/x"), (6, "http://www.example.org/es/x?free=1"),
    (7, "http://www.example.org"), (8, "http://notexample.org/es/1"), (9, "x://a.com/fr/1"), (10, "x://a.com/fr"), (11, "x://a.com:80/de/"),
    (12, "http://h.net/casinos"), (13, "http://h.net/casino"), (14, "http://h.net/free/free/free"), (15, "http://h.net/FREE-bets"),
    (16, "http://h.net/" + "a/" * 40_000 + "free#win"), (17, "http://h.net/écasino"), (18, "http://h.net/casinoé/x"), (19, "http://h.net/\ncasino\n"),
    (20, "a://b://example.org/en/1"), (21, "http://org/"), (22, "http://.org/"), (23, "http://h.net/?u=http://example.org/es/"), (24, "casino"),
    (None, "http://free.net/win"), (None, None), (13, "http://h.net/casino"), (25, "http://h.net/porno porn"), (26, "free\nbets"),
]


def brute(url, rules=U.RULES, strict=U.STRICT, soft=U.SOFT, several=U.SEVERAL):
    low = (url or "").translate(U.LOWER)
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(U.LOWER)
    fits = [(len(r), len(r.split("/")[0]), v == "block", v, r) for v, r in rules
            if ("." + host).endswith("." + r.split("/")[0]) and host and path.startswith(r[r.index("/"):])]
    has = [{t for t in ts if re.search(rf"(?<![0-9a-z\x80-\U0010ffff]){re.escape(t)}(?![0-9a-z\x80-\U0010ffff])", low)} for ts in (strict, soft)]
    method = "block" if has[0] or len(has[1]) >= several else "allow"
    return (host, path, max(fits)[4] if fits else None, len(has[0]), len(has[1]), max(fits)[3] if fits else method)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_awkward_rows_and_clashing_columns(spark):
    pages = spark.createDataFrame(AWKWARD, "page_id long, url string")
    want = sorted(((i, *brute(u)) for i, u in AWKWARD), key=repr)
    got = U.judged(clashing(pages).selectExpr("*", "'own' AS host", "'own' AS verdict"))
    assert got.columns == ["page_id", "host", "path", "rule", "n_strict", "n_soft", "verdict"]
    assert rows_of(got) == want
    own = clashing(pages).selectExpr("*", "'own' AS host", "'own' AS verdict")
    kept = U.filtered(own)
    assert kept.columns == own.columns
    assert sorted(map(repr, [r["page_id"] for r in kept.collect()])) == sorted(repr(w[0]) for w in want if w[-1] == "allow")
    assert U.judged(pages.limit(0)).collect() == [] and U.filtered(pages.limit(0)).collect() == []


def test_no_rules_or_no_words(spark):
    pages = spark.createDataFrame(AWKWARD, "page_id long, url string")
    assert rows_of(U.judged(pages, rules=[], strict=[], soft=[])) == sorted(((i, *brute(u, [], [], [])) for i, u in AWKWARD), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_urls(seed):
    pick = random.Random(seed)
    terms = ["ab", "abc", "b", "bc", "c-a", "ca"]
    rules = [(pick.choice(["allow", "block"]), f"{h}/{p}") for h in ("a.b", "b", "c.a.b") for p in ("", "a", "ab/", "a/b")]
    hosts, words = U.Rules(rules), U.Vocabulary(terms[:2], terms[2:])
    urls = ["x://" * pick.randint(0, 1) + "".join(pick.choice("abc.-/?") for _ in range(pick.randint(0, 14))) for _ in range(800)]
    strict, soft = words.counts(urls)
    for u, s, w in zip(urls, strict, soft):
        host, path = U.split(u)
        rule, verdict = hosts.fitting(host, path)
        want = brute(u, rules, terms[:2], terms[2:])
        assert (host, path, rule, s, w) == want[:5] and (rule is None or verdict == want[5])


def test_ties_between_rules():
    assert U.Rules([("block", "b/a"), ("allow", "b/a")]).fitting("b", "/a") == ("b/a", "block")
    assert U.Rules([("allow", "b/a"), ("block", "b/a")]).fitting("b", "/a") == ("b/a", "block")
    assert U.Rules([("allow", "org/a/"), ("block", "a.org/a")]).fitting("a.org", "/a/")[0] == "a.org/a"
    assert U.Rules([("allow", "org/b/c"), ("block", "a.org/b")]).fitting("a.org", "/b/c") == ("a.org/b", "block")  # as long; the longer host


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    sql = con.execute(ORACLE_SQL["op13_url_filter"])
    got = QUERIES["op13_url_filter"](spark, SF)
    assert sorted(d[0] for d in sql.description) == sorted(got.columns)
    order = [d[0] for d in sql.description]
    assert rows_of(got.select(order)) == sorted(sql.fetchall(), key=repr)


def test_sql_on_awkward_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", AWKWARD)
    sql = con.execute(ORACLE_SQL["op13_url_filter"])
    order = [d[0] for d in sql.description]
    got = U.judged(spark.createDataFrame(AWKWARD, "page_id long, url string")).select(order)
    assert rows_of(got) == sorted(sql.fetchall(), key=repr)
