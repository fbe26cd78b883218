import zlib
from hashlib import sha256

import duckdb
import pytest
from helpers import SF, awkward, clashing, frame
from pyspark.sql import functions as F

from seqlabel.llm import merkle as M
from seqlabel.llm.queries import ORACLE_SQL, QUERIES


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, paths, n=16):
    """The top of a list of nodes; paths[i] gets each node's siblings."""
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // n * n : k // n * n + n]
            paths[i].append((run[: k % n], run[k % n + 1 :]))
        nodes = [h(*nodes[k : k + n]) for k in range(0, len(nodes), n)]
        at = [k // n for k in at]
    return nodes[0]


def brute(rows, n=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    found, tops = [], []
    for s in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        paths = [[] for _ in own]
        tops.append(climb([leaf(r) for r in own], paths, n))
        found.append((own, paths))
    over = [[] for _ in tops]
    root = climb(tops, over, n) if tops else None
    out = []
    for (own, paths), subroot, up in zip(found, tops, over):
        for r, path in zip(own, paths):
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf(now)
            for left, right in path + up:
                node = h(*left, node, *right)
            out.append((r[0], leaf(r), subroot, root, h(*[x for le, ri in path + up for x in le + ri]), node, node == root))
    return out


def agree(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def fields(df):
    return [tuple(r) for r in df.select(*M.FIELDS).collect()]


def tampered(docs):
    return M.audited(docs, *M.tampered(docs))


def test_query(spark):
    docs = fields(spark.read.parquet(f"{SF}/documents.parquet"))
    got = QUERIES["op11_merkle"](spark, SF).collect()
    agree(got, brute(docs))
    assert 0 < sum(not r["verified"] for r in got) < len(docs) / 4


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    sql = con.execute(ORACLE_SQL["op11_merkle"])
    got = QUERIES["op11_merkle"](spark, SF).select([d[0] for d in sql.description])
    agree(got.collect(), sql.fetchall())


def test_awkward_rows(spark):
    docs = clashing(frame(spark, awkward()).repartition(3)).selectExpr("*", "'own' AS tree", "'own' AS pos", "'own' AS size", "'own' AS leaf", "'own' AS digest")
    want = brute(fields(docs))
    got = tampered(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    # equal rows take their siblings in any order
    assert sorted(map(tuple, got.drop("proof_sha256").collect()), key=repr) == sorted([(*w[:4], *w[5:]) for w in want], key=repr)
    agree(got.filter("doc_id <> 16").collect(), [w for w in want if w[0] not in (16, None)])
    assert tampered(docs.limit(0)).collect() == []
    assert tampered(docs.limit(0)).schema == got.schema


def test_one_row_is_its_own_root(spark):
    got = tampered(frame(spark, awkward()[4:5])).collect()
    assert got[0]["leaf"] == got[0]["subroot"] == got[0]["root"] and got[0]["proof_sha256"] == h()


def test_large_ids_and_null_ids(spark):
    rows = [((1 << 62) + i, f"T{i}", "en", "s", 1) for i in range(20)] + [(None, f"N{i}", "en", "s", 1) for i in range(3)]
    docs = frame(spark, rows)
    agree(tampered(docs).collect(), brute(fields(docs)))


@pytest.mark.parametrize("run", [2, 3])
def test_several_rounds(spark, run):
    """Small runs, so that superblocks, outer nodes and sources take many rounds;
    one source has half the rows, many have one or two."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"),
                                   F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.expr("id DIV 3").cast("string"))).alias("source"),
                                   F.lit(7).cast("long").alias("n_chars"))
    agree(M.audited(docs, *M.tampered(docs), run=run).collect(), brute(fields(docs), run))


def test_partitioning_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once = sorted(map(tuple, tampered(docs.repartition(1)).collect()))
    assert once == sorted(map(tuple, tampered(docs.repartition(7)).collect()))


def test_any_change_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = M.audited(docs, docs["doc_id"] % 3 == 0, F.concat(F.coalesce(docs["text"], F.lit("")), F.lit("!")))
    assert {r["doc_id"] for r in got.filter("NOT verified").collect()} == {r["doc_id"] for r in docs.collect() if r["doc_id"] % 3 == 0}
