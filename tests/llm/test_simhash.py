import re

import numpy as np
import pytest
import xxhash
from helpers import SF, awkward, clashing, frame

from seqlabel.llm import simhash as S
from seqlabel.llm.components import components
from seqlabel.llm.queries import QUERIES


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=4):
    """Root position of each fingerprint under brute-force linking."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def expected(rows):
    fps = [fingerprint(r[1]) for r in rows]
    roots = groups(fps)
    least = {}
    for r, g in zip(rows, roots):
        least[g] = min([x for x in (least.get(g), r[0]) if x is not None], default=None)
    return sorted(((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, roots)), key=repr)


@pytest.mark.parametrize("bucket", [1024, 3])
def test_search_equals_brute_force(spark, bucket):
    """Clusters with many members at 1 to 6 bits, chains, and lone values; with a
    tiny bucket nearly every variant takes the whole-width way."""
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for centre in fps[:6]:
        for _ in range(25):
            x = centre
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    chain = fps[0]
    for b in range(0, 60, 4):
        chain ^= 0b1111 << b
        fps.append(chain)
    fps = sorted(set(fps) | {0, (1 << 64) - 1})
    df = spark.createDataFrame([(S.signed(x),) for x in fps], "fp long")
    got = {S.signed(x): S.signed(x) for x in fps}
    got.update({r["node"]: r["root"] for r in components(S.links(df, 4, bucket)).collect()})
    want = groups(fps)
    by_got, by_want = {}, {}
    for i, x in enumerate(fps):
        by_got.setdefault(got[S.signed(x)], set()).add(x)
        by_want.setdefault(want[i], set()).add(x)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_awkward_rows(spark):
    got = S.near_duplicates(clashing(frame(spark, awkward()))).collect()
    assert sorted(map(tuple, got), key=repr) == expected(awkward())
    assert S.near_duplicates(frame(spark, [])).collect() == []


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op2_simhash"](spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()), key=repr) == expected(rows)


def test_deduplicated_keeps_columns_and_first(spark):
    df = clashing(frame(spark, awkward()))
    out = S.deduplicated(df)
    assert out.columns == df.columns
    first = {c for i, _, c in expected(awkward()) if i == c} | {None}
    assert {r["doc_id"] for r in out.collect()} == first
    copies = frame(spark, [(5, "a b c d e", "en", "s", 9), (3, "a b c d e", "en", "s", 9), (3, "a b c d e", "en", "s", 9), (None, "a b", None, None, 3)])
    assert sorted(r["doc_id"] or 0 for r in S.deduplicated(copies).collect()) == [0, 3, 3]


@pytest.mark.parametrize("radius", [1, 3])
def test_hot_fingerprints_an_odd_radius_apart(spark, radius):
    """The hot way links pairs exactly ``radius`` bits apart, and none farther."""
    rng = np.random.default_rng(8)
    fps = []
    for x in rng.integers(0, 1 << 63, 3):
        x = int(x)
        for k in range(5):
            fps.append(x ^ sum(1 << (radius * k + j) for j in range(radius)))
        fps += [x, x ^ ((1 << radius + 1) - 1) << 40]
    df = spark.createDataFrame([(S.signed(x),) for x in fps], "fp long")
    got = {S.signed(x): S.signed(x) for x in fps}
    got.update({r["node"]: r["root"] for r in components(S.links(df, radius, 1)).collect()})
    want, pairs = groups(fps, radius), set()
    for i, x in enumerate(fps):
        pairs.add((got[S.signed(x)], want[i]))
    assert len(pairs) == len(set(want)) == len(set(got.values())) == 6
