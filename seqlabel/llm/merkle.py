"""A Merkle manifest of a dataset: leaves, subroots per source, one root.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its length in
UTF-8 bytes, ``:`` and the value.  A source's leaves ascend by id; as long as a
level has more than one node, every 16 consecutive ones become one (the last run
may be shorter, even one node).  What remains is the source's subroot, and the
subroots, ordered by source, become the root in the same way.

Leaves are hashed in the JVM and only digests move from there on:

1. One range shuffle sorts all leaves by (source, id), salted among equal rows.
   Positions within a source come from counts per (partition, source).
2. A superblock is 4,096 consecutive leaves of a source, three whole levels.
   Each is reduced by itself to the node above it, whose levels are reduced in
   the same way, until every source has one node; then the subroots are.  Every
   round leaves a 4,096th of the nodes, so their number is a logarithm.
3. Top down, each node above a superblock gets the siblings on its way to the
   root.  These outer nodes and the superblock's leaves are cogrouped by
   superblock in ``applyInPandas``, which reduces the lower levels, joins them
   with the outer nodes to each leaf's proof, folds the audited leaf with its
   siblings and compares the result with the root.

Sources of fewer leaves than a superblock share groups, so many small sources
don't make many small groups; a source with a third of all rows is as many
superblocks.

Defined cases: null ids come first in their source and are never tampered with by
``tampered``; a null source is a source of its own, before all others; null and
empty texts differ (``-`` and ``0:``); rows of one id are ordered by their leaf,
and repeated rows, being equal, in any order (their siblings differ, not the
result as a whole); an empty table has no root and gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .common import buckets, saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 16
#: Levels of a superblock, which has ``run ** LEVELS`` leaves.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A field as it enters the leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """The leaf's digest, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(f) for f in fields]), 256))


def tampered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Which rows are tampered with (5 divides the crc32 of the id) and what
    their text is then (A-Z lower-cased)."""
    hit = F.crc32(docs[doc_id].cast("string").cast("binary")) % 5 == 0
    return F.coalesce(hit, F.lit(False)), F.translate(docs[text], UPPER, LOWER)


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def reduced(nodes: list[str], size: int, run: int) -> list[list[str]]:
    """The levels of a superblock above its nodes, at most ``LEVELS``, as long as
    its tree of ``size`` nodes has more than one."""
    levels = [nodes]
    while size > 1 and len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([digest(below[i : i + run]) for i in range(0, len(below), run)])
        size = -(-size // run)
    return levels


def siblings(level: list[str], run: int) -> list[tuple[str, str]]:
    """What stands left and right of each node in its run."""
    out = []
    for i in range(0, len(level), run):
        own = level[i : i + run]
        out += [("".join(own[:k]), "".join(own[k + 1 :])) for k in range(len(own))]
    return out


def fold(node: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for left, right in path:
        node = digest((left, node, right))
    return node


def placed(rows: DataFrame, tree: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``tree`` (a number that ascends with the columns ``tree``,
    null first), ``pos`` (from 0, by ``order`` within the tree) and ``size``."""
    n = buckets(rows.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in (*tree, *order)]
    # equal rows are told apart by a salt, so that no range has more than its share
    ranged = rows.withColumn("__salt", F.rand(11)).repartitionByRange(n, *keys, "__salt").sortWithinPartitions(*keys, "__salt").drop("__salt")
    ranged = saved(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__worker", F.shiftright("__at", 33)), name)
    whole = Window.partitionBy(*tree)
    cuts = ranged.groupBy(*tree, "__worker").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    cuts = cuts.select(*[F.col(c).alias("__t_" + c) for c in tree], F.col("__worker").alias("__w"), "__first",
                       F.min("__first").over(whole).alias("tree"), F.sum("__n").over(whole).alias("size"),
                       (F.sum("__n").over(whole.orderBy("__worker")) - F.col("__n")).alias("__before"))
    same = F.col("__worker") == F.col("__w")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col("__t_" + c))
    placed = ranged.join(cuts, same).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before"))
    return placed.drop("__at", "__worker", "__w", "__first", "__before", *["__t_" + c for c in tree])


def group_of(block: str, size: str, shards: int, most: int) -> Column:
    """The group that a superblock of ``most`` nodes is handled in: its own, or
    one that small trees share."""
    return F.when(F.col(size) > most, F.xxhash64("tree", block)).otherwise(F.pmod(F.xxhash64("tree"), F.lit(shards)))


def segments(tree: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the superblocks in rows sorted by (tree, block)."""
    ends = np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1
    cuts = [0, *ends.tolist(), len(tree)]
    return list(zip(cuts, cuts[1:])) if len(tree) else []


def blocks(rows: pd.DataFrame, most: int):
    """(rows of one superblock in order, their digests as hex) of a group."""
    rows = rows.sort_values(["tree", "pos"], ignore_index=True)
    for a, b in segments(rows["tree"].to_numpy(), rows["pos"].to_numpy() // most):
        own = rows.iloc[a:b]
        yield own, [bytes(d).hex() for d in own["digest"]]


def grouped(nodes: DataFrame, shards: int, run: int) -> GroupedData:
    """Nodes by the groups of their superblocks."""
    keyed = nodes.select("tree", "pos", "size", "digest", F.expr(f"pos DIV {run**LEVELS}").alias("__block"))
    return keyed.groupBy(group_of("__block", "size", shards, run**LEVELS))


def climbed(nodes: DataFrame, shards: int, run: int) -> DataFrame:
    """The nodes above the superblocks: tree, pos, size, digest."""
    most = run**LEVELS

    def tops(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, names in blocks(rows, most):
            size = int(own["size"].iloc[0])
            top = reduced(names, size, run)[-1]
            out.append((own["tree"].iloc[0], own["pos"].iloc[0] // most, -(-size // most), bytes.fromhex(top[0])))
        return pd.DataFrame(out, columns=["tree", "pos", "size", "digest"])

    return grouped(nodes, shards, run).applyInPandas(tops, "tree long, pos long, size long, digest binary")


PATH = "array<struct<left:string,right:string>>"


def sided(nodes: DataFrame, shards: int, run: int) -> DataFrame:
    """Each node's siblings on the levels of its superblock: tree, pos, path."""
    most = run**LEVELS

    def paths(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, names in blocks(rows, most):
            sides = [siblings(level, run) for level in reduced(names, int(own["size"].iloc[0]), run)[:-1]]
            for k, pos in enumerate(own["pos"]):
                path = [side[k // run**i] for i, side in enumerate(sides)]
                out.append((own["tree"].iloc[0], pos, [{"left": x, "right": y} for x, y in path]))
        return pd.DataFrame(out, columns=["tree", "pos", "path"])

    return grouped(nodes, shards, run).applyInPandas(paths, f"tree long, pos long, path {PATH}")


class Forest:
    """Trees reduced superblock by superblock: ``rounds[0]`` are the nodes given
    (tree, pos, size, digest), ``rounds[k + 1]`` those above the superblocks of
    ``rounds[k]``, for the trees that had more than one node there.  Rounds are as
    many as the logarithm of the largest tree."""

    def __init__(self, nodes: DataFrame, total: int, run: int, name: str):
        self.rounds, self.total, self.run = [nodes], total, run
        while (self.rounds[-1].agg(F.max("size")).first()[0] or 1) > 1:
            self.rounds.append(saved(climbed(self.open(len(self.rounds) - 1), self.shards(len(self.rounds) - 1), run), name))

    def open(self, k: int) -> DataFrame:
        """Nodes of round ``k`` in trees that have more than one there."""
        return self.rounds[k].filter("size > 1")

    def shards(self, k: int) -> int:
        """Groups for the smaller trees of round ``k``.  A tree with two nodes in
        round ``k`` has more leaves than ``k`` levels of superblocks hold in one."""
        return max(1, -(-2 * self.total // self.run ** (LEVELS * (k + 1))))

    def tops(self) -> DataFrame:
        """tree and digest of each tree's last node."""
        return reduce(DataFrame.unionByName, [r.filter("size = 1").select("tree", "digest") for r in self.rounds])

    def paths(self, first: int) -> DataFrame:
        """tree, pos and path (siblings up to the tree's top) of the nodes of round
        ``first``, and of lone nodes of the rounds before it."""
        out = None
        for k in range(len(self.rounds) - 1, first - 1, -1):
            done = self.rounds[k].filter("size = 1").select("tree", "pos", F.expr(f"CAST(array() AS {PATH})").alias("path"))
            if out is None:
                out = done
                continue
            above = out.select("tree", F.col("pos").alias("__block"), F.col("path").alias("__above"))
            own = sided(self.open(k), self.shards(k), self.run).withColumn("__block", F.expr(f"pos DIV {self.run**LEVELS}"))
            out = own.join(above, ["tree", "__block"]).select("tree", "pos", F.concat("path", "__above").alias("path")).unionByName(done)
        early = [r.filter("size = 1").select("tree", "pos", F.expr(f"CAST(array() AS {PATH})").alias("path")) for r in self.rounds[:first]]
        return reduce(DataFrame.unionByName, [*([] if out is None else [out]), *early])


class Manifest:
    """The written tables of one dataset: ``leaves`` (tree, pos, size, digest and
    what was kept with them), ``sources`` (source, tree, subroot) and the
    ``root``, None for an empty dataset."""

    def __init__(self, leaves: DataFrame, source: str = "source", order: Sequence[str] = ("doc_id", "digest"), run: int = RUN):
        self.leaves = saved(placed(leaves, [source], list(order), "merkle-sorted"), "merkle-leaves")
        self.forest = Forest(self.leaves, self.leaves.count(), run, "merkle-nodes")
        firsts = self.leaves.filter("pos = 0").select("tree", F.col(source).alias("source"), F.col("size").alias("n"))
        self.sources = saved(firsts.join(self.forest.tops().withColumnRenamed("digest", "subroot"), "tree"), "merkle-subroots")
        subroots = self.sources.select(F.lit(0).alias("__all"), F.col("tree").alias("__source"), F.col("subroot").alias("digest"))
        self.subroots = saved(placed(subroots, ["__all"], ["__source"], "merkle-sources").drop("__all"), "merkle-upper")
        self.upper = Forest(self.subroots, self.subroots.count(), run, "merkle-upper")
        last = self.upper.tops().first()
        self.root = bytes(last["digest"]).hex() if last else None

    def outer_nodes(self) -> DataFrame:
        """What each superblock needs from outside: tree, block, size (of the
        tree), subroot and the path from the superblock's top to the root."""
        over = self.upper.paths(0).join(self.subroots.select("tree", "pos", "__source", F.col("digest").alias("subroot")), ["tree", "pos"])
        over = over.select(F.col("__source").alias("tree"), "subroot", F.col("path").alias("__over"))
        sizes = self.sources.select("tree", F.col("n").alias("size"))
        return saved(self.forest.paths(1).join(over, "tree").join(sizes, "tree").select(
            "tree", F.col("pos").alias("block"), "size", "subroot", F.concat("path", "__over").alias("path")), "merkle-outer")


AUDITED = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def audited(docs: DataFrame, changed: Column | None = None, text_now: Column | None = None, doc_id: str = "doc_id", source: str = "source",
            fields: Sequence[str] = FIELDS, text: str = "text", run: int = RUN) -> DataFrame:
    """One row per document of the manifest of ``docs``: its leaf, subroot, root
    and the digest of its proof, and what the proof gives for the document as it
    is now: folded_root and verified.  Where ``changed`` holds its text is
    ``text_now``, elsewhere the one of the manifest."""
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType
    now = F.lit(None).cast("binary")
    if changed is not None:
        now = F.when(changed, leaf([text_now if c == text else docs[c] for c in fields]))
    leaves = docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"),
                         leaf([docs[c] for c in fields]).alias("digest"), now.alias("now"))
    made = Manifest(saved(leaves, "merkle-digests"), run=run)
    root, shards, most = made.root, made.forest.shards(0), run**LEVELS

    def finish(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        known = {(t, b): (bytes(s).hex(), [(p["left"], p["right"]) for p in path])
                 for t, b, s, path in zip(above["tree"], above["block"], above["subroot"], above["path"])}
        out = []
        for rows, names in blocks(own, most):
            subroot, path = known[rows["tree"].iloc[0], rows["pos"].iloc[0] // most]
            sides = [siblings(level, run) for level in reduced(names, int(rows["size"].iloc[0]), run)[:-1]]
            for k, (id_, name, new) in enumerate(zip(rows["id"], names, rows["now"])):
                if k % run == 0:  # the levels above are the run's
                    high = [side[k // run**i] for i, side in enumerate(sides) if i] + path
                    tail = "".join(x for pair in high for x in pair)
                near = sides[0][k : k + 1] if sides else []
                proof = digest((*near[0], tail) if near else (tail,))
                folded = fold(name if new is None else bytes(new).hex(), near + high)
                out.append((id_, name, subroot, root, proof, folded, folded == root))
        return pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    if root is None:
        out = spark.createDataFrame([], AUDITED)
    else:
        own = made.leaves.select(F.col("doc_id").cast("string").alias("id"), "tree", "pos", "size", "digest", "now", F.expr(f"pos DIV {most}").alias("__block"))
        out = own.groupBy(group_of("__block", "size", shards, most).alias("g")).cogroup(
            made.outer_nodes().groupBy(group_of("block", "size", shards, most).alias("g"))).applyInPandas(finish, AUDITED)
    return out.select(F.col("id").cast(kind).alias("doc_id"), *out.columns[1:])
