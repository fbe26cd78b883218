"""Removal of long byte passages that a document with a smaller id has too.

A byte goes if a ``SPAN``-byte string covers it that also starts in a document
with a smaller id.  The strings are found by matching against run-length indexes
(``rlbwt``); winnowing only decides which texts share an index, so that no index
holds the corpus:

1. Every ``SPAN``-byte string has a least hash of the ``GRAM``-byte strings within
   it (rightmost of equals).  Its anchor is that gram with the bytes before it
   where at least half of the string's other bytes stand there, else with those
   behind it: two thirds of the string, so that phrases which many texts use
   seldom meet.  Equal strings have equal anchors.  The consecutive strings of one
   anchor form a slice of the text.  Slices go to buckets by anchor; equal slices
   are first merged per task to their least document, and an anchor that only one
   slice has can't hold a match.
2. In a bucket, equal slices of one anchor match whole.  Where an anchor has
   different slices, each one's first document sends its bytes to the anchor's
   index, and matching statistics streamed over that index give, for every place
   of a slice, the least document with the same ``SPAN`` bytes.
3. Each document takes back the places found and removes what they cover.

An anchor with more than ``HOT`` different slices within one task (the edge of a
passage that very many documents hold) is told to its bucket by a flag alone.
The slices of such an anchor, and of one that gathers more than ``4 * HOT`` in
its bucket, are matched string by string, each string in the index of its own
hash, after equal strings of a batch are merged to their least document.

Texts are shuffled only for documents that have something to match: a bitmap of
``BITMAP`` bits, of fixed size whatever the data, sorts out most of the others
beforehand and loses none.

Defined cases: a null text is empty; texts under ``SPAN`` bytes stay whole; rows
with one id never match each other and share what is found for either; a null id
neither matches nor is matched; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, buckets, bytes_of, dropped, fresh_name, mix, packed, parts, released, saved, swept, unpacked
from .rlbwt import RunLengthIndex
from .winnowing import BASE, INVERSE, powers

SPAN = 50
GRAM = 16
HOT = 512
FLUSH = 3 << 18
CHUNK = 1 << 19
BITMAP = 1 << 25
PAGE = 1 << 15
#: Bytes of a slice's hash, and of an anchor's that are sent beside its bucket.
#: Anchors that agree in those share a group, where their bytes tell them apart.
HASH, ANCHOR = 7, 4
FULL, CLOSE, STRINGS = 0, 1, 2
FLAG = -(1 << 63)


def sliced(bodies: list[bytes], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Slices of the bodies: (body number, first byte, strings, anchor, hash)."""
    out = []
    text, base, piece, total = [], [], [], 0

    def flush() -> None:
        nonlocal total
        if total >= span:
            out.append(_sliced(np.array(text), np.array(base), piece, span, gram))
        text.clear(), base.clear(), piece.clear()
        total = 0

    for i, body in enumerate(bodies):
        for at in range(0, max(1, len(body) - span + 1), CHUNK):
            part = body[at : at + CHUNK + span - 1] if len(body) > CHUNK else body
            if len(part) < span:
                continue
            if total + len(part) > CHUNK + span:
                flush()
            text.append(i), base.append(at), piece.append(part)
            total += len(part)
    flush()
    kinds = [np.int64, np.int64, np.int64, np.uint64, np.uint64]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, k) for k in kinds)


def _sliced(text: np.ndarray, base: np.ndarray, pieces: list[bytes], span: int, gram: int) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = len(codes)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, n), out=prefix[1:], dtype=np.uint64)
    up = powers(BASE, n)
    hashes = mix((prefix[gram:] - prefix[: n - gram + 1]) * up[: n - gram + 1])
    m, window = len(hashes), span - gram + 1
    keys = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(m - 1, -1, -1, dtype=np.uint64)
    wide = 1
    while 2 * wide <= window:
        keys = np.minimum(keys[:-wide], keys[wide:])
        wide *= 2
    if wide < window:
        keys = np.minimum(keys[: len(keys) - (window - wide)], keys[window - wide :])
    piece = np.repeat(np.arange(len(pieces)), sizes)
    whole = np.flatnonzero(piece[: n - span + 1] == piece[span - 1 :])
    keys = keys[whole]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1] + 1))))
    lo, count = whole[first], np.diff(np.append(first, len(whole)))
    at = m - 1 - (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # strings with at least half of their other bytes before the gram, and those with more behind it
    half = window // 2
    before = np.clip(at - half - lo + 1, 0, count)
    lo, count = np.stack((lo, lo + before), 1).ravel(), np.stack((before, count - before), 1).ravel()
    begin, size = np.stack((at - half, at), 1).ravel(), np.tile(np.array([gram + half, span - half + 1]), len(at))
    some = count > 0
    lo, count, begin, size = lo[some], count[some], begin[some], size[some]
    anchor = mix((prefix[begin + size] - prefix[begin]) * up[begin] + size.astype(np.uint64))
    stop = lo + count + span - 1
    own = mix((prefix[stop] - prefix[lo]) * up[lo] + (stop - lo).astype(np.uint64)) >> np.uint64(64 - 8 * HASH)
    at = piece[lo]
    return text[at], base[at] + lo - (np.cumsum(sizes) - sizes)[at], count, anchor, own


def _groups(*columns: np.ndarray) -> np.ndarray:
    """First rows of the groups of equal values in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _owned(anchor: np.ndarray, own: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merges equal slices: (anchor, slice, least document, different slices of
    the anchor) and (document, slice) of the others, which match whole."""
    order = np.lexsort((doc, own, anchor))
    anchor, own, doc = anchor[order], own[order], doc[order]
    first = _groups(anchor, own)
    least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
    other = doc > least
    a = anchor[first]
    at = _groups(a)
    sizes = np.diff(np.append(at, len(a)))
    return a, own[first], doc[first], np.repeat(sizes, sizes), doc[other], own[other]


def _folded(column: np.ndarray, width: int) -> np.ndarray:
    """A column's lower bytes one after the other: columns that are sorted or hold
    small numbers compress better so."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8)[:, :width].T.ravel()


def _unfolded(folded: np.ndarray, kind: type, width: int) -> np.ndarray:
    out = np.zeros((len(folded) // width, 8), np.uint8)
    out[:, :width] = folded.reshape(width, -1).T
    return out.view(kind).ravel()


def _columns(payload: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """The folded columns of a page by their kinds and widths."""
    (body,) = unpacked(payload, "u1")
    n, at, out = len(body) // sum(width for _, width in kinds), 0, []
    for kind, width in kinds:
        out.append(_unfolded(body[at : at + n * width], kind, width))
        at += n * width
    return out


#: Columns of the pages: anchor, slice, document; and document, slice, how.
ENTRY = (np.uint64, ANCHOR), (np.uint64, HASH), (np.int64, 8)
KNOWN = (np.int64, 8), (np.uint64, HASH), (np.int64, 1)


def _pages(spark_buckets: int, limit: int):
    """Slices of the texts as packed rows (bucket, kind, payload)."""
    names = ["bucket", "kind", "payload"]

    def flush(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, own, doc, kinds, full_doc, full_own = _owned(*map(np.concatenate, zip(*found)))
        hot = kinds > limit
        rows = []

        def deal(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> None:
            order = np.argsort(bucket, kind="stable")
            bucket, columns = bucket[order], [c[order] for c in columns]
            at = _groups(bucket)
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(bucket)]):
                folded = [_folded(c[i:j], width) for c, (_, width) in zip(columns, KNOWN if kind else ENTRY)]
                rows.append((int(bucket[i]), kind, packed(*folded)))

        flags = np.unique(a[hot])
        keys = np.concatenate((a[~hot], flags))
        n = np.uint64(spark_buckets)
        deal(0, (keys % n).astype(np.int64), keys // n, np.concatenate((own[~hot], np.zeros(len(flags), np.uint64))),
             np.concatenate((doc[~hot], np.full(len(flags), FLAG))))
        # what is known already goes the same way, dealt by document
        docs, owns = np.concatenate((full_doc, doc[hot])), np.concatenate((full_own, own[hot]))
        how = np.concatenate((np.full(len(full_doc), FULL, np.int64), np.full(int(hot.sum()), STRINGS, np.int64)))
        deal(1, (mix(docs.view(np.uint64)) % np.uint64(spark_buckets)).astype(np.int64), docs, owns, how)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        found, total = [], 0
        for batch in parts(batches, "__text", 4 * CHUNK):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            text, _, _, anchor, own = sliced(bytes_of(batch.column(1)))
            found.append((anchor, own, ids[text].astype(np.int64)))
            total += len(anchor)
            if total > FLUSH:
                yield flush(found)
                found, total = [], 0
        if total:
            yield flush(found)

    return run


MARKS = "doc_id long, slice long, how int"


def _shared(limit: int):
    """What a bucket knows of each (document, slice): matched whole, or to be
    matched against the anchor's other slices, or string by string where the
    anchor is flagged or has more than ``limit`` different slices in all."""

    def run(group):
        docs, owns, how = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        entries = []
        for kind, payload in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist()):
            if kind:
                for out, part in zip((docs, owns, how), _columns(payload, *KNOWN)):
                    out.append(part)
            else:
                entries.append(_columns(payload, *ENTRY))
        if entries:
            anchor, own, doc = map(np.concatenate, zip(*entries))
            flagged = np.unique(anchor[doc == FLAG])
            real = doc != FLAG
            a, o, d, n, full_doc, full_own = _owned(anchor[real], own[real], doc[real])
            hot = np.isin(a, flagged) | (n > limit)
            open_ = hot | (n > 1)
            docs += [full_doc, d[open_]]
            owns += [full_own, o[open_]]
            how += [np.full(len(full_doc), FULL, np.int64), np.where(hot, STRINGS, CLOSE)[open_]]
        columns = [np.concatenate(docs), np.concatenate(owns).view(np.int64), np.concatenate(how).astype(np.int32)]
        return pa.table(columns, names=["doc_id", "slice", "how"])

    return run


def marks(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, slice, how) of all slices that may match, from (doc_id, __text)."""
    n = buckets(docs.sparkSession)
    dealt = docs.filter("doc_id IS NOT NULL AND octet_length(__text) >= %d" % SPAN).mapInArrow(_pages(n, hot), "bucket long, kind int, payload binary")
    return saved(dealt.groupBy("bucket").applyInArrow(_shared(4 * hot), MARKS), "slices")


def sorted_out(docs: DataFrame, ids: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the ids, the other rows).  The bitmap has one
    place per hash of an id; its pages, never more than ``BITMAP`` bits, are
    broadcast."""
    place = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(BITMAP))
    page, bits, at = (fresh_name(docs, c) for c in ("__page", "__bits", "__at"))
    pages = saved(ids.select(place.alias("p")).groupBy((F.col("p") / PAGE).cast("int").alias(page))
                  .agg(F.bitmap_construct_agg(F.col("p") % PAGE).alias(bits)), "bitmap")
    found = docs.withColumns({page: (place / PAGE).cast("int"), at: (place % PAGE).cast("int")}).join(F.broadcast(pages), page, "left")
    hit = F.coalesce(F.expr(f"shiftright(conv(hex(substring(`{bits}`, shiftright(`{at}`, 3) + 1, 1)), 16, 10)::int, `{at}` & 7) & 1") == 1, F.lit(False))
    return found.filter(hit).select(*docs.columns), found.filter(~hit).select(*docs.columns)


def _bodies(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[tuple]:
    """(document, key, slice, shift, bytes) that the indexes need."""
    ids, slices, hows = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
    text, lo, count, anchor, own = sliced(texts)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    for i, doc in enumerate(ids):
        a, b = bounds[i], bounds[i + 1]
        wanted = dict(zip(slices[i], hows[i]))
        for at, n, key, s in zip(lo[a:b].tolist(), count[a:b].tolist(), anchor[a:b].view(np.int64).tolist(), own[a:b].view(np.int64).tolist()):
            how = wanted.pop(s, FULL)
            if how == CLOSE:
                yield doc, key, s, 0, texts[i][at : at + n + SPAN - 1]
            elif how == STRINGS:
                for j in range(n):
                    string = texts[i][at + j : at + j + SPAN]
                    yield doc, int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True), s, j, string


BODIES = "doc_id long, key long, slice long, shift int, body binary, found long"


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes for the indexes.  Single strings that a smaller document of the
    batch has too are settled here (``found``) and not sent."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
    names = BODIES.replace(",", "").split()[::2]
    released()
    for batch in parts(batches, "__text", 4 * CHUNK):
        texts = bytes_of(batch.column(1))
        rows, least = [], {}
        for row in _bodies(batch, texts):
            rows.append(row)
            if len(row[4]) == SPAN:
                least[row[4]] = min(row[0], least.get(row[4], row[0]))
        rows = [(*r[:4], None, 1 << r[3]) if len(r[4]) == SPAN and least[r[4]] < r[0] else (*r, None) for r in rows]
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)


def _matched(group):
    """Places of a bucket's bodies that match a smaller document, as bits."""
    bodies = group.column("body").to_pylist()
    doc, own, shift = (group.column(c).to_numpy() for c in ("doc_id", "slice", "shift"))
    index = RunLengthIndex(bodies, doc, SPAN)
    text, place, least = index.matching()
    hit = least < doc[text]
    mask = np.zeros(len(bodies), np.int64)
    np.bitwise_or.at(mask, text[hit], np.int64(1) << place[hit])
    mask <<= shift
    some = mask != 0
    return pa.table([doc[some], own[some], mask[some]], names=["doc_id", "slice", "mask"])


FOUND = "doc_id long, slice long, mask long"


def matches(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, slice, mask): the strings of a slice, by bit, that a smaller
    document has too; -1 for all.  ``docs`` has doc_id and __text.  What a step
    has shuffled and written goes as soon as the next one has its own."""
    spark = docs.sparkSession
    known = marks(docs, hot)
    swept(spark)
    near = known.filter(F.col("how") != FULL)
    wanted = near.groupBy("doc_id").agg(F.collect_list("slice").alias("slices"), F.collect_list("how").alias("hows"))
    some, _ = sorted_out(docs, near.select("doc_id"), "doc_id")
    bodies = saved(some.join(wanted, "doc_id").select("doc_id", "__text", "slices", "hows").mapInArrow(_extract, BODIES), "bodies")
    swept(spark)
    n = buckets(spark, 4)
    sent = bodies.filter("body IS NOT NULL").withColumn("bucket", F.pmod(F.col("key"), F.lit(n)))
    found = sent.select("bucket", "doc_id", "slice", "shift", "body").groupBy("bucket").applyInArrow(_matched, FOUND)
    settled = bodies.filter("found IS NOT NULL").select("doc_id", "slice", F.col("found").alias("mask"))
    whole = known.filter(F.col("how") == FULL).select("doc_id", "slice", F.lit(-1).cast("long").alias("mask"))
    out = whole.unionByName(saved(found.unionByName(settled), "matches"))
    dropped(bodies)
    swept(spark)
    return out


def _remove(body: bytes, own: list[int], masks: list[int], found: tuple[np.ndarray, ...]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal runs removed)."""
    lo, count, slices = found
    order = np.argsort(np.array(own, np.int64), kind="stable")
    keys, bits = np.array(own, np.int64)[order], np.array(masks, np.int64)[order]
    at = _groups(keys)
    keys, bits = keys[at], np.bitwise_or.reduceat(bits, at)
    place = np.minimum(np.searchsorted(keys, slices), len(keys) - 1)
    mask = np.where(keys[place] == slices, bits[place], 0)
    hit = np.flatnonzero(mask)
    strings = np.arange(SPAN - GRAM + 1)
    on = (mask[hit, None] >> strings & 1).astype(bool) & (strings < count[hit, None])
    starts = (lo[hit, None] + strings)[on]
    if not len(starts):
        return body, 0, 0
    edge = np.zeros(len(body) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + SPAN, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(body, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str | None = None, hot: int = HOT) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep``
    "bytes" or "text", the bytes left as ``kept``: as they are, or as text
    without the bytes of characters that were cut apart.  Other columns of these
    names must not exist."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    found = matches(own, hot)
    taken = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("slice").alias("__slices"), F.collect_list("mask").alias("__masks"))
    some, rest = sorted_out(docs, found.select(F.col("doc_id").alias(doc_id)), doc_id)
    joined = some.join(taken, F.col(doc_id).cast("long") == F.col("__id"), "left").drop("__id")

    def apply(texts: pa.Array, slices: pa.Array, masks: pa.Array) -> list[pa.Array]:
        bodies, out = bytes_of(texts), []
        some = [i for i, s in enumerate(slices.is_valid().to_pylist()) if s]
        text, lo, count, _, hashes = sliced([bodies[i] for i in some])
        bounds = np.searchsorted(text, np.arange(len(some) + 1)).tolist()
        mine = {i: (lo[a:b], count[a:b], hashes[a:b].view(np.int64)) for i, a, b in zip(some, bounds, bounds[1:])}
        for i, body in enumerate(bodies):
            left, gone, runs = _remove(body, slices[i].as_py(), masks[i].as_py(), mine[i]) if i in mine and len(mine[i][0]) else (body, 0, 0)
            out.append((len(body), gone, runs, hashlib.sha256(left).hexdigest(), left if keep == "bytes" else left.decode("utf-8", "ignore")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary() if keep == "bytes" else pa.string()][: 5 if keep else 4]
        return [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]

    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.BinaryType() if keep == "bytes" else T.StringType())] if keep else []
    done = append(joined, [text, "__slices", "__masks"], apply, fields).drop("__slices", "__masks")
    whole = F.coalesce(F.col(text), F.lit(""))
    clean = {"n_bytes": F.octet_length(whole).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"),
             "kept_sha256": F.sha2(whole.cast("binary"), 256)}
    clean |= {"kept": whole.cast("binary") if keep == "bytes" else whole} if keep else {}
    return done.unionByName(rest.withColumns(clean))


def cleaned(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents with what is left as their texts and n_chars to match, other
    columns as they were.  Null texts stay null."""
    own = {c: fresh_name(docs, "__own_" + c) for c in docs.columns if c.lower() in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    out = deduplicated(docs.withColumnsRenamed(own), own.get(doc_id, doc_id), keep="text")
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    back = {v: k for k, v in own.items()}
    return out.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").withColumnsRenamed(back).select(*docs.columns)
