"""Language-model scores from a log-frequency Bloom filter.

The model is a word bigram interpolated with the smoothed unigram:

    P(w | v) = LAMBDA * c'(vw) / c(v) + (1 - LAMBDA) * (c(w) + 1) / (N + V + 1)

``c'(vw)`` is the bigram's count as the filter holds it: rounded down to
``least * 2**(q - 1)``, with the entries (vw, 1) .. (vw, q) put in.  A lookup
probes (vw, 1), (vw, 2), ... until one is missing.  Rounding down keeps the sum
over ``w`` at most 1 (but for the filter's false positives).  A context seen less
than ``least`` times can't have a bigram in the filter and uses the unigram alone;
as ``LEAST`` is 1, that is one that no training document has.

Every bigram of the training documents is counted, and the filter holds them all,
those seen once too (``LEAST`` is 1), in ``BITS_EACH`` bits per training token,
which is at least that per entry.  It is cut into pages by the bigram's
hash and grows with the corpus, so it is never in one place: each block of tokens
sends its distinct bigrams to the buckets of their pages; a bucket sums them,
builds its pages and answers every block with the levels that it finds there.

Unigram counts are exact and never broadcast.  Each task numbers the words of its
documents (a chunk), sums them and sends each word once to its bucket; the bucket
sums over chunks and answers each chunk with the counts of its own words.  The
numbered chunks are written once and scored from there.

Defined cases: null and empty texts have the end token alone; without training
documents every count is 0; repeated rows count and are scored each; a null id
counts as an empty one for the split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buckets, bytes_of, coded, id_remainder, mix, packed, parts, saved, unpacked, word_hashes

#: Chosen on training documents alone (those with remainder 3 scored by the others).
LAMBDA = 0.4
LEAST = 1
BITS_EACH = 12
BUILD_BITS = 1 << 24
#: The filter has 2 ** 12 pages, or as many as there are buckets.
PAGE_LOG = 12
PROBES = 6
CHUNK = 12 << 20
BLOCK = 1 << 20
END = b" "
SALT = np.uint64(0x9E3779B97F4A7C15)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * SALT + word)


def _page(keys: np.ndarray, page_log: int) -> np.ndarray:
    """A key's page, of ``2 ** page_log``: its first bits."""
    return (keys >> np.uint64(64 - page_log)).astype(np.int64)


class LogFrequencyFilter:
    """Quantised counts by repeated membership probes; ``bits`` starts with page
    ``first``."""

    def __init__(self, bits: np.ndarray, page_bits: int, least: int, first: int = 0, page_log: int = PAGE_LOG):
        self.bits, self.page_bits, self.least, self.first, self.page_log = bits, page_bits, least, first, page_log

    @staticmethod
    def places(keys: np.ndarray, level: int | np.ndarray, page_bits: int, page_log: int) -> Iterator[np.ndarray]:
        """Bit numbers of an entry's probes, all within the key's page."""
        x = mix(keys + np.asarray(level, np.uint64) * SALT)
        base = _page(keys, page_log) * page_bits
        step = (x >> np.uint64(32)) | np.uint64(1)
        for _ in range(PROBES):
            yield base + (x & np.uint64(page_bits - 1)).astype(np.int64)
            x = x + step

    @staticmethod
    def levels(counts: np.ndarray, least: int) -> np.ndarray:
        """How many entries a count has (0 below ``least``)."""
        return np.where(counts >= least, np.log2(np.maximum(counts // least, 1)).astype(np.int64) + 1, 0)

    @classmethod
    def page_bytes(cls, keys: np.ndarray, counts: np.ndarray, page_bits: int, least: int, page_log: int = PAGE_LOG) -> dict[int, bytes]:
        """The pages that hold the keys, all of whose keys must be given."""
        level = cls.levels(counts, least)
        keys, level = keys[level > 0], level[level > 0]
        pages = np.unique(_page(keys, page_log))
        bits = np.zeros((len(pages), page_bits), bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            for at in cls.places(keys[level >= q], q, page_bits, page_log):
                bits[np.searchsorted(pages, at // page_bits), at % page_bits] = True
        return dict(zip(pages.tolist(), (row.tobytes() for row in np.packbits(bits, axis=1, bitorder="little"))))

    def found(self, keys: np.ndarray) -> np.ndarray:
        """The level that each key is held with, 0 if it isn't."""
        level, live, q = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        while len(live):
            q += 1
            probe = self.places(keys[live], q, self.page_bits, self.page_log)
            held = np.arange(len(live))
            for at in probe:
                at = at[held] - self.first * self.page_bits
                held = held[(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
                if not len(held):
                    break
            live = live[held]
            level[live] = q
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count that each key is held with, 0 if it isn't."""
        return rounded(self.found(keys), self.least)


def rounded(level: np.ndarray, least: int) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(level > 0, least << np.maximum(level.astype(np.int64) - 1, 0), 0)


NUMBERED = "chunk long, ids array<long>, held array<boolean>, sizes array<int>, codes binary, words binary, counts binary"


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents as numbered words, frequent words first; the end of a
    text is a word, too.  ``counts`` are those in training documents."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    names = ["chunk", "ids", "held", "sizes", "codes", "words", "counts"]
    chunk = TaskContext.get().partitionId() << 32
    ids, held, codes, words, size = [], [], [], {END: 0}, 0

    def row() -> pa.RecordBatch:
        every = np.concatenate(codes)
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        train = np.repeat(~np.array(held, bool), sizes)
        total = np.bincount(every, minlength=len(words))
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        counts = np.bincount(every[train], minlength=len(words))[order]
        values = [chunk, ids, held, sizes.tolist(), packed(rank[every].astype(np.uint32)), packed(word_hashes(words)[order]), packed(counts)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in parts(batches, "__text", 2 << 20):
        for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))):
            ids.append(doc)
            held.append(out)
            codes.append(np.append(coded(text.translate(LOWER).split(), words), 0))
            size += len(text) + 64
        if size >= CHUNK:
            yield row()
            chunk += 1
            ids, held, codes, words, size = [], [], [], {END: 0}, 0
    if ids:
        yield row()


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Stable order by bucket, and each bucket's (number, first, stop)."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]))


def _words_out(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                words, counts = unpacked(words, "u8")[0], unpacked(counts, "i8")[0]
                order, dealt = _by_bucket((words % np.uint64(n)).astype(np.int64))
                rows = [(b, chunk, packed(words[order[i:j]], counts[order[i:j]])) for b, i, j in dealt]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                                                 names=["bucket", "chunk", "payload"])

    return run


ANSWERS = "chunk long, bucket long, payload binary, kinds long, tokens long"


def _answer(group):
    """Each chunk's words of the bucket with their counts over all chunks; one
    row more (chunk -1) has the bucket's distinct words and tokens."""
    chunks, bucket = group.column("chunk").to_pylist(), group.column("bucket")[0].as_py()
    found = [unpacked(p, "u8", "i8") for p in group.column("payload").to_pylist()]
    words, place = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, place, np.concatenate([c for _, c in found]))
    stops = np.cumsum([len(w) for w, _ in found])
    answers = [packed(total[part]) for part in np.split(place, stops[:-1])]
    n = len(chunks)
    return pa.table([pa.array([*chunks, -1]), pa.array([bucket] * (n + 1)), pa.array([*answers, None], pa.binary()),
                     pa.array([0] * n + [int((total > 0).sum())]), pa.array([0] * n + [int(total.sum())])],
                    names=["chunk", "bucket", "payload", "kinds", "tokens"])


def _blocks(codes: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first token, codes before, codes) of each block of a chunk; a text starts
    after the end of the one before."""
    end = int(np.flatnonzero(words == word_hashes([END])[0])[0])
    for at in range(0, len(codes), BLOCK):
        own = codes[at : at + BLOCK]
        yield at, np.concatenate((codes[at - 1 : at] if at else [end], own[:-1])).astype(np.int64), own


ASKED = "bucket long, chunk long, place long, payload binary"


def _pairs_asked(n: int, page_log: int):
    """Each block's distinct bigrams in the order of their keys, with their counts
    in training documents, by bucket; a bucket has consecutive pages.  ``place``
    orders the parts of a chunk."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held, sizes, codes, words in zip(*(c.to_pylist() for c in batch.columns)):
                train = np.repeat(~np.array(held, bool), sizes)
                codes, words = unpacked(codes, "u4")[0], unpacked(words, "u8")[0]
                for at, before, own in _blocks(codes, words):
                    keys, place = np.unique(pair_keys(words[before], words[own]), return_inverse=True)
                    counts = np.bincount(place[train[at : at + BLOCK]], minlength=len(keys)).astype(np.uint32)
                    _, dealt = _by_bucket(_page(keys, page_log) * n >> page_log)
                    columns = [[b for b, _, _ in dealt], [chunk] * len(dealt), [at // BLOCK * n + b for b, _, _ in dealt],
                               [packed(keys[i:j], counts[i:j]) for _, i, j in dealt]]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "chunk", "place", "payload"])

    return run


def _levels(keys: np.ndarray, counts: np.ndarray, page_bits: int, least: int, page_log: int) -> np.ndarray:
    """The level of each of the sorted distinct keys in the filter's pages, which
    are built from them, ``BUILD_BITS`` or one page at a time."""
    pages = _page(keys, page_log)
    out, step = np.zeros(len(keys), np.uint8), max(1, BUILD_BITS // page_bits)
    for first in range(int(pages[0]), int(pages[-1]) + 1, step):
        i, j = np.searchsorted(pages, (first, first + step))
        if i < j:
            bits = np.zeros(step * page_bits // 8, np.uint8)
            for page, body in LogFrequencyFilter.page_bytes(keys[i:j], counts[i:j], page_bits, least, page_log).items():
                bits[(page - first) * page_bits // 8 : (page - first + 1) * page_bits // 8] = np.frombuffer(body, np.uint8)
            out[i:j] = LogFrequencyFilter(bits, page_bits, least, first, page_log).found(keys[i:j])
    return out


def _pairs_answered(page_bits: int, least: int, page_log: int):
    """Each part's bigrams with their levels in the filter over all chunks."""
    def run(group: pa.Table) -> pa.Table:
        found = [unpacked(p, "u8", "u4") for p in group.column("payload").to_pylist()]
        stops = np.cumsum([len(k) for k, _ in found])
        keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
        del found
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = np.flatnonzero(new)
        level = np.empty(len(keys), np.uint8)
        level[order] = _levels(keys[first], np.add.reduceat(counts, first), page_bits, least, page_log)[np.cumsum(new) - 1]
        return pa.table([group.column("chunk"), group.column("place"), pa.array([packed(x) for x in np.split(level, stops[:-1])], pa.binary())],
                        names=["chunk", "place", "payload"])

    return run


def pair_levels(numbered: DataFrame, tokens: int, least: int) -> DataFrame:
    """(chunk, place, payload): the levels of each chunk's bigrams, answered by the
    filter over the ``tokens`` tokens of the training documents."""
    n = buckets(numbered.sparkSession)
    page_log = max(PAGE_LOG, (n - 1).bit_length())
    # a count has no more levels than occurrences
    page_bits = max(64, 1 << (tokens * BITS_EACH >> page_log).bit_length())
    asked = numbered.select("chunk", "held", "sizes", "codes", "words").mapInArrow(_pairs_asked(n, page_log), ASKED)
    return saved(asked.groupBy("bucket").applyInArrow(_pairs_answered(page_bits, least, page_log), "chunk long, place long, payload binary"), "lm-levels")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(n: int, pair_n: int, tokens: int, kinds: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, sizes, codes, words, answers, levels in zip(*(c.to_pylist() for c in batch.columns)):
                codes, words = unpacked(codes, "u4")[0], unpacked(words, "u8")[0]
                order, dealt = _by_bucket((words % np.uint64(n)).astype(np.int64))
                counts = np.zeros(len(words), np.int64)
                for bucket, i, j in dealt:
                    counts[order[i:j]] = unpacked(answers[bucket], "i8")[0]
                plain = (counts + 1) / (tokens + kinds + 1)
                log = np.log10(plain)
                first = np.cumsum(sizes) - sizes
                score = np.empty(len(codes))
                for at, before, own in _blocks(codes, words):
                    keys = pair_keys(words[before], words[own])
                    own_levels = [unpacked(x["payload"], "u1")[0] for x in levels if x["place"] // pair_n == at // BLOCK]
                    pair = rounded(np.concatenate(own_levels), LEAST)[np.unique(keys, return_inverse=True)[1]]
                    seen = counts[before]
                    two = np.minimum(pair, seen) / np.maximum(seen, 1)
                    p = plain[own]
                    score[at : at + BLOCK] = np.log10(np.where(seen >= LEAST, LAMBDA * two + (1 - LAMBDA) * p, p))
                columns = [ids, held, sizes, np.add.reduceat((counts > 0)[codes].astype(np.int64), first),
                           np.add.reduceat(log[codes], first), np.add.reduceat(score, first)]
                kinds_ = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_)], names=SCORES.replace(",", "").split()[::2])

    return run


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (the unigram alone) and score (the model), log10 of the text's
    probability."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).select("doc_id", (id_remainder(7) == 2).alias("held"), "__text")
    numbered = saved(own.mapInArrow(_number, NUMBERED), "lm-chunks")
    n = max(1, buckets(spark) // 4)
    sent = numbered.select("chunk", "words", "counts").mapInArrow(_words_out(n), "bucket long, chunk long, payload binary")
    answers = saved(sent.groupBy("bucket").applyInArrow(_answer, ANSWERS), "lm-answers")
    size = answers.filter("chunk = -1").agg(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens")).first()
    tokens, kinds = int(size["tokens"] or 0), int(size["kinds"] or 0)
    # a chunk's answers: one per bucket, as many bytes as its distinct words need
    by_chunk = answers.filter("chunk >= 0").groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "payload"))).alias("answers"))
    rows = numbered.drop("counts").join(by_chunk, "chunk").select("chunk", "ids", "held", "sizes", "codes", "words", F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda b: F.try_element_at("answers", b)).alias("answers"))
    levels = pair_levels(numbered, tokens, LEAST).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "payload"))).alias("levels"))
    out = rows.join(levels, "chunk").drop("chunk").mapInArrow(_scores(n, buckets(spark), tokens, kinds), SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
