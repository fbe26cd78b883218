"""Harmonic packing of tokenized documents into fixed-length sequences.

A length belongs to class ``k`` if ``k`` of it, and not ``k + 1``, fit a
sequence; a class's sequences hold exactly ``k`` pieces.  To leave little
padding a document is cut so that its pieces have the classes' full lengths
``capacity // k``: whole sequences first, then from the rest ``r`` the piece of
class ``ceil(capacity / r)``, until nothing is left (three or four pieces for
most documents, about 127 lengths in all).

Workers fill classes without talking to each other: each task numbers its own
pieces per class, and only the counts per (task, class) are summed into each
task's first number.  Piece ``i`` of a class lies in the class's sequence
``i // k`` at ``(i % k) * length``.  The fewer than ``k`` last pieces of each
class (at most some 19,000 for capacity 4096, whatever the data) are packed
together first-fit, longest first.

Ids come from the public tokenizer.  Texts of ``LATIN`` characters alone are cut
at once by its own pattern; of others, which it splits at white space before
anything else, the parts between spaces are taken.  Either are encoded once each
and kept in bounded caches per worker.

Defined cases: null and empty texts have the end token alone; repeated rows are
packed each; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import held, parts, saved, tokenizer_path

FILE = "word_bpe_49k.json"
CAPACITY = 4096
END = 2
#: Words and bytes that a worker's caches hold at most, and parts of other texts.
CACHE = 1_000_000
CACHE_BYTES = 160 << 20
PARTS = 240_000
CHUNK = 2 << 20
#: ASCII punctuation but the apostrophe, which begins endings of its own.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters of composed form that lower-case one by one, to letters up to U+017F.
LATIN = "\t\n\r -~¡§°¿«»À-\u012f\u0131-\u017f‐-‧€"
#: The tokenizer's pattern for lower-cased text of these characters.
LETTERS = "a-zß-öø-\u017f"
CUT = f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t\n\r 0-9{LETTERS}]+"


class Kept:
    """A bounded map that keeps what was asked for lately: when the young half is
    full, in entries or in bytes, it becomes the old half, and what is still used
    moves back."""

    def __init__(self, size: int, most_bytes: int):
        self.size, self.most_bytes, self.bytes, self.young, self.old = size, most_bytes, 0, {}, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The distinct keys that aren't held; the others are made young."""
        new = set(keys).difference(self.young)
        back = list(new.intersection(self.old))
        if back:
            self.add(back, list(map(self.old.__getitem__, back)))
            new.difference_update(back)
        return list(new)

    def add(self, keys: list[str], values: list[bytes]) -> None:
        self.bytes += sum(map(len, keys)) + sum(map(len, values))
        self.young.update(zip(keys, values))

    def turn(self) -> None:
        """To be called between batches."""
        if len(self.young) > self.size // 2 or self.bytes > self.most_bytes // 2:
            self.old, self.young, self.bytes = self.young, {}, 0


class Ids:
    """Token ids (little-endian 32-bit) of whole texts by the public tokenizer.

    Texts of ``LATIN`` characters without special tokens are lower-cased and cut
    as the tokenizer does.  In other texts, a part between spaces that is letters within ASCII punctuation has the ids of
    its punctuation and its letters in turn, since the tokenizer's pattern cuts
    there.  Lower-cased letters in composed form need no normalisation; they are
    encoded many at a time and told apart by their ends, which the vocabulary
    marks.  Any other part goes through the tokenizer as it is."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for b, c in enumerate(byte_letters()) if b != 32}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.strange, self.words = re.compile(f"[^{LATIN}]|<\\|").search, re.compile(CUT).findall
        self.cache, self.known, self.rest = (Kept(n, CACHE_BYTES * n // CACHE) for n in (min(cache * 3 // 5, PARTS), cache, min(cache // 8, PARTS // 4)))

    def runs(self, words: list[str]) -> list[bytes]:
        """Ids of lower-cased runs of letters in composed form, or of other words
        that the tokenizer's pattern cuts from such text."""
        out = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            line = " ".join(part).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.plain.encode_batch_fast([line.split(" ")], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(part):  # letters that the pattern doesn't take for one run
                out += self.whole(part)
                continue
            body, stops = ids.tobytes(), stops.tolist()
            out += [body[i:j] for i, j in zip([0, *stops], stops)]
        return out

    def whole(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def learn(self, parts: list[str]) -> None:
        plain, lows, mixed, before, cores, after = [], [], [], [], [], []
        for p in parts:
            if p.isalpha():  # no punctuation to look for
                low = p.lower()
                if p.isascii() or "\u03a3" not in p and low.isalpha() and is_normalized("NFC", low):
                    plain.append(p)
                    lows.append(low)
                    continue
            core = p.strip(PUNCTUATION)
            low = core.lower()
            # lower() knows final sigmas, the tokenizer doesn't; special tokens stay whole
            if low.isalpha() and (low.isascii() or "\u03a3" not in core and is_normalized("NFC", low)) and "<|" not in p:
                at = p.index(core)
                before.append(p[:at])
                cores.append(low)
                after.append(p[at + len(core) :])
            else:
                before.append(p)
                cores.append("")
                after.append("")
            mixed.append(p)
        known = self.known
        new = [x for x in known.missing(chain(lows, cores)) if x]
        known.add([""], [b""])
        known.add(new, self.runs(new))
        rest = self.rest.missing(chain(before, after))
        self.rest.add(rest, self.whole(rest))
        ids, other = known.young.__getitem__, self.rest.young.__getitem__
        self.cache.add(plain, list(map(ids, lows)))
        self.cache.add(mixed, [x + y + z for x, y, z in zip(map(other, before), map(ids, cores), map(other, after))])
        known.turn()
        self.rest.turn()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.strange(t) else self.words(t.lower()) for t in texts]
        others = [i for i, ws in enumerate(cut) if ws is None]
        known = self.known
        new = known.missing(chain.from_iterable(ws for ws in cut if ws))
        known.add(new, self.runs(new))
        ids = known.young.__getitem__
        out = [b"".join(map(ids, ws)) if ws else b"" for ws in cut]
        known.turn()
        for i, body in zip(others, self.by_parts([texts[i] for i in others])):
            out[i] = body
        return out

    def by_parts(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(self.cache.missing(chain.from_iterable(cut)))
        young = self.cache.young
        out = [b"".join(map(young.__getitem__, ps)) for ps in cut]
        self.cache.turn()
        return out


def ids_of(path: str, cache: int = CACHE) -> Ids:
    """This worker's tokenizer and caches; another operator's tasks drop them."""
    return held(("packing", path, cache), lambda: Ids(path, cache))


def cuts(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, each ``capacity // k`` for some ``k``."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, nth long"


def pieces(docs: DataFrame, file: str, capacity: int, end: int, doc_id: str, text: str, cache: int = CACHE) -> DataFrame:
    """One row per piece, numbered per length within its task."""
    last = end.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, worker, counts = ids_of(tokenizer_path(file), cache), TaskContext.get().partitionId(), {}
        for batch in parts(batches, "__text", CHUNK):
            rows = []
            encoded = ids.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            for doc, body in zip(batch.column(0).to_pylist(), encoded):
                body += last
                tokens, start = len(body) // 4, 0
                for n in cuts(tokens, capacity):
                    nth = counts.get(n, 0)
                    counts[n] = nth + 1
                    rows.append((doc, start, n, zlib.crc32(body[4 * start : 4 * (start + n)]), tokens, worker, nth))
                    start += n
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=PIECES.replace(",", "").split()[::2])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")).mapInArrow(run, PIECES)


def first_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, given from the longest; a bin is found by the
    room left, kept per value."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, out, lowest = [], [], 0
    for n in sizes:
        room = next((r for r in range(n, capacity + 1) if rooms[r]), None) if lowest >= n else None
        if room is None:
            room = capacity
            rooms[room].append(len(used))
            used.append(0)
        at = rooms[room].pop()
        out.append((at, used[at]))
        used[at] += n
        rooms[room - n].append(at)
        lowest = max((r for r in range(capacity, -1, -1) if rooms[r]), default=0)
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, file: str = FILE, end: int = END,
           doc_id: str = "doc_id", text: str = "text", cache: int = CACHE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and padded_length, the length its sequence is padded to
    (its own if that is a power of two, else the capacity).  ``cache``: words that a
    worker remembers, at most."""
    spark = docs.sparkSession
    rows = saved(pieces(docs, file, capacity, end, doc_id, text, cache), "pieces")
    counts = rows.groupBy("length", "worker").agg(F.count("*").alias("n"))
    firsts = saved(counts.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("worker")) - F.col("n")), "firsts")
    # at most one row per class: about 2 * sqrt(capacity)
    totals = firsts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("length")).collect()
    classes, sequences = [], 0
    for r in totals:
        k = capacity // r["length"]
        classes.append((r["length"], k, r["n"] // k * k, sequences))
        sequences += r["n"] // k
    classes = spark.createDataFrame(classes, "length long, k long, whole long, base long")
    rows = rows.join(firsts.drop("n"), ["length", "worker"]).join(F.broadcast(classes), "length").withColumn("rank", F.expr("first + nth"))
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = rows.filter("rank < whole").select(*own, F.expr("base + rank DIV k").alias("sequence_id"),
                                             F.expr("rank % k * length").alias("offset"), F.lit(capacity).cast("long").alias("padded_length"))

    names = full.columns

    def together(group):
        order = np.lexsort([group.column(c).to_numpy() for c in ("rank", "length")])[::-1]
        group = group.take(order)
        sizes = group.column("length").to_numpy()
        bins, offsets = np.array(first_fit(sizes.tolist(), capacity), np.int64).reshape(-1, 2).T
        used = np.bincount(bins, sizes).astype(np.int64)
        pad = np.where(used & (used - 1) == 0, used, capacity)[bins]
        columns = [group.column(c) for c in own] + [pa.array(x) for x in (sequences + bins, offsets, pad)]
        return pa.table(columns, names=names)

    # fewer than k rows of each class, a number that the capacity alone bounds
    rest = rows.filter("rank >= whole").groupBy(F.lit(0).alias("all")).applyInArrow(together, full.schema)
    return full.unionByName(rest)
