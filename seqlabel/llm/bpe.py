"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

A word's adjacent pairs are the leaves of a segment tree whose nodes hold the
least (rank, position) below them, so the root names the leftmost pair of lowest
rank.  A merge changes three leaves (the pair, the one before, the one after),
each updated along one path; the word is done when the root is empty.  NumPy
runs the trees of a batch of distinct words side by side, one merge per word and
step.  A text is cut where a single space stands between two other characters;
no word of the pattern crosses such a place, so the pieces between are encoded
once each and kept in a bounded cache per worker.

Decoding joins the tokens' bytes and reads them as UTF-8 with replacement.

Defined cases: null and empty texts have no tokens; the file's special tokens
are found in the text first, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, held, tokenizer_path

FILE = "byte_bpe_50k.json"
CACHE = 400_000
NONE = np.uint64((1 << 64) - 1)

#: Unicode white space, written out because libraries differ over control characters.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes
    for themselves, the others counted up from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Rows:
    """Byte strings by number, and their concatenation for many numbers at once."""

    def __init__(self, rows: list[bytes]):
        self.body = np.frombuffer(b"".join(rows), np.uint8)
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, numbers: np.ndarray, counts: list[int]) -> list[bytes]:
        """One byte string for each of the consecutive groups of ``counts`` numbers."""
        sizes = self.sizes.take(numbers)
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts.take(numbers) - (ends - sizes), sizes)
        at += np.arange(len(at))
        body = self.body.take(at).tobytes()
        stops = np.concatenate(([0], ends))[np.cumsum(counts)].tolist() if len(numbers) else [0] * len(counts)
        return [body[a:b] for a, b in zip([0, *stops], stops)]


class Codec:
    """Tables of one tokenizer file, the encoder and the decoder."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, letters = file["model"]["vocab"], byte_letters()
        byte_of = {c: i for i, c in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocabulary.values(), *self.specials.values()]) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.as_bytes = Rows(self.token_bytes)
        self.as_decimal = Rows([b"%d," % i for i in range(len(self.token_bytes))])
        self.byte_id = np.array([vocabulary[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.made = keys[order], order.astype(np.uint64), made
        self.words = regex.compile(WORDS)
        self.lone = regex.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        spaces = regex.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001))))
        self.beside = [x for c in spaces for x in (f"{c} ", f" {c}")]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.cache: dict[str, bytes] = {}  # pieces
        self.known: dict[str, bytes] = {}  # words of the pattern

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(rank, position) of pairs as one number, ``NONE`` if they don't merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_rank[at] << np.uint64(32) | place.astype(np.uint64), NONE)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian 32-bit) of words of similar lengths, their
        trees run side by side.  Positions are places in flat arrays: a word has
        ``width`` symbols and two border cells that pair with nothing."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = 1 << max(1, int(sizes.max() - 1).bit_length())
        stride = width + 2
        grid = np.full((n, stride), -1, np.int64)
        grid[:, :width][np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        forest = np.full((n, 2 * width), NONE)
        place = np.tile(np.arange(width), (n, 1))
        forest[:, width:] = self.leaf(grid[:, :width].ravel(), grid[:, 1 : width + 1].ravel(), place.ravel()).reshape(n, width)
        step = width >> 1
        while step:
            forest[:, step : 2 * step] = np.minimum(forest[:, 2 * step : 4 * step : 2], forest[:, 2 * step + 1 : 4 * step : 2])
            step >>= 1
        base, trees = np.arange(n) * stride, np.arange(n) * (2 * width)
        ids, tree = grid.ravel(), forest.ravel()
        after = np.arange(n * stride) + 1
        before = np.arange(n * stride) - 1
        before[base] = base + width + 1
        while True:
            root = tree.take(trees + 1)
            live = root != NONE
            if not live.all():
                base, trees, root = base[live], trees[live], root[live]
            if not len(root):
                break
            at = (root & np.uint64(0xFFFFFFFF)).astype(np.int64)
            p = base + at
            q = after.take(p)
            token = self.made.take((root >> np.uint64(32)).astype(np.int64))
            ids[p], ids[q] = token, -1
            r, o = after.take(q), before.take(p)
            after[p], before[r] = r, p
            first = o - base
            own = self.leaf(token, ids.take(r), at)
            prior = self.leaf(ids.take(o), token, first)
            border = first > width
            spot = np.concatenate((at, q - base, np.where(border, at, first))) + width
            which = np.concatenate((trees, trees, trees))
            tree[which + spot] = np.concatenate((own, np.full(len(own), NONE), np.where(border, own, prior)))
            for _ in range(width.bit_length() - 1):
                spot >>= 1
                below = which + 2 * spot
                tree[which + spot] = np.minimum(tree.take(below), tree.take(below + 1))
        kept = grid >= 0
        flat = grid[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words, grouped by length so that trees stay full."""
        out, classes = {}, {}
        for w in words:
            classes.setdefault((len(w) - 1).bit_length(), []).append(w)
        for size, group in classes.items():
            step = max(1, (1 << 17) >> size)
            for a in range(0, len(group), step):
                part = group[a : a + step]
                out.update(zip(part, self.merged(part)))
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces into the cache."""
        if len(self.cache) + len(pieces) > CACHE:
            self.cache.clear()
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        cut = [self.words.findall(p) for p in pieces]
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in known]
        coded = [w.encode("utf-8", "replace") for w in new]
        ids = self.encode_words(list(dict.fromkeys(coded)))
        known.update(zip(new, map(ids.__getitem__, coded)))
        self.cache.update((p, b"".join(map(known.__getitem__, ws))) for p, ws in zip(pieces, cut))

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that encode apart from each other: cut before each
        single space that stands between two characters that are not space."""
        if text[0] == " " or text[-1] == " " or any(c in text for c in self.beside):
            ends = [m.start() for m in self.lone.finditer(text)]
            return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each whole text."""
        split = []
        for text in texts:
            if self.special and self.special.search(text):
                parts, at = [], 0
                for m in self.special.finditer(text):
                    parts += [self.pieces(text[at : m.start()]) if m.start() > at else [], self.specials[m[0]]]
                    at = m.end()
                split.append([*parts, self.pieces(text[at:]) if at < len(text) else []])
            else:
                split.append([self.pieces(text) if text else []])
        cache = self.cache
        every = dict.fromkeys(chain.from_iterable(ps for parts in split for ps in parts if not isinstance(ps, int)))
        new = [p for p in every if p not in cache]
        if len(cache) + len(new) > CACHE:  # learn() starts anew then
            new = list(every)
        self.learn(new)
        return [np.frombuffer(b"".join(ps.to_bytes(4, "little") if isinstance(ps, int) else b"".join(map(cache.__getitem__, ps)) for ps in parts), "<u4")
                for parts in split]

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each id sequence."""
        return [x.decode("utf-8", "replace") for x in self.as_bytes.joined(np.concatenate(ids), list(map(len, ids)))]

    def decimals(self, ids: list[np.ndarray]) -> list[bytes]:
        """Each id sequence in decimal, joined by commas."""
        return [x[:-1] for x in self.as_decimal.joined(np.concatenate(ids), list(map(len, ids)))]


def codec(path: str) -> Codec:
    return held(("bpe", path), lambda: Codec(path))


def encoded(docs: DataFrame, file: str = FILE, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and
    ids and decoded text with ``keep_ids``)."""
    def run(texts: pa.Array) -> list[pa.Array]:
        c, out = codec(tokenizer_path(file)), []
        values = [t or "" for t in texts.to_pylist()]
        for at in range(0, len(values), 256):
            ids = c.encode_batch(values[at : at + 256])
            for own, numbers, decoded in zip(ids, c.decimals(ids), c.decode_batch(ids)):
                row = (len(own), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append(row + ((own.tolist(), decoded) if keep_ids else ()))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()][: 5 if keep_ids else 3]
        return [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    return append(own, ["__text"], run, fields, holds=True).drop("__text")
