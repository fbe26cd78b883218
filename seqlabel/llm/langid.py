"""Language identification of mixed-language text.

A word is a run of letters.  Its score for a language is the summed log
probability of the letter trigrams centred on its letters (what is not a letter
counts as a space), smoothed over ``SLOTS`` hashed trigrams.  Before scoring, the
word's script narrows the candidates: a language competes only in scripts that
hold at least ``SCRIPT_SHARE`` of the letters it was learned from; in a script no
language was learned from, all compete.  A Viterbi pass over the words with a
penalty of ``SWITCH`` nats for changing the language labels spans.  NumPy
advances the passes of a batch of documents together, one word per step.

A document's language is the one with most letters in its spans (the
alphabetically first of equals), its score the share of its letters there.

The model has ``SLOTS + scripts`` counts per language, summed over all training
documents, and keeps every language that has letters: the table takes 256 KB a
language, the counts reach the driver sparse, and texts are scored in parts that
are smaller the more languages there are.

Defined cases: a null text or one without letters is ``und`` with score 0, as is
every text when nothing was learned; documents without a language are not learned
from; repeated rows are learned from and predicted each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, id_remainder, mix, packed, parts, slices, unpacked

SLOTS = 1 << 16
SCRIPT_SHARE = 0.01
SWITCH = 12.0
SMOOTHING = 0.5
HELD = 64
RANGES = 16
CHUNK = 1 << 20
UNKNOWN = "und"

#: Blocks of Unicode by script, first and last code point.
SCRIPTS = [
    ("latin", [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("gurmukhi", [(0xA00, 0xA7F)]),
    ("gujarati", [(0xA80, 0xAFF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("telugu", [(0xC00, 0xC7F)]),
    ("kannada", [(0xC80, 0xCFF)]),
    ("malayalam", [(0xD00, 0xD7F)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]),
]
WIDTH = SLOTS + len(SCRIPTS) + 1


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its script (0: other)."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for i, (_, blocks) in enumerate(SCRIPTS):
        for first, last in blocks:
            script[first : last + 1] = i + 1
    return letter, script


def words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Per letter: trigram slot and script.  Per word: first letter and text."""
    letter, script = letters()
    body = " ".join(texts).lower() if texts else ""
    sizes = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    codes = np.frombuffer(f" {body} ".encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letter[codes]
    at = np.flatnonzero(is_letter)
    plain = np.where(is_letter, codes, 32).astype(np.uint64)
    key = plain[at - 1] << np.uint64(42) | plain[at] << np.uint64(21) | plain[at + 1]
    slot = (mix(key) >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(~is_letter[at - 1])
    text = np.searchsorted(np.cumsum(sizes), at[first] - 1, side="right")
    return slot, script[codes[at]], first, text


def learned(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, part, counts): trigram and script counts per language, cut into
    ``RANGES`` parts so that no task sums a whole language.  Each task sums its
    own documents first, over ``HELD`` languages at a time."""
    def rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        cut = [(x, i, packed(part)) for x, n in sorted(sums.items()) for i, part in enumerate(np.array_split(n, RANGES))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in cut], k) for i, k in enumerate((pa.string(), pa.int32(), pa.binary()))],
                                          names=["lang", "part", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in parts(batches, "__text", CHUNK):
            langs = batch.column(0).to_pylist()
            for own in sorted(set(langs)):
                slot, script, _, _ = words([t for t, x in zip(batch.column(1).to_pylist(), langs) if x == own and t])
                sums.setdefault(own, np.zeros(WIDTH, np.int64))
                sums[own][:SLOTS] += np.bincount(slot, minlength=SLOTS)
                sums[own][SLOTS:] += np.bincount(script, minlength=WIDTH - SLOTS)
                if len(sums) == HELD:
                    yield rows(sums)
                    sums = {}
        if sums:
            yield rows(sums)

    def add(key, group):
        total = None
        for blob in group.column("counts").to_pylist():
            n = unpacked(blob, "i8")[0]
            total = n.copy() if total is None else total + n
        return pa.table({"lang": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([packed(total)], pa.binary())})

    schema = "lang string, part int, counts binary"
    own = docs.select(F.col(lang).alias("lang"), F.col(text).alias("__text")).filter("lang IS NOT NULL AND __text IS NOT NULL")
    return own.mapInArrow(count, schema).groupBy("lang", "part").applyInArrow(add, schema)


class Model:
    """Log probabilities per slot and language, and each script's candidates, from
    each language's (places, counts) that aren't 0."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        seen = np.zeros(WIDTH, bool)
        for at, _ in counts.values():
            seen[at] = True
        # unseen slots share the smoothing of those seen in any language
        used = max(1, int(seen[:SLOTS].sum()))
        self.log = np.empty((SLOTS, len(self.langs)), np.float32)
        scripts = np.zeros((len(self.langs), WIDTH - SLOTS))
        for i, (at, n) in enumerate(counts[x] for x in self.langs):
            slot = at < SLOTS
            total = n[slot].sum() + SMOOTHING * (used + 1)
            self.log[:, i] = np.log(SMOOTHING / total)
            self.log[at[slot], i] = np.log((n[slot] + SMOOTHING) / total)
            scripts[i, at[~slot] - SLOTS] = n[~slot]
        allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed[:, ~allowed.any(0)] = True
        self.barred = np.where(allowed, 0, -1e6).astype(np.float32).T.copy()

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per word: its text, its first letter's number, its letters and the
        language that Viterbi gives it."""
        slot, script, first, text = words(texts)
        count = np.diff(np.append(first, len(slot)))
        if not len(first):
            return text, first, count, np.zeros(0, np.int64)
        score = np.empty((len(first), len(self.langs)), np.float32)
        bounds = [*range(0, len(first), (1 << 16) // self.width()), len(first)]
        for a, b in zip(bounds, bounds[1:]):
            stop = first[b] if b < len(first) else len(slot)
            score[a:b] = np.add.reduceat(self.log[slot[first[a] : stop]], first[a:b] - first[a], axis=0)
        score += self.barred[script[first]]
        return text, first, count, viterbi(score, np.bincount(text, minlength=len(texts)))

    def width(self) -> int:
        """By how much parts must be smaller than those of 16 languages."""
        return min(1 << 10, -(-len(self.langs) // 16))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        text, _, count, label = self.spans(texts)
        share = np.bincount(text * len(self.langs) + label, count, len(texts) * len(self.langs)).reshape(len(texts), -1)
        total = share.sum(1)
        best = share.argmax(1)
        names = [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), total.tolist())]
        return names, np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)


def viterbi(score: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row; ``sizes`` rows belong to each sequence."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes.max())), side="right")
    n = score.shape[1]
    back = np.empty(score.shape, np.min_scalar_type(n - 1))
    stay = np.arange(n)
    best = score[starts[: active[0]]].astype(np.float64)
    ends = np.empty(len(sizes), np.int64)
    for t in range(1, len(active)):
        k = active[t]
        if k < len(best):
            ends[k : len(best)] = best[k:].argmax(1)
            best = best[:k]
        top = best.argmax(1)
        jump = best[np.arange(k), top][:, None] - switch
        rows = starts[:k] + t
        back[rows] = np.where(best >= jump, stay, top[:, None])
        best = np.maximum(best, jump) + score[rows]
    ends[: len(best)] = best.argmax(1)
    label = np.empty(len(score), np.int64)
    state = ends[: active[0]]
    for t in range(len(active) - 1, -1, -1):
        rows = starts[: active[t]] + t
        label[rows] = state[: active[t]]
        if t:
            state[: active[t]] = back[rows, state[: active[t]]]
    return label


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model | None:
    """The model of the documents' languages, or None without any."""
    firsts = [int(part[0]) for part in np.array_split(np.arange(WIDTH), RANGES)]
    counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    # ``RANGES`` compressed rows per language
    for row in learned(docs, lang, text).collect():
        n = unpacked(bytes(row["counts"]), "i8")[0]
        at = np.flatnonzero(n)
        counts.setdefault(row["lang"], []).append((at + firsts[row["part"]], n[at]))
    whole = {x: tuple(map(np.concatenate, zip(*p))) for x, p in counts.items()}
    whole = {x: p for x, p in whole.items() if len(p[0])}
    return Model(whole) if whole else None


def with_language(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        names, scores = [], [np.zeros(0)]
        values = [t or "" for t in texts.to_pylist()]
        batch = pa.RecordBatch.from_arrays([texts], names=["t"])
        at = 0
        for part in slices(batch, np.fromiter(map(len, values), np.int64, len(values)), 4 * CHUNK // shared.value.width()):
            n, s = shared.value.predict(values[at : at + part.num_rows])
            at += part.num_rows
            names += n
            scores.append(s)
        return [pa.array(names, pa.string()), pa.array(np.concatenate(scores))]

    return append(docs, [text], run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identified(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(id_remainder(3) != 1), **options)
    out = with_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "lang_pred", "score")
