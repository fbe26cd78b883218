"""Verdicts on urls: host and path rules, then a weighted vocabulary.

A rule names a host and the start of a path (``example.org/es/``) and fits that
host and all its subdomains where the url's path starts with the rule's.  Rules
are held by host; a url looks up the suffixes of its host, so their number
doesn't slow a row down.  The longest fitting rule decides; of equally long ones
that with the longer host, and of one rule given with both verdicts ``block``.

A url that no rule fits is judged by its words.  Aho-Corasick runs once over all
urls of a part of a batch, joined by line feeds, and its few hits are traced back
to their urls.  A hit counts if no letter, digit or non-ASCII character stands
right before or after it.  One strict term rejects, and so do ``SEVERAL``
distinct soft terms; a term that occurs more often counts once.

Defined cases: a null url, or one without ``://``, has an empty host and path and
no rule; what it has of words is judged all the same, so a null or empty url is
allowed; repeated rows are judged each; an empty table gives no rows.  Only A-Z
are lower-cased; escapes (``%41``) and ports are left as they are written.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh_name, parts

#: Rules as (verdict, host and path): fixed by the contract.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

#: One of these rejects.
STRICT = ["adult", "casino", "escorts", "hentai", "malware", "phishing", "porn", "porno", "spam", "viagra", "warez", "xxx"]
#: Several distinct ones of these reject.
SOFT = ["ads", "bet", "bets", "betting", "bonus", "cheap", "click", "clicks", "coupon", "crack", "dating", "deal", "deals", "discount", "farm",
        "free", "gambling", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "offer", "pills", "poker", "popup", "prize", "promo",
        "replica", "sex", "slots", "torrent", "track", "tracker", "win", "winner"]
SEVERAL = 2
CHUNK = 4 << 20
LOWER = {c: c + 32 for c in range(65, 91)}
HOST = re.compile(r"://([^/?#]*)([^?#]*)")


class Vocabulary:
    """Strict and soft terms in one automaton."""

    def __init__(self, strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.terms = 0
        for weight, terms in enumerate((soft, strict)):
            for term in terms:
                term = term.translate(LOWER)
                if term and (weight or not self.automaton.exists(term)):
                    self.automaton.add_word(term, (self.terms, weight, len(term)))
                    self.terms += 1
        if self.terms:
            self.automaton.make_automaton()

    def counts(self, urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct strict and soft terms of each url."""
        out = np.zeros((2, len(urls)), np.int64)
        body = "\n".join(urls).translate(LOWER)
        if self.terms and body:
            hits = [(end + 1 - n, end + 1, term, weight) for end, (term, weight, n) in self.automaton.iter(body)
                    if not (end >= n and word(body[end - n])) and not (end + 1 < len(body) and word(body[end + 1]))]
            if hits:
                starts, _, terms, weights = np.array(hits, np.int64).T
                firsts = np.cumsum([0] + [len(u) + 1 for u in urls[:-1]])
                at = np.searchsorted(firsts, starts, "right") - 1
                _, once = np.unique(at * self.terms + terms, return_index=True)
                np.add.at(out, (weights[once], at[once]), 1)
        return out[1], out[0]


def word(c: str) -> bool:
    """Whether a character continues a word: a letter, a digit or non-ASCII."""
    return c >= "\x80" or c.isalnum()


class Rules:
    """Rules by host."""

    def __init__(self, rules: Iterable[tuple[str, str]] = RULES):
        self.by_host: dict[str, dict[str, str]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            known = self.by_host.setdefault(host.translate(LOWER), {})
            if known.get(slash + path) != "block":
                known[slash + path] = verdict
        self.lengths = {h: sorted({len(p) for p in ps}, reverse=True) for h, ps in self.by_host.items()}

    def fitting(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits."""
        best, at = None, 0
        while host:
            own = host[at:]
            for n in self.lengths.get(own, ()):
                if n <= len(path) and path[:n] in self.by_host[own]:
                    if best is None or len(own) + n > best[0]:
                        best = (len(own) + n, own, path[:n])
                    break
            at = host.find(".", at) + 1
            if not at:
                break
        return (None, None) if best is None else (best[1] + best[2], self.by_host[best[1]][best[2]])


def split(url: str) -> tuple[str, str]:
    """Host, lower-cased, and path of a url."""
    found = HOST.search(url)
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


ADDED = [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()),
         T.StructField("n_strict", T.LongType()), T.StructField("n_soft", T.LongType()), T.StructField("verdict", T.StringType())]


def marked(pages: DataFrame, url: str, names: list[str], rules: Iterable[tuple[str, str]], strict: Iterable[str], soft: Iterable[str], several: int) -> DataFrame:
    """``pages`` with the columns of ``ADDED`` under ``names``."""
    rules, strict, soft = list(rules), list(strict), list(soft)
    schema = T.StructType([*pages.schema.fields, *[T.StructField(n, f.dataType) for n, f in zip(names, ADDED)]])
    place = pages.columns.index(url)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, words = Rules(rules), Vocabulary(strict, soft)
        for batch in parts(batches, url, CHUNK):
            urls = [u or "" for u in batch.column(place).to_pylist()]
            pairs = [split(u) for u in urls]
            found = [hosts.fitting(*p) for p in pairs]
            hard, weak = words.counts(urls)
            other = np.where((hard > 0) | (weak >= several), "block", "allow").tolist()
            new = [pa.array(c, pa.string()) for c in ([p[0] for p in pairs], [p[1] for p in pairs], [f[0] for f in found])]
            verdicts = pa.array([f[1] or o for f, o in zip(found, other)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array(hard), pa.array(weak), verdicts], names=schema.names)

    return pages.mapInArrow(run, schema)


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT,
           several: int = SEVERAL, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: its id, host, path, rule, n_strict, n_soft (distinct
    terms) and verdict."""
    own = pages.select(pages[page_id].alias("page_id"), pages[url].alias("__url"))
    return marked(own, "__url", [f.name for f in ADDED], rules, strict, soft, several).drop("__url")


def filtered(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT,
             several: int = SEVERAL, url: str = "url") -> DataFrame:
    """The allowed pages with their own columns."""
    names = [fresh_name(pages, "__" + f.name) for f in ADDED]
    out = marked(pages, url, names, rules, strict, soft, several)
    return out.filter(out[names[-1]] == "allow").drop(*names)
