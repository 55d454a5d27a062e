"""Toxicity: a weighted lexicon, learned from labelled rows, matched by Aho-Corasick after folding, normalised by length."""

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ω": "w", "γ": "y",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ɡ": "g", "ɑ": "a", "ʟ": "l", "ʀ": "r", "ꜱ": "s",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Signs that are letters only between letters.
_INNER = "@$!|€"
#: Phrases in which a term says nothing; used if the terms are in the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "sore loser", "pond scum", "moron test")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        d = unicodedata.normalize("NFKD", c)
        d = "".join(x for x in d if not unicodedata.combining(x)).casefold()
        out = "".join(HOMOGLYPHS.get(x, DIGITS.get(x, x)) for x in d)
        out = "".join(x if x.isalpha() else " " for x in out) if d else ""
        if c in "​‌‍⁠﻿­":
            out = ""
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Letters only, between single spaces and with one at both ends: accents, case, homoglyphs, digits for letters undone.

    A sign that stands for a letter counts as one only inside a word, and digits only beside letters."""
    out = []
    for w in text.split():
        if w.isalpha():
            out.append(w.translate(_FOLD))
            continue
        core = w.strip("!|.,;:?")
        for sign in _INNER:
            if sign in core and (core[0] == sign or core[-1] == sign) and not any(x.isalpha() for x in core):
                core = ""
        if core and not any(x.isalpha() for x in core):
            continue
        out.append(core.translate(_FOLD))
    return f" {' '.join(' '.join(out).split())} "


def terms(folded: str, shortest: int, longest: int) -> set[str]:
    """Whole words (' word ') and beginnings of longer ones (' beg')."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= shortest:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in range(shortest, min(longest, len(w) - 1) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    slopes: tuple[float, float, float] = (1.0, 0.0, 0.0)
    _auto: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_auto": None}

    def automaton(self) -> "ahocorasick.Automaton":
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for t, w in self.weights.items():
                self._auto.add_word(t, (t, w))
            for e in self.exceptions:
                self._auto.add_word(fold(e), (fold(e), None))
            if len(self._auto):
                self._auto.make_automaton()
        return self._auto

    def matches(self, folded: str) -> list[str]:
        """Terms that stand in no exception phrase, the longest at each place."""
        if not len(self.automaton()):
            return []
        best, without = {}, []
        for end, (t, w) in self.automaton().iter(folded):
            start = end + 1 - len(t)
            if w is None:
                without.append((start, end))
            elif len(t) > len(best.get(start, "")):
                best[start] = t
        return [t for s, t in best.items() if not any(a <= s and s + len(t.rstrip()) <= b + 1 for a, b in without)]

    def features(self, folded: str) -> tuple[float, float, float]:
        """Weight of the distinct terms, of all occurrences for 100 words, and whether there is any."""
        found = self.matches(folded)
        if not found:
            return 0.0, 0.0, 0.0
        n = max(1, folded.count(" ") - 1)
        return min(30.0, sum(self.weights[t] for t in set(found))), min(30.0, 100.0 * sum(self.weights[t] for t in found) / n), 1.0

    def score(self, text: str | None) -> float:
        x = self.bias + sum(a * b for a, b in zip(self.slopes, self.features(fold(text or "")), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x))))


def learn(rows: DataFrame, sample: int = 20_000, candidates: int = 4_000, shortest: int = 3, longest: int = 8, precision: float = 0.7, support: int = 3) -> Lexicon:
    """Lexicon and score from rows (text, toxic), of which the caller has taken at most `sample`.

    Candidates are words and beginnings of words, at most `candidates` by weight times support, of which `precision` of at
    least `support` documents are toxic. A greedy cover keeps those that account for toxic documents not yet accounted for;
    weights are smoothed log odds; a logistic fit over weight, density and presence gives the score."""
    base = rows.where("toxic is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c[y > 0].update(terms(fold(t), shortest, longest))
            keys = list(c[0].keys() | c[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([c[0][k] for k in keys], pa.int64()), pa.array([c[1][k] for k in keys], pa.int64())], ["term", "clean", "toxic"])

    n0, n1 = base.agg(F.coalesce(F.sum((F.col("toxic") <= 0).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    if n0 + n1 > sample:
        raise ValueError(f"more than {sample} labelled rows")
    if not n1 or not n0:
        return Lexicon({}, bias=-3.0 if not n1 else 3.0)
    counted = base.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n0 + 1.0))
    good = counted.where((F.col("toxic") >= support) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean")))).withColumn("weight", odds)
    best = good.orderBy((F.col("weight") * F.sqrt("toxic")).desc(), "term").limit(candidates).collect()
    whole = {r["term"]: r["toxic"] for r in best if r["term"].endswith(" ")}
    most: dict[str, int] = {}
    for t, n in whole.items():
        for k in range(shortest, longest + 1):
            most[t[: k + 1]] = max(n, most.get(t[: k + 1], 0))
    # a beginning is there for many words; what a single word accounts for is left to that word
    weight = {r["term"]: r["weight"] for r in best if r["term"] in whole or most.get(r["term"], 0) < 0.8 * r["toxic"]}
    if not weight:
        return Lexicon({}, bias=math.log((n1 + 0.5) / (n0 + 0.5)))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, n = [], []
            for t in b.column(0).to_pylist():
                f = fold(t)
                hits.append(sorted(terms(f, shortest, longest) & weight.keys()))
                n.append(f.count(" "))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(hits, pa.list_(pa.string()))], ["toxic", "hits"])

    docs = base.mapInArrow(seen, "toxic int, hits array<string>").where("size(hits) > 0").collect()
    toxic = [set(r["hits"]) for r in docs if r["toxic"] > 0]
    holders: dict[str, set[int]] = {}
    for i, hits in enumerate(toxic):
        for t in hits:
            holders.setdefault(t, set()).add(i)
    chosen, left = {}, set(range(len(toxic)))
    while left and holders:  # the cover; of equals, the larger weight, then the longer beginning
        t = max(holders, key=lambda t: (len(holders[t] & left), weight[t], len(t), t))
        gain = len(holders.pop(t) & left)
        if gain < 3:
            break
        chosen[t] = weight[t]
        left -= {i for i in left if t in toxic[i]}
    for t, w in weight.items():  # whole words that the cover has no need of but that are as sure
        if t.endswith(" ") and w >= 3 and not any(t.startswith(c) for c in chosen):
            chosen[t] = w
    lexicon = Lexicon(chosen)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [lexicon.features(fold(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([r[i] for r in x], pa.float64()) for i in range(3))], ["y", "a", "b", "c"])

    got = np.array(base.mapInArrow(shown, "y int, a double, b double, c double").collect(), float).reshape(-1, 4)
    got = got[np.lexsort(got.T)]
    x, y = np.column_stack([got[:, 1:], np.ones(len(got))]), (got[:, 0] > 0).astype(float)
    beta, ridge = np.zeros(4), np.diag([1.0, 1.0, 1.0, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    lexicon.slopes, lexicon.bias = tuple(map(float, beta[:3])), float(beta[3])
    return lexicon


def labelled(docs: DataFrame, labels: DataFrame, sample: int = 20_000, held_out: bool = True) -> DataFrame:
    """(text, toxic) of at most `sample` labelled rows, those with the smallest hashes of doc_id; none whose crc32(doc_id as
    text) mod 3 is 1 (if held_out). A document with several labels is toxic if one says so; null labels do not count."""
    ids = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"))
    if held_out:
        ids = ids.where(F.crc32(F.col("_id").cast("string")) % 3 != 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    few = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # so few that they can be sent to all
    one = rows.join(F.broadcast(few), "_id").groupBy("_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return one.select("text", "toxic")


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with the score (0 to 1) of each whole text; null and empty texts score as texts without terms. Other columns stay."""
    lex = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = boxed(docs, (into,), text=F.col(text))
    shape = rows.select("row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lex.value.score(t.as_py()) for t in b.column(1)], pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, shape).select("row.*", F.col("score").alias(into))
