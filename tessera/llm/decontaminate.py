"""Benchmark decontamination: a generalised suffix automaton of the items' words; documents stream through it."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, pieces, words

#: Words that the benchmark may have altogether: the automaton is broadcast, and has at most two states a word.
MOST_WORDS = 20_000_000


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each state that is a window.

    A window is `n` consecutive words of an item, or a whole item of fewer words. win[state] is the tuple of items
    whose windows of exactly that length end in the state; up[state] the nearest state on the way of suffix links,
    itself included, that holds a window."""

    def __init__(self, items: list[tuple[int, list[int]]], n: int) -> None:
        self.n, self.next, self.link, self.len = n, [{}], [-1], [0]
        ends: dict[tuple[int, int], set[int]] = {}
        for _, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        for item, seq in items:  # now that no state is split any more
            state, k = 0, min(n, len(seq))
            length = 0
            for w in seq:
                state, length = self.step(state, length, w)
                while self.len[self.link[state]] >= k:
                    state = self.link[state]
                    length = self.len[state]
                if length >= k:
                    ends.setdefault((state, k), set()).add(item)
        self.win: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for (state, k), found in ends.items():
            self.win.setdefault(state, []).append((k, tuple(sorted(found))))
        self.up = [-1] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.up[s] = s if s in self.win else self.up[self.link[s]]
        self.least = min((k for v in self.win.values() for k, _ in v), default=0)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, ln = self.next, self.link, self.len
        if w in nxt[last] and ln[nxt[last][w]] == ln[last] + 1:
            return nxt[last][w]
        if w in nxt[last]:
            return self._split(last, w)
        cur = len(ln)
        nxt.append({})
        ln.append(ln[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if ln[q] == ln[p] + 1 else self._split(p, w)
        return cur

    def _split(self, p: int, w: int) -> int:
        nxt, link, ln = self.next, self.link, self.len
        q, new = nxt[p][w], len(ln)
        nxt.append(dict(nxt[q]))
        ln.append(ln[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """State and length of the longest match that ends at w."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, length + 1)

    def scan(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """(first word, word after) of each window in seq, and the items that have one."""
        state = length = 0
        spans, found = [], set()
        for i, w in enumerate(seq):
            state, length = self.step(state, length, w)
            if length < self.least:
                continue
            s, longest = self.up[state], 0
            while s > 0:
                for k, items in self.win[s]:
                    if k <= length:
                        longest = max(longest, k)
                        found.update(items)
                s = self.up[self.link[s]]
            if longest:
                spans.append((i + 1 - longest, i + 1))
        return spans, found


class Matcher:
    """The automaton behind a vocabulary of word hashes: only runs of known word pairs reach it."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.n = n
        arr = pa.array([t for _, t in items], pa.string())
        seqs: list[np.ndarray] = []
        for _, _, data, off in pieces(arr):
            _, _, h, at = words(data, off, ALNUM)
            seqs += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate([*seqs, np.zeros(0, np.uint64)]))
        ids = [np.searchsorted(self.vocabulary, s) for s in seqs]
        if sum(map(len, ids)) > MOST_WORDS:
            raise ValueError(f"the benchmark has more than {MOST_WORDS} words")
        self.automaton = Automaton([(i, s.tolist()) for (i, _), s in zip(items, ids, strict=True) if len(s)], n)
        v = self.v = len(self.vocabulary)
        self.pairs = np.unique(np.concatenate([*(s[:-1] * v + s[1:] for s in ids if len(s) > 1), np.zeros(0, np.int64)]))

    def texts(self, arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, set[int], np.ndarray, np.ndarray]]:
        """(row, number of words, hit words as a mask, items, word starts, word ends) of each text; offsets are the text's own bytes."""
        for i, _, data, off in pieces(arr):
            s, e, h, at = words(data, off, ALNUM)
            ids = np.full(len(h), -1)
            if self.v and len(h):
                where = np.minimum(np.searchsorted(self.vocabulary, h), self.v - 1)
                ids = np.where(self.vocabulary[where] == h, where, -1)
            tied = np.zeros(len(h), bool)  # with the word before
            if len(self.pairs) and len(h) > 1:
                p = ids[:-1] * self.v + ids[1:]
                k = np.minimum(np.searchsorted(self.pairs, p), len(self.pairs) - 1)
                tied[1:] = (ids[:-1] >= 0) & (ids[1:] >= 0) & (self.pairs[k] == p)
            tied[at[:-1][at[:-1] < len(h)]] = False
            begin = np.flatnonzero((ids >= 0) & ~tied)
            end = np.flatnonzero((ids >= 0) & ~np.append(tied[1:], False)) + 1
            long = end - begin >= max(1, self.automaton.least)
            hit, found = np.zeros(len(h), bool), {}
            for a, b in zip(begin[long], end[long], strict=True):
                spans, items = self.automaton.scan(ids[a:b].tolist())
                for x, y in spans:
                    hit[a + x : a + y] = True
                if items:
                    found.setdefault(int(np.searchsorted(at, a, "right")) - 1, set()).update(items)
            for k in range(len(off) - 1):
                a, b = at[k], at[k + 1]
                yield i + k, int(b - a), hit[a:b], found.get(k, set()), s[a:b] - off[k], e[a:b] - off[k]


def matcher(benchmark: DataFrame, n: int) -> Matcher:
    """Of a benchmark table (item_id, text), which is read to the driver: its size is checked before."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    if rows.agg(F.sum(F.length("text"))).first()[0] or 0:
        if rows.agg(F.sum(F.length("text"))).first()[0] > 12 * MOST_WORDS:
            raise ValueError(f"the benchmark has more than {12 * MOST_WORDS} characters")
    return Matcher([(r[0], r[1]) for r in rows.collect()], n)


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items array<long>, longest long, spans array<struct<start:long,stop:long>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Each row of docs (doc_id, text) with its words, the words inside an item's window, the items, the longest hit run in
    words, and the hit runs as UTF-8 byte spans. Null and empty texts have no words; repeated rows each give a row."""
    m = docs.sparkSession.sparkContext.broadcast(matcher(benchmark, n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, count, hit, items, s, e in m.value.texts(b.column("text")):
                spans, longest = [], 0
                if items:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    spans = [{"start": int(s[x]), "stop": int(e[y - 1])} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    longest = int(np.max(edge[1::2] - edge[::2]))
                rows.append((count, int(hit.sum()), len(items), sorted(items), longest, spans))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), span)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items", "longest", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, coverage: float = 0.05, longest: int | None = None) -> DataFrame:
    """docs without the benchmark's passages: from a text whose hit words reach `coverage` of its words, or whose longest hit
    run exceeds `longest` words, each hit run is removed (with the white space after it); other texts and all columns stay.
    A document that has nothing left stays with an empty text; null stays null."""
    m = docs.sparkSession.sparkContext.broadcast(matcher(benchmark, n))
    schema, at = docs.schema, docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at)
            changed = {}
            for row, count, hit, items, s, e in m.value.texts(texts):
                n_hit = int(hit.sum())
                if not n_hit:
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                if n_hit < coverage * count and not (longest is not None and np.max(edge[1::2] - edge[::2]) > longest):
                    continue
                raw, kept, last = texts[row].as_py().encode(), [], 0
                for x, y in zip(edge[::2], edge[1::2], strict=True):
                    kept.append(raw[last : s[x]])
                    last = int(s[y]) if y < len(s) else len(raw)
                changed[row] = b"".join([*kept, raw[last:]]).decode(errors="ignore")
            if changed:
                full = texts.to_pylist()
                for row, t in changed.items():
                    full[row] = t
                b = b.set_column(at, b.schema.field(at), pa.array(full, b.schema.field(at).type))
            yield b

    return docs.mapInArrow(clean, schema)
