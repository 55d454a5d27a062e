"""Exact substring dedup: a depth-limited radix sort of suffixes, most significant digit first.

Suffixes are ordered only through `size` bytes, so equal groups are exactly the repeated windows of that size. A digit may be
any part of a window that equal windows share at the same place. The first digit is the window's least hash of GRAM bytes
(the leftmost of equals): all windows with the same such place in a text travel as one row, a run. Runs whose digit occurs once leave. The second
digit is the run's whole content: equal runs repeat in each of their windows. What is left, runs that agree in the first digit
but not in all bytes, goes on in blocks of STEP windows, with the bytes that a block's windows share as the digit, and last
window by window."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, boxed, drop, mix, pieces, signed, span_hash, sums, written

_U = np.uint64
GRAM, STEP = 24, 8


def runs(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of several texts: for each run the text, its first and last window, the place and the hash of the first digit, and of the whole."""
    n, w = len(data), size - GRAM + 1
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    if n < size:
        return empty
    pre = sums(data)
    at = np.arange(n - GRAM + 1)
    g = span_hash(pre, at, at + GRAM)
    low, place, width = g, at.astype(np.int32), 1
    while width < w:  # the last step overlaps; of equals the left one stays
        step = min(width, w - width)
        left = low[:-step] <= low[step:]
        low, place, width = np.where(left, low[:-step], low[step:]), np.where(left, place[:-step], place[step:]), width + step
    s = np.arange(n - size + 1)
    doc = np.searchsorted(off, s, "right") - 1
    whole = s + size <= off[doc + 1]
    s, doc, place = s[whole], doc[whole], place[whole]
    if not len(s):
        return empty
    change = np.ones(len(s), bool)
    change[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    b = np.flatnonzero(change)
    e = np.append(b[1:], len(s)) - 1
    first, last, p = s[b], s[e], place[b]
    whole_hash = mix(span_hash(pre, first, last + size) ^ ((p - first).astype(_U) << _U(32)))
    d = doc[b]
    return d, first - off[d], last - off[d], p - off[d], g[p], whole_hash


_ROW = "kind int, d long, c long, doc_id long, first int, last int, place int"


def _emit(kind: int, d: np.ndarray, c: np.ndarray, ids: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    cols = [np.full(len(d), kind, np.int32), signed(d), signed(c), ids, first.astype(np.int32), last.astype(np.int32), place.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["kind", "d", "c", "doc_id", "first", "last", "place"])


def _combined(d: np.ndarray, c: np.ndarray, ids: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of runs that are equal in one task's piece, the earliest goes on (kind 0); the others are known to repeat (kind 1)."""
    o = np.lexsort((place, ids, c, d))
    d, c, ids, first, last, place = (x[o] for x in (d, c, ids, first, last, place))
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    again = ~new & ((ids != ids[head]) | (place != place[head]))
    keep = ~again
    yield _emit(0, *(x[keep] for x in (d, c, ids, first, last, place)))
    if again.any():
        spread = mix(ids[again].view(_U) + place[again].astype(_U))  # what is known only passes by; dealt evenly
        yield _emit(1, spread, c[again], *(x[again] for x in (ids, first, last, place)))


def _first_pass(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, _, data, off in pieces(b.column(1), PIECE):
                doc, first, last, place, d, c = runs(data, off, size)
                if len(doc):
                    yield from _combined(d, c, ids[i:][doc], first, last, place)

    return docs.mapInArrow(run, _ROW)


def _sorted_pass(rows: DataFrame) -> DataFrame:
    """Of rows dealt by digit d: repeats (kind 1), and the earliest of each content c of digits with several (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of the last digit, if it has had no other content; with what follows
        for b in batches:
            if not b.num_rows:
                continue
            kind, d, c, ids, first, last, place = (b.column(i).to_numpy() for i in range(7))
            known = kind == 1
            if known.any():
                yield _emit(1, *(x[known].view(_U) for x in (d, c)), *(x[known] for x in (ids, first, last, place)))
                d, c, ids, first, last, place = (x[~known] for x in (d, c, ids, first, last, place))
            if held is not None:
                d, c, ids, first, last, place = (np.concatenate([[h], x]) for h, x in zip(held[0], (d, c, ids, first, last, place), strict=True))
            if not len(d):
                continue
            new_d, new_c = np.ones(len(d), bool), np.ones(len(d), bool)
            new_d[1:] = d[1:] != d[:-1]
            new_c[1:] = new_d[1:] | (c[1:] != c[:-1])
            head = np.maximum.accumulate(np.where(new_c, np.arange(len(d)), 0))
            again = ~new_c & ((ids != ids[head]) | (place != place[head]))
            # the earliest of each content goes on if its digit has another content
            start = np.maximum.accumulate(np.where(new_d, np.arange(len(d)), 0))
            other = new_c & ~new_d  # a content that is not its digit's first
            many = np.zeros(len(d), bool)
            many[start[other]] = True
            on = other | (new_c & new_d & many)
            was = held is not None and held[1]
            if held is not None:
                if was:
                    on[0] = False  # it went on before
            if again.any():
                yield _emit(1, *(x[again].view(_U) for x in (d, c)), *(x[again] for x in (ids, first, last, place)))
            h = head[-1]  # the current content's first; its digit's first content may lie behind
            first_of = start[-1]
            sent = bool(on[h]) or (h == 0 and held is not None and was)
            if first_of == h and not sent:
                held = (tuple(x[h] for x in (d, c, ids, first, last, place)), False)
            else:
                held = (tuple(x[h] for x in (d, c, ids, first, last, place)), True)
            # a digit that goes on in the next batch with another content is caught there, as the held row leads it
            if on.any():
                yield _emit(2, *(x[on].view(_U) for x in (d, c)), *(x[on] for x in (ids, first, last, place)))

    return rows.repartition("d").sortWithinPartitions("d", "c", "doc_id", "place").mapInArrow(run, _ROW)


def _content(docs: DataFrame, left: DataFrame, size: int) -> DataFrame:
    """Runs (doc_id, d, first, last, place) with their bytes, b."""
    per = left.groupBy("doc_id").agg(F.collect_set(F.struct("d", "first", "last", "place")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_py().encode()
                flat = b.column(2)[i].values
                d, first, last, place = (flat.field(k) for k in range(4))
                cut = [raw[x : y + size] for x, y in zip(first.to_pylist(), last.to_pylist(), strict=True)]
                whole = pa.array([len(c) == y - x + size for c, x, y in zip(cut, first.to_pylist(), last.to_pylist(), strict=True)])  # a repeated doc_id may have another text
                yield pa.RecordBatch.from_arrays([x.filter(whole) for x in (pa.array([b.column(0)[i].as_py()] * len(cut), pa.int64()), d, first, last, place, pa.array(cut, pa.binary()))], ["doc_id", "d", "first", "last", "place", "b"])

    return docs.join(per, "doc_id").select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, d long, first int, last int, place int, b binary")


def _digits(rows: DataFrame, size: int, step: int) -> DataFrame:
    """Rows of the next digit for runs with bytes b from `base`: blocks of `step` windows, in step with the first digit's place.

    The digit is what all windows of a block have in common; the content is all of the block's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                b = batch.slice(s, 2000)
                ids, d, first, last, place, base = (b.column(i).to_numpy() for i in range(6))
                raw = b.column(6).to_pylist()
                pre = sums(np.frombuffer(b"".join(raw), np.uint8))
                off = np.cumsum([0, *map(len, raw)])[:-1] - base
                far, near = (place - first) // step, (place - last) // step
                count = (far - near + 1).astype(np.int64)
                r = np.repeat(np.arange(len(d)), count)
                block = np.repeat(near, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                top = place[r] - block * step
                lo, hi, o = np.maximum(first[r], top - step + 1), np.minimum(last[r], top), off[r]
                core = span_hash(pre, o + top, o + top - step + 1 + size)
                whole = span_hash(pre, o + lo, o + hi + size)
                yield from _combined(mix(d[r].view(_U) ^ core ^ (block.astype(_U) << _U(40))), mix(whole ^ ((place[r] - lo).astype(_U) << _U(32))), ids[r], lo, hi, place[r])

    return rows.select("doc_id", "d", "first", "last", "place", "base", "b").mapInArrow(run, _ROW)


def repeats(docs: DataFrame, size: int = 100) -> DataFrame:
    """(doc_id, first, last): windows of `size` bytes, from first to last, that also start earlier; docs: (doc_id, text)."""
    one = written(_sorted_pass(_first_pass(docs, size)), "digit1")
    content = written(_content(docs, one.where("kind = 2"), size).withColumn("base", F.col("first")), "content")
    two = written(_sorted_pass(_digits(content, size, STEP)), "digit2")
    left = two.where("kind = 2").select("doc_id", "place", "d", "first", "last").join(content.select("doc_id", "place", "base", "b").dropDuplicates(["doc_id", "place"]), ["doc_id", "place"])
    three = written(_sorted_pass(_digits(left, size, 1)), "digit3")
    drop(content)
    return one.union(two).union(three).where("kind = 1").select("doc_id", "first", "last")


def dedup_substrings(docs: DataFrame, size: int = 100) -> DataFrame:
    """docs (doc_id, text, ...) with n_bytes, spans (removed runs of UTF-8 bytes, first and after the last) and kept (the other bytes).

    A byte goes if a string of `size` bytes that covers it also starts earlier: in a smaller doc_id, or in the same document at
    an earlier place; judged on the input. Null counts as empty. Rows that repeat a doc_id and its text get the same spans, and
    none for the sake of each other; if their texts differ, they share their spans. Texts under `size` bytes keep all."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeats(base.where(F.octet_length("text") >= size), size)
    per = found.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("found")).withColumnRenamed("doc_id", "_id")
    rows = boxed(docs, ("n_bytes", "spans", "kept"), text=F.col("text"), id=F.col("doc_id").cast("long"))
    both = rows.join(per, F.col("id") == F.col("_id"), "left").select("row", "text", "found")
    shape = rows.select("row", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("array<struct<first:long,after:long>>").alias("spans"), F.lit(None).cast("binary").alias("kept")).schema
    span = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans, rest = [], [], []
            for t, runs_ in zip(b.column(1), b.column(2), strict=True):
                raw = (t.as_py() or "").encode()
                out, cur, last = [], [], 0
                if runs_.is_valid:
                    v = runs_.values
                    a, z = v.field(0).to_numpy().astype(np.int64), v.field(1).to_numpy().astype(np.int64) + size
                    o = np.argsort(a, kind="stable")
                    a, z = a[o], np.minimum(np.maximum.accumulate(z[o]), len(raw))
                    new = np.ones(len(a), bool)
                    new[1:] = a[1:] > z[:-1]
                    s = np.flatnonzero(new)
                    for x, y in zip(a[s], z[np.append(s[1:], len(a)) - 1], strict=True):
                        if x < y:
                            cur.append({"first": int(x), "after": int(y)})
                            out.append(raw[last:x])
                            last = int(y)
                n.append(len(raw))
                spans.append(cur)
                rest.append(b"".join([*out, raw[last:]]) if cur else raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(rest, pa.binary())], ["row", "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, shape).select("row.*", "n_bytes", "spans", "kept")
