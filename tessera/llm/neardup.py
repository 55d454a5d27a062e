"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures, with links confirmed on the full shingle sets."""

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _random, components, drop, mix, pieces, set_hash, shingle_sets, signed, written

_U = np.uint64
#: A signature has CHUNKS * WIDTH symbols of 16 bits, one of each min-hash. Its Hamming distance counts symbols that differ. By
#: pigeonhole, signatures at a distance below CHUNKS * 2 agree, in one of the chunks, in all symbols or all but one; each chunk
#: is indexed once for each symbol that may differ. At a similarity of 0.8 a chunk has more errors than that with probability
#: 0.42, so all CHUNKS have with 1e-6: that is the share of such pairs outside the guarantee that is also missed.
CHUNKS, WIDTH = 16, 7
_N = CHUNKS * WIDTH
#: A full set's parity bits: each shingle flips one of them, so two sets' bits differ in no more places than the sets in shingles. Pairs
#: whose bits differ in more places than a link allows are never links; sets of many more shingles than bits pass without being told apart.
PARITY = 1024
ODD = [f"p{i}" for i in range(PARITY // 64)]
_XOR = _random(_N, 21).astype(np.uint32)
_MUL = _random(_N, 22).astype(np.uint32) | np.uint32(1)
_COEF = _random(_N, 23).reshape(1, CHUNKS, WIDTH) | _U(1)
_SALT = _random(_N, 24).reshape(1, CHUNKS, WIDTH)


def signatures(g: np.ndarray, to: np.ndarray) -> np.ndarray:
    """One row of 16-bit symbols for each nonempty set; g: sets one after another, to: where each begins."""
    at = to[:-1][np.diff(to) > 0]
    out = np.empty((len(at), _N), np.uint16)
    x = (g >> _U(32)).astype(np.uint32)
    for j in range(_N):
        out[:, j] = np.minimum.reduceat((x ^ _XOR[j]) * _MUL[j], at)
    return out


def keys(sig: np.ndarray) -> np.ndarray:
    """For each signature the hash of every chunk without each of its symbols in turn."""
    part = sig.reshape(-1, CHUNKS, WIDTH).astype(_U) * _COEF
    return mix(part.sum(axis=2, keepdims=True) - part + _SALT).reshape(len(sig), -1)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig) of each row; h1 and h2 are null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, j, data, off in pieces(b.column(1)):
                g, to = shingle_sets(data, off, k)
                n = np.diff(to)
                sig = np.zeros((j - i, _N), np.uint16)
                if len(g):
                    sig[n > 0] = signatures(g, to)
                flat = pa.Array.from_buffers(pa.binary(2 * _N), j - i, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                h = [pa.array(signed(set_hash(g, to, s)), mask=n == 0) for s in (1, 2)]
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(n), *h, flat], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def buckets(reps: DataFrame) -> DataFrame:
    """(key, rep, id) of every key that at least two of reps (id, sig) have; rep is the key's smallest id, and has a row too.

    One shuffle: keys are dealt by hash, sorted, and runs go by in a stream, so no group is ever held in memory."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                ids = part.column(0).to_numpy()
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, _N)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys(sig).ravel())), pa.array(np.repeat(ids, _N))], ["key", "id"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rep, count = None, None, 0
        for b in batches:
            key, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            goes_on = last is not None and key[0] == last
            first[0] = not goes_on
            start = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            reps = np.where(start >= 0, ids[np.maximum(start, 0)], rep if goes_on else 0)
            place = np.arange(len(key)) - np.where(start >= 0, start, -count if goes_on else 0)
            more, second = place > 0, place == 1
            out = [np.concatenate([key[more], key[second]]), np.concatenate([reps[more], reps[second]]), np.concatenate([ids[more], reps[second]])]
            last, rep, count = key[-1], reps[-1], int(place[-1]) + 1
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "rep", "id"])

    dealt = reps.select("id", "sig").mapInArrow(spread, "key long, id long").repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(runs, "key long, rep long, id long")


def parity(g: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A row of PARITY bits, as len(ODD) integers, for each set; g: sets one after another, to: where each begins."""
    out = np.empty((len(to) - 1, len(ODD)), np.int64)
    for i in range(0, len(out), 1000):
        j = min(i + 1000, len(out))
        place = np.repeat(np.arange(j - i), np.diff(to[i : j + 1])) * PARITY + (mix(g[to[i] : to[j]]) % _U(PARITY)).astype(np.int64)
        odd = np.bincount(place, minlength=(j - i) * PARITY).reshape(j - i, PARITY) & 1
        out[i:j] = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
    return out


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, p0 to p15, s): the full shingle sets, of hashes of 64 bits, of the documents in ids (id), their sizes and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in pieces(b.column(1)):
                g, to = shingle_sets(data, off, k)
                odd = parity(g, to)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(np.diff(to)), *(pa.array(odd[:, x].copy()) for x in range(len(ODD))), pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(signed(g)))], ["id", "n", *ODD, "s"])

    few = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return few.mapInArrow(run, f"id long, n long, {', '.join(f'{x} long' for x in ODD)}, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union."""
    x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their sets of word shingles. Equal sets are one class, whose
    smallest doc_id stands for it. Candidates are the pairs that share a key of buckets(). First every class is compared with the smallest
    of each of its buckets, which settles a large group in as many links as it has members; then, in buckets where
    more than one component is left, all pairs across components are compared, so no candidate pair inside one is needed and none between
    two is lost. Null and empty texts have no shingles and stand alone. Rows that repeat a doc_id count as one node: their
    links are united. Empty tables give empty results."""
    docs = docs.select("doc_id", "text")
    sk = written(sketch(docs, shingle), "sketch")
    classes = sk.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), *(F.min(c).alias(c) for c in ("n_shingles", "sig")))
    classes = written(classes, "classes")
    cand = written(buckets(classes.where("id is not null")), "buckets")
    pairs = written(cand.where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    ids = cand.select("id").distinct()
    sets = written(full_sets(docs, ids, shingle), "sets")
    links = written(confirmed(pairs, sets, percent), "confirmed")
    comp = written(components(links, "a", "b"), "components")
    told = ids.join(comp, ids.id == comp.node, "left").select("id", F.coalesce("component", "id").alias("c"))
    member = written(cand.select("key", "id").join(told, "id"), "members")
    mixed = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    left = member.join(mixed, "key", "left_semi").join(sets.drop("s"), "id")
    x, y = (left.select("key", *(F.col(c).alias(c + s) for c in ("id", "c", "n", *ODD))) for s in ("x", "y"))
    odd = reduce(add, (F.bit_count(F.col(f"{b}x").bitwiseXOR(F.col(f"{b}y"))) for b in ODD))
    alike = (F.col("cx") < F.col("cy")) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & ((100 + percent) * odd <= (100 - percent) * (F.col("nx") + F.col("ny")))
    across = x.join(y, (x.key == y.key) & alike).select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()
    across = across.join(pairs, ["a", "b"], "left_anti")
    more = written(confirmed(across, sets, percent), "across")
    if not more.isEmpty():
        comp = written(components(links.union(more), "a", "b"), "components")
    drop(sets, cand, pairs, member)
    of = sk.select("doc_id", "n_shingles", "h1", "h2").join(classes.select("h1", "h2", "id").join(comp, F.col("id") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "id").alias("c")), ["h1", "h2"], "left")
    return of.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"), (F.coalesce("c", "doc_id") == F.col("doc_id")).alias("kept"))
