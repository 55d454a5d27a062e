"""Embedding near-dedup: an inverted multi-index over vector halves, multi-sequence traversal of its cells, exact verification."""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, signed, written

_U = np.uint64
#: Vectors that the codebooks and the traversal's reach are fitted on, at most.
SAMPLE = 20_000
#: Index vectors of a group, which a task holds in memory: at least and at most; between these, a 64th of all.
BLOCK, MOST = 2048, 1 << 16
#: Copies of a vector, one for each group it visits, that may lie on disk at once on average; where there are more, the queries go in rounds.
COPIES = 1.5
#: Steps of a unit in which the codebooks and what is measured against them are whole numbers. So a distance is exact in doubles, whatever
#: else is in the batch, and two tasks agree on whether a vector visits a cell.
_STEPS = float(1 << 24)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = distances(x, c).argmin(axis=1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in the order of d1[i] + d2[j], as long as that is within the limit."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > limit:
            return
        yield int(o1[i]), int(o2[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))


class Index:
    """Codebooks of both halves, and how far beyond the nearest cell a traversal goes. Distances are whole numbers; see _STEPS."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, recall: float, seed: int = 7) -> None:
        self.half = sample.shape[1] // 2
        k = int(np.clip(round((n / 4) ** 0.5), 2, 256))
        self.c1, self.c2 = (np.rint(_STEPS * kmeans(x, k, s)) for x, s in ((sample[:, : self.half], seed), (sample[:, self.half :], seed + 1)))
        self.reach = np.ceil(self._reach(sample, cosine, recall, seed))

    def both(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.rint(_STEPS * x)
        return distances(x[:, : self.half], self.c1), distances(x[:, self.half :], self.c2)

    def traversal(self, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that multi_sequence() yields within the reach, for many vectors at once."""
        limit = self.limit(d1, d2)
        row, u = np.nonzero(d1 <= (limit - d2.min(axis=1))[:, None])
        i, v = np.nonzero(d2[row] <= (limit[row] - d1[row, u])[:, None])
        return row[i], u[i] * len(self.c2) + v

    def limit(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return d1.min(axis=1) + d2.min(axis=1) + self.reach

    def cells(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return d1.argmin(axis=1) * len(self.c2) + d2.argmin(axis=1)

    def _reach(self, sample: np.ndarray, cosine: float, recall: float, seed: int) -> float:
        """How far the partner's cell lies beyond the nearest, seen from the one of the two for which that is less, for `recall` of the
        sample's own linked pairs, found by brute force, and of as many made up half-way between the threshold and equality; with a tenth on top."""
        rng = np.random.default_rng(seed)
        q = sample[:2000]
        pairs = [(i, j) for s in range(0, len(q), 500) for i, j in zip(*np.nonzero(q[s : s + 500] @ sample.T >= cosine), strict=True) if i + s != j for i in (i + s,)]
        if len(pairs) > 20_000:
            pairs = [pairs[i] for i in rng.choice(len(pairs), 20_000, replace=False)]
        near = (1 + cosine) / 2
        z = rng.normal(size=q.shape)
        z -= (z * q).sum(axis=1)[:, None] * q
        made = near * q + (1 - near**2) ** 0.5 * z / np.maximum(1e-12, np.linalg.norm(z, axis=1))[:, None]
        x = np.concatenate([q[[i for i, _ in pairs]], q]) if pairs else q
        y = np.concatenate([sample[[j for _, j in pairs]], made]) if pairs else made
        (a1, a2), (b1, b2) = self.both(x), self.both(y)
        i = np.arange(len(x))
        far = np.minimum(a1[i, b1.argmin(axis=1)] + a2[i, b2.argmin(axis=1)] - a1.min(axis=1) - a2.min(axis=1), b1[i, a1.argmin(axis=1)] + b2[i, a2.argmin(axis=1)] - b1.min(axis=1) - b2.min(axis=1))
        parts = [far[len(pairs) :]] + ([far[: len(pairs)]] if pairs else [])
        return 1.1 * max(float(np.quantile(p, recall)) for p in parts) + 1


class Layout:
    """Groups of cells: neighbours in the grid's order up to `most` vectors together; a cell of more is dealt to groups of its own."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, grid: int, most: int) -> None:
        self.first, self.parts = np.zeros(grid, np.int64), np.zeros(grid, np.int64)
        group = filled = 0
        for cell, n in sorted(zip(cells.tolist(), counts.tolist(), strict=True)):
            if filled and filled + n > most:
                group, filled = group + 1, 0
            parts = -(-n // most)
            self.first[cell], self.parts[cell] = group, parts
            group, filled = (group + parts, 0) if parts > 1 else (group, filled + n)
        self.groups = group + (filled > 0)

    def stored(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[cell] + (mix(ids.view(_U)) % self.parts[cell].astype(_U)).astype(np.int64)

    def asked(self, row: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(row, group, cells), each row and group once, of visits to cells; the cells visited there as bytes of int32. Empty cells are in none."""
        n = self.parts[cell]
        key = np.repeat(row, n) * self.groups + np.repeat(self.first[cell] - np.cumsum(n) + n, n) + np.arange(n.sum())
        o = np.argsort(key, kind="stable")
        key, begin = np.unique(key[o], return_index=True)
        to = np.repeat(cell, n)[o].astype(np.int32)
        off = np.append(begin, len(to)).astype(np.int32) * np.int32(4)
        return *np.divmod(key, self.groups), pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(to.tobytes())])


def raw_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, type]:
    """(vec_id, h1, h2, e) of each row, and the type of e's numbers, floats where the column has floats: hashes of the raw vector and its
    bytes; null for vectors that are null, zero, or hold null or non-finite components."""
    element = getattr(vectors.select(F.col(embedding)).schema[0].dataType, "elementType", None)
    kind, name = (np.float32, "float") if element is not None and element.typeName() == "float" else (np.float64, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            off, there = col.offsets.to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)
            values = col.values.fill_null(float("nan")).to_numpy(zero_copy_only=False) if len(col.values) else np.zeros(0, kind)
            n = np.where(there, np.diff(off), 0)
            h1, h2, bad, e = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.ones(len(n), bool), [None] * len(n)
            for dim in np.unique(n[n > 0]).tolist():
                at = np.flatnonzero(n == dim)
                x = values[off[at][:, None] + np.arange(dim)] + kind(0)
                ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
                at, x = at[ok], x[ok]
                w = mix(x.astype(np.float64).view(_U) + np.arange(1, dim + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
                h1[at], h2[at], bad[at] = signed(mix(w.sum(axis=1))), signed(mix(mix(w).sum(axis=1))), False
                data, width = x.tobytes(), dim * x.itemsize
                for i, r in enumerate(at.tolist()):
                    e[r] = data[i * width : (i + 1) * width]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, mask=bad), pa.array(h2, mask=bad), pa.array(e, pa.binary())], ["vec_id", "h1", "h2", "e"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{name}>"))
    return rows.mapInArrow(run, "vec_id long, h1 long, h2 long, e binary"), kind


def _units(rows: list[bytes], kind: type) -> np.ndarray:
    """Unit vectors in doubles."""
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def similar_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.999, sample: int = SAMPLE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors, for links of at least `cosine`, verified in double precision.

    Equal vectors are one class with a count. Every class is in the index, in the cell of its halves' nearest centroids, and every class
    is a query: it goes to the cells of a multi-sequence traversal within the index's reach. A pair is found if one of the two reaches the
    other's cell, and counted once. Cells are dealt to groups, which a task holds while queries stream by; a query is sent once to each group
    it visits, as raw bytes, and in rounds, so that what is sent at once stays a few times the input. A task gives counts and a
    spanning forest of its links, not the links. The codebooks are fitted on at most `sample` classes.
    Vectors that are null, zero, or have null or non-finite components link with nothing. Vectors of another length than most link
    only with their like. Repeated rows count each."""
    spark = vectors.sparkSession
    parsed, kind = raw_vectors(vectors, vec_id, embedding)
    rows = written(parsed.select("vec_id", "h1", "h2"), "vectors")
    classes = parsed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min("e").alias("e"))
    classes = written(classes.where("id is not null").withColumn("dim", F.octet_length("e")), "classes")
    links = counts = None
    for dim, total in sorted((r[0], r[1]) for r in classes.groupBy("dim").count().collect()):
        own = classes.where(F.col("dim") == dim).select("id", "n", "e")
        few = _units([bytes(e) for e in own.orderBy(F.xxhash64("id"), "id").limit(sample).select("e").toPandas()["e"]], kind)
        for got in _joined(own, Index(few, total, cosine, recall), few, total, kind, cosine):
            l, c = got.where("other is not null").select("id", "other"), got.where("other is null").select("id", "n")
            links, counts = (l, c) if links is None else (links.union(l), counts.union(c))
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comp = written(components(links, "id", "other"), "components")
    counts = counts.groupBy("id").agg(F.sum("n").alias("m"))
    per = classes.select("h1", "h2", "id", "n").join(counts, "id", "left").join(comp, F.col("id") == F.col("node"), "left").select("h1", "h2", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).cast("long").alias("m"), F.coalesce("component", "id").alias("c"))
    out = rows.select("vec_id", "h1", "h2").join(per, ["h1", "h2"], "left")
    c = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("m", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), (c == F.col("vec_id")).alias("kept"))


def _joined(own: DataFrame, index: Index, few: np.ndarray, total: int, kind: type, cosine: float) -> Iterator[DataFrame]:
    """Tables, one a round, of (id, n, other): parts of each id's number of links (other null), and the edges of a spanning forest of each group."""
    spark = own.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells, n = np.unique(shared.value.cells(*shared.value.both(_units(b.column(0).to_pylist(), kind))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    full = own.select("e").mapInArrow(cell, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # one row a cell, 65,536 at most
    layout = Layout(full["cell"].to_numpy(), full["n"].to_numpy(), len(index.c1) * len(index.c2), int(np.clip(total // 64, BLOCK, MOST)))
    asked = few[:2000]
    copies = sum(len(layout.asked(*index.traversal(*index.both(asked[s : s + 500])))[0]) for s in range(0, len(asked), 500)) / len(asked)
    rounds, dealt = max(1, int(np.ceil(copies / COPIES))), spark.sparkContext.broadcast(layout)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for now in range(rounds):
        both = own.mapInArrow(_placed(shared, dealt, kind, now, rounds), "part long, query int, cell long, id long, n long, e binary, cells binary")
        # the number of parts is fixed: by size, small tables would go to one task
        met = both.repartition(parts, "part").sortWithinPartitions("part", "query", "cell", "id").mapInArrow(_meet(shared, kind, cosine), "id long, n long, other long")
        yield written(met, "links")


def _placed(index, layout, kind: type, now: int, rounds: int):
    """Each vector in its own cell's group, and, if it asks in this round, in each group that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, names = index.value, ["part", "query", "cell", "id", "n", "e", "cells"]
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                d1, d2 = x.both(_units(part.column(2).to_pylist(), kind))
                cell, ids = x.cells(d1, d2), part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(layout.value.stored(cell, ids)), pa.array(np.zeros(len(cell), np.int32)), pa.array(cell), *part.columns, pa.nulls(len(cell), pa.binary())], names)
                mine = np.flatnonzero(mix(ids.view(_U) + _U(1)) % _U(rounds) == _U(now))
                row, group, cells = layout.value.asked(*x.traversal(d1[mine], d2[mine]))
                row = mine[row]
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.ones(len(row), np.int32)), pa.array(cell[row]), *(c.take(pa.array(row)) for c in part.columns), cells], names)

    return run


class _Group:
    """Stored vectors of a group, by cell; their links' credits, and labels of what the group's links have tied together so far."""

    def __init__(self, cell: np.ndarray, ids: np.ndarray, n: np.ndarray, e: list[bytes], kind: type) -> None:
        self.cell, self.ids, self.n, self.x = cell, ids, n, _units(e, kind)
        self.credit, self.label = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def credits(self) -> list[tuple[int, int, int | None]]:
        at = np.flatnonzero(self.credit)
        return [(i, m, None) for i, m in zip(self.ids[at].tolist(), self.credit[at].tolist(), strict=True)]

    def ask(self, index: Index, cell: np.ndarray, ids: np.ndarray, n: np.ndarray, x: np.ndarray, visits: list[bytes], cosine: float) -> list[tuple[int, int, int | None]]:
        """Counts of the queries and edges of the forest. Where both of a pair visit each other's cell, the one with the smaller id counts it."""
        out: list[tuple[int, int, int | None]] = []
        row, to = np.repeat(np.arange(len(x)), [len(v) // 4 for v in visits]), np.frombuffer(b"".join(visits), np.int32)
        row = row[o := np.argsort(to, kind="stable")]
        cells, begin = np.unique(to[o], return_index=True)
        start, end = np.searchsorted(self.cell, cells), np.searchsorted(self.cell, cells, "right")
        begin = np.append(begin, len(row))
        u, v = np.divmod(cell, len(index.c2))
        for k in np.flatnonzero(end > start).tolist():
            q = row[begin[k] : begin[k + 1]]
            for a in range(int(start[k]), int(end[k]), BLOCK):
                z = min(int(end[k]), a + BLOCK)
                i, j = np.nonzero(x[q] @ self.x[a:z].T >= cosine)
                if not len(i):
                    continue
                d1, d2 = index.both(self.x[a:z])
                i, s = q[i], a + j
                back = d1[j, u[i]] + d2[j, v[i]] <= index.limit(d1, d2)[j]
                ok = (ids[i] < self.ids[s]) | (ids[i] > self.ids[s]) & ~back
                i, s = i[ok], s[ok]
                if not len(i):
                    continue
                np.add.at(self.credit, s, n[i])
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                m = np.add.reduceat(self.n[s], first)
                for f, g, w in zip(first.tolist(), [*first[1:].tolist(), len(i)], m.tolist(), strict=True):
                    own = int(ids[i[f]])
                    out.append((own, w, None))
                    tied, at = np.unique(self.label[s[f:g]], return_index=True)
                    out += [(own, 0, other) for other in self.ids[s[f:g][at]].tolist()]
                    if len(tied) > 1:
                        self.label[np.isin(self.label, tied)] = tied[0]
        return out


def _meet(index, kind: type, cosine: float):
    """The queries of each group, which come after its stored vectors, against those of the cells that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple[int, int, int | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["id", "n", "other"])

        key, held, group = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            part, query, *cols = (b.column(i).to_numpy() for i in range(5))
            edge = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (query[1:] != query[:-1])]))
            for s, t in zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True):
                if part[s] != key:
                    if group is not None and (out := group.credits()):
                        yield batch(out)
                    key, held, group = part[s], [], None
                if not query[s]:
                    held.append((*(c[s:t] for c in cols), b.column(5).slice(s, t - s).to_pylist()))
                    continue
                if group is None:
                    *own, e = zip(*held, strict=True)
                    group, held = _Group(*map(np.concatenate, own), [x for y in e for x in y], kind), []
                for r in range(s, t, BLOCK):
                    z = min(t, r + BLOCK)
                    e, cells = (b.column(i).slice(r, z - r).to_pylist() for i in (5, 6))
                    if out := group.ask(index.value, *(c[r:z] for c in cols), _units(e, kind), cells, cosine):
                        yield batch(out)
        if group is not None and (out := group.credits()):
            yield batch(out)

    return run
