"""Shared parts: folders that all executors see, Arrow text buffers, vectorised words and shingles, components."""

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that numpy works on at once, in bytes (a longer document is a piece of its own).
PIECE = 1 << 20
_U = np.uint64
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one, but on a local master only: elsewhere it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tessera_dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = spark._tessera_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return d.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _delete() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session is over
            return


atexit.register(_delete)
#: Spark's own switch: an execution's shuffle files go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of executions inside are deleted at the end of each, as what they were for is a written table by then."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, outlives executors, and is read by column. Its shuffle files are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    with shuffles_go(spark):
        (w.partitionBy(*by) if by else w).parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of written() tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._tessera_path)
        _made[:] = [(s, p) for s, p in _made if p != t._tessera_path]


def boxed(df: DataFrame, results: tuple[str, ...], **columns: Column) -> DataFrame:
    """`row`, a struct of all columns of df but for those called, whatever the case, as one of the results; and the columns given. So
    columns of any name, dots included, pass through an operator beside its own and clash with none of them."""
    gone = {r.lower() for r in results}
    kept = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns if c.lower() not in gone]
    return df.select(F.struct(*kept).alias("row"), *(c.alias(n) for n, c in columns.items()))


# -- text buffers


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; null counts as empty."""
    arr = (arr.fill_null("") if arr.null_count else arr).cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]] if arr.buffers()[2] and len(arr) else np.zeros(0, np.uint8)
    return data, off - off[0] if len(off) else np.zeros(1, np.int64)


def pieces(arr: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets): rows in turn, about `most` bytes at a time, each text whole."""
    data, off = buffers(arr)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, _U, endpoint=False)


_FACTOR = int(_random(1, 11)[0]) | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTES = _random(256, 12)
#: A random number for each byte at each of a word's first places; A-Z count as a-z.
_PLACES = 64
_AT = _random(_PLACES * 256, 13).reshape(_PLACES, 256)
_AT[:, 65:91] = _AT[:, 97:123]
_AT = _AT.ravel()
_powers = {True: np.ones(1, _U), False: np.ones(1, _U)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The factor's powers 0 to n - 1, modulo 2**64."""
    p = _powers[inverse]
    while len(p) < n:
        step = _U(pow(_INVERSE if inverse else _FACTOR, len(p), 1 << 64))
        p = np.concatenate([p, p * step])
    _powers[inverse] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, of the public splitmix kind."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums for span_hash()."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(pre: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the bytes from s up to e, wherever they stand."""
    return mix((pre[e] - pre[s]) * powers(len(pre), True)[s] + (e - s).astype(_U) * _U(0x9E3779B97F4A7C15))


def word_hash(data: np.ndarray, inside: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of lower-cased words; data: bytes, inside: which of them belong to words, n: the words' lengths in turn.

    The sum of a random number for each pair of place and byte: no polynomial, so texts made to collide in one for any base are told apart."""
    b = data[inside]
    start = np.cumsum(n) - n
    step = np.ones(len(b), np.int32)
    if len(n):
        step[0] = 0
        step[start[1:]] = 1 - n[:-1]
    place = np.cumsum(step, dtype=np.int32)
    long = len(n) and int(n.max()) > _PLACES
    x = _AT[(np.minimum(place, np.int32(_PLACES - 1)) if long else place) << 8 | b]
    if long:
        far = place >= _PLACES
        c = b[far].astype(np.int64)
        c = np.where((c >= 65) & (c < 91), c + 32, c)
        x[far] = mix(mix((place[far].astype(np.int64) << 8 | c).astype(_U) ^ _U(_FACTOR)))
    return mix(np.add.reduceat(x, start) + n.astype(_U) * _U(0x9E3779B97F4A7C15)) if len(n) else np.zeros(0, _U)


def byte_class(pattern: str) -> np.ndarray:
    """Which of the 256 bytes belong to words, for classes that hold all of UTF-8's bytes from 0x80."""
    out = np.ones(256, bool)
    if pattern == "spaced":  # [^\x20\x09-\x0D]+
        out[[0x20, *range(0x09, 0x0E)]] = False
    else:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
        out[:0x80] = False
        out[0x30:0x3A] = out[0x61:0x7B] = out[0x41:0x5B] = True
    return out


SPACED, ALNUM = byte_class("spaced"), byte_class("alnum")


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts: start, end, hash of the lower-cased word, and for each text the index of its first (one more at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, _U), np.zeros(len(off), np.int64)
    w = table[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = w[cut]
    last[cut - 1] = w[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, word_hash(data, w, e - s), np.searchsorted(s, off)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each text, all of a shorter one together, and each text's first; at: see words()."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    if not len(h):
        return np.zeros(0, _U), to
    pre = np.zeros(len(h) + 1, _U)
    np.cumsum(h * powers(len(h)), out=pre[1:])
    start = np.arange(to[-1]) - np.repeat(to[:-1] - at[:-1], count)
    end = np.minimum(start + k, np.repeat(at[1:], count))
    return mix((pre[end] - pre[start]) * powers(len(pre), True)[start] + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15)), to


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    _, _, h, at = words(data, off)
    g, to = shingles(h, at, k)
    for a, b in zip(to[:-1], to[1:], strict=True):
        g[a:b].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = g[1:] != g[:-1]
    keep[to[:-1][to[:-1] < len(g)]] = True
    return g[keep], np.concatenate([[0], np.cumsum(keep)])[to]


def set_hash(g: np.ndarray, to: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each text's set, whatever its order."""
    pre = np.zeros(len(g) + 1, _U)
    np.cumsum(mix(g ^ _U(seed)), out=pre[1:])
    return mix(pre[to[1:]] - pre[to[:-1]] + (to[1:] - to[:-1]).astype(_U))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# -- connected components


def components(links: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node in links reaches. Alternating large and small stars; each round is a
    written table, and only a count comes to the driver. Loops, repeated links and nulls do no harm."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = written(e, "links")
    before = None
    for _ in range(most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        done, e = e, written(small, "stars")
        drop(done)
        with shuffles_go(e.sparkSession):
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
