"""Shared pieces: durable intermediate tables, vectorised tokenising and hashing, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; memory of a step is about 40 times that.
CHUNK_BYTES = 1 << 19

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and Spark runs locally."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="petriflow-")
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Spark's own switch that removes an execution's shuffle files when it has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffles behind the written rows are removed, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/petriflow/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._petriflow_path = path
    return out


def drop(*saved: DataFrame) -> None:
    """Remove saved tables that nothing reads any more."""
    for df in saved:
        spark, path = df.sparkSession, df._petriflow_path
        _remove(spark, path)
        _made.remove((spark, path))


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the files are only scratch
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd multiplier and their inverses modulo 2**64."""

    def __init__(self, mult: int) -> None:
        self.mult, self.inverse, self.n = np.uint64(mult), np.uint64(pow(mult, -1, 1 << 64)), 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.up, self.down = np.full(self.n, self.mult), np.full(self.n, self.inverse)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)


_POWERS: dict[int, _Powers] = {}


def powers(mult: int, n: int) -> _Powers:
    p = _POWERS.setdefault(mult, None) or _Powers(mult)
    _POWERS[mult] = p
    p.grow(n)
    return p


#: Odd multipliers of two independent polynomial hashes.
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words(data: np.ndarray, off: np.ndarray, lower: bool, second: bool = False, between: np.ndarray = _WS) -> tuple[np.ndarray, ...]:
    """Row, start, end and 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` (second: one more, independent hash).

    between: flags of the bytes between words, if others than these.

    Works in steps of about CHUNK_BYTES that end between words, so that long texts need no more memory than short ones.
    """
    n, parts, at = len(data), [], 0
    if n:
        cut = np.zeros(n + 1, dtype=bool)
        cut[off] = True
    while at < n:
        end = min(n, at + CHUNK_BYTES)
        while end < n and not (cut[end] or between[data[end]]):
            end = min(n, end + 1)
        x = data[at:end]
        if lower:
            x = _LOWER[x]
        edge = cut[at : end + 1].copy()
        edge[0] = True
        space = between[x]
        first = ~space
        first[1:] &= space[:-1] | edge[1:-1]
        last = ~space
        last[:-1] &= space[1:] | edge[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        got = [s + at, e + at]
        for mult in MULTIPLIERS[: 1 + second]:
            p = powers(mult, len(x) + 1)
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum((x.astype(np.uint64) + np.uint64(1)) * p.up[: len(x)], out=total[1:])
            got.append(mix((total[e] - total[s]) * p.down[s] + (e - s).astype(np.uint64)))
        parts.append(got)
        at = end
    if not parts:
        got = [np.zeros(0, np.int64), np.zeros(0, np.int64)] + [np.zeros(0, np.uint64)] * (1 + second)
    else:
        got = [np.concatenate(z) for z in zip(*parts, strict=True)]
    row = np.searchsorted(off, got[0], side="right") - 1
    return (row, *got)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the undirected edges (a, b), root being the smallest node reachable.

    Alternating large-star and small-star steps; every round is written to the shared folder. Hubs are spread by
    map-side minima and by the splitting of skewed joins.
    """
    spark = edges.sparkSession
    now = save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old, now = now, save(small, "edges")
        drop(old)
        # wraps instead of overflowing: bits are xor-ed
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
