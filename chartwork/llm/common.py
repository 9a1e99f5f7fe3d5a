"""Shared pieces: the cluster's shared folder, vectorised word hashing, connected components."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have, at 8 to 50 bytes a row, before a join stops broadcasting it.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine if all of Spark runs on it, else an error.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="chartwork-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


_kept: list[tuple[SparkSession, str]] = []


def _drop_all() -> None:
    for spark, path in _kept:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001, S110  the JVM may have gone first
            pass


atexit.register(_drop_all)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, dropped when Python ends."""
    path = f"{shared_dir(spark)}/chartwork-{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is: then the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------- words of Arrow text, in NumPy

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, *range(9, 14)]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int, seed: int = 1) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[0] = seed
    return np.multiply.accumulate(x)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (nulls as empty) and where each row starts, with the end last."""
    a = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(a.type)
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(a) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each row, A-Z lower-cased, as 64-bit hashes.

    ``first[i]:first[i + 1]`` are the words of row i; ``start`` and ``end`` are byte offsets in the joined text.
    """

    def __init__(self, column: pa.Array) -> None:
        raw, at = text_bytes(column)
        self.raw, self.at = raw, at
        inside = _IN_WORD[raw]
        begins = np.zeros(len(raw), dtype=bool)
        begins[at[:-1][at[:-1] < len(raw)]] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | begins))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:] & ~begins[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        """Polynomial hashes over each word's bytes, block by block so that memory stays bounded."""
        n, out = len(self.start), np.empty(len(self.start), dtype=np.uint64)
        length = self.end - self.start
        power = _powers(int(length.max(initial=1)) + 1, _BASE)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.start, self.start[lo] + _BLOCK)))
            a, b = self.start[lo], self.end[hi - 1]
            own = self.start[lo:hi] - a
            place = np.arange(b - a) - np.repeat(own, np.diff(np.append(own, b - a)))
            value = _LOWER[self.raw[a:b]].astype(np.uint64) + np.uint64(1)
            value *= power[np.minimum(place, len(power) - 1)]
            value[~inside[a:b]] = 0
            out[lo:hi] = np.add.reduceat(value, own)
            lo = hi
        return mix(out + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words inside a row, and the index of the first word of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        row = self.rows()
        whole = np.flatnonzero(row[:n] == row[k - 1 :])
        return _gram(self.hash, whole, k), whole


def _gram(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    c, out = _powers(k, 0xC2B2AE3D27D4EB4F | 1, 0x165667B19E3779F9), np.zeros(len(at), dtype=np.uint64)
    for i in range(k):
        out += h[at + i] * c[i]
    return mix(out + np.uint64(k))


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending (as int64), and where each row's begin, with the end last.

    A row of fewer than ``k`` words has its whole sequence as its one shingle, a row without words none.
    """
    count = words.counts()
    h, at = words.grams(k)
    row = words.rows()[at] if len(at) else np.zeros(0, np.int64)
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            h = np.append(h, _gram(words.hash, words.first[short], n))
            row = np.append(row, short)
    order = np.argsort(row, kind="stable") if len(row) and np.any(np.diff(row) < 0) else slice(None)
    h, row = h[order].view(np.int64), row[order]
    edge = np.searchsorted(row, np.arange(len(count) + 1))
    keep = np.ones(len(h), dtype=bool)
    h = h.copy()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own = h[a:b]
        own.sort()
        np.not_equal(own[1:], own[:-1], out=keep[a + 1 : b])
    return h[keep], np.append(0, np.cumsum(np.add.reduceat(np.append(keep, False), edge[:-1]) * (edge[1:] > edge[:-1]))) if len(edge) > 1 else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``most`` bytes of text each, so that NumPy's working memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def give_back() -> None:
    """What a task has freed goes back to the machine: its worker stays, idle, and counts as memory of the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b) but the least of each component, which names it.

    Large-star and small-star in turn until no edge changes; each round is written to the shared folder. A hub's
    neighbours are never gathered: each round is a minimum by key and a join that Spark can split.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path, sign = "", None
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        down = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        to = new_folder(spark, "components")
        new.write.parquet(to)
        if path:
            drop(spark, path)
        path, now = to, spark.read.schema("a long, b long").parquet(to)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == sign:
            return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        sign = tuple(got)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
