"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Odd 64-bit multipliers for polynomial and finalising hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a single-process local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and (not sc.master.startswith("local") or "cluster" in sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="pitchlake-"))
    return sc.getCheckpointDir()


#: Working tables of this process that haven't been dropped.
_written: list[str] = []


def materialise(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts the lineage and survives lost executors.

    ``few``: of narrow rows; an eighth of the usual number of tasks writes them, in as many files.
    Results read from working tables, so these stay until ``drop_working_tables``.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    (df.coalesce(n_tasks(df.sparkSession) // 8 + 1) if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def working_tables() -> list[str]:
    return list(_written)


def drop_working_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete working tables (all of them unless ``paths`` says which): for when nothing that reads them is needed any more."""
    for path in working_tables() if paths is None else paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _written:
            _written.remove(path)


def text_chunks(column: pa.Array, limit: int = 1 << 22):
    """Cut an Arrow string column into runs of rows of about ``limit`` bytes.

    Yields (first row, bytes as uint8 array, row bounds within them). Nulls count as empty.
    A row is never cut, so one very long text forms a run of its own.
    """
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, raw[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX_A
    h ^= h >> np.uint64(27)
    h *= MIX_B
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k consecutive symbols, by doubling; entry i covers symbols i to i+k-1."""
    if len(symbols) < k:
        return np.zeros(0, np.uint64)
    done, done_n = None, 0
    power, n = BASE, 1
    current = symbols.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if k & n:
                if done is None:
                    done = current
                else:
                    m = len(symbols) - (done_n + n) + 1
                    done = done[:m] * power + current[done_n:done_n + m]
                done_n += n
            if done_n == k:
                return done
            m = len(symbols) - 2 * n + 1
            current = current[:m] * power + current[n:n + m]
            power, n = power * power, 2 * n


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown to ``most`` words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
