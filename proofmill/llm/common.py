"""Shared pieces: staging in the cluster's shared folder, word and shingle hashing, MinHash signatures."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows handed to Python at once; texts can be long, so batches stay small.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder every machine of the cluster sees, as the session names it; a temporary one if this machine is all there is."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = tempfile.mkdtemp(prefix="proofmill-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Staged tables that are deleted together."""

    def __init__(self, spark: SparkSession) -> None:
        self.folder = f"{shared_dir(spark)}/proofmill/{uuid.uuid4().hex}"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def close(self) -> None:
        path = self._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self._conf).delete(path, True)


#: The open scopes, innermost last; each thread has its own.
_scopes: ContextVar[tuple[Scratch, ...]] = ContextVar("scopes", default=())
#: What is staged outside all scopes, by application; it goes when Python ends.
_loose: dict[str, Scratch] = {}


@contextmanager
def staging(spark: SparkSession) -> Iterator[Scratch]:
    """Tables staged inside are deleted at the end, but those kept for the scope around it.

    Operators open one for what they need in between, so their results rest on what they keep alone. A caller who opens
    one around an operator and the writing of its result has nothing left behind.
    """
    scope = Scratch(spark)
    token = _scopes.set((*_scopes.get(), scope))
    try:
        yield scope
    finally:
        _scopes.reset(token)
        scope.close()


def _scope(spark: SparkSession, keep: bool) -> Scratch:
    inner = _scopes.get()[: -1 if keep else None]
    app = spark.sparkContext.applicationId
    if not inner and app not in _loose:
        _loose[app] = Scratch(spark)
    return inner[-1] if inner else _loose[app]


@atexit.register
def _close_loose() -> None:
    for scope in _loose.values():
        with suppress(Exception):  # Spark may be gone
            scope.close()


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts the lineage and survives lost executors.

    It lives as long as the innermost scope, or with ``keep`` as long as the one around that.
    """
    spark = df.sparkSession
    path = f"{_scope(spark, keep).folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package's folder for Python workers that were started elsewhere."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(4 * BATCH_ROWS))
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``f`` over Arrow batches of bounded size. ``f`` may give None for a batch without output."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = f(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()  # workers live on beside the executor

    prepare(df.sparkSession)
    return df.mapInArrow(over, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; a bounded memo."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``width`` make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n < 1:
        return _mix(np.array([np.bitwise_xor.reduce(h * _MULTIPLIERS[: len(h)]) + np.uint64(len(h))], np.uint64))
    total = h[:n] * _MULTIPLIERS[0]
    for i in range(1, width):
        total += h[i : i + n] * _MULTIPLIERS[i]
    return np.unique(_mix(total))


N_HASHES = 96
_ODD = np.random.default_rng(20240611).integers(0, 2**32, size=(N_HASHES, 1), dtype=np.uint32) | np.uint32(1)
_ADD = np.random.default_rng(20240612).integers(0, 2**32, size=(N_HASHES, 1), dtype=np.uint32)
#: Shingles hashed at once: the block of their hashes stays in the processor's cache.
_BLOCK = 1024


def signature(shingles: np.ndarray, hashes: int = N_HASHES) -> bytes:
    """MinHash of a non-empty set: so many 32-bit minima, little-endian."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), _BLOCK):
        hashed = high[at : at + _BLOCK] * _ODD[:hashes]
        hashed += _ADD[:hashes]
        np.minimum(low, hashed.min(axis=1), out=low)
    return low.astype("<u4").tobytes()
