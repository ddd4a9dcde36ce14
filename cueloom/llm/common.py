"""Shared helpers: tables of the driver, bounded batches and worker states, byte views, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..shared import removed_at_exit, shared_dir, shared_table  # noqa: F401

T = TypeVar("T")
#: Texts handled together inside one Arrow batch; bounds the worker's memory.
SLICE = 256
#: Entries of a worker's word cache before it starts anew.
CACHE_LIMIT = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_list(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Rows and bytes of an Arrow batch on its way to or from Python.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def limit_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches, where they are higher, so that long texts do not make large ones."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub(r"\D.*", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def _trim() -> None:
    """Gives freed memory back, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """``run``, a function over batches, that gives freed memory back when it is through: workers stay for later tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            _trim()

    return wrapped


_STATE: dict = {}


def worker_state(key, build: Callable[[], T]) -> T:
    """What ``build`` gives, once a Python worker and key. A worker holds the state of one operator at a time."""
    if key not in _STATE:
        if _STATE:
            _STATE.clear()
            gc.collect()
            _trim()
        _STATE[key] = build()
    return _STATE[key]


class WordHashes(dict):
    """Word bytes -> 64-bit hash, remembered up to CACHE_LIMIT words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64-bit lanes (splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(seed: int, count: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers made by a rule from ``seed``."""
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(steps + np.uint64(seed)) | np.uint64(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(k), np.uint64)
    for i, factor in enumerate(odd_constants(k, k)):
        total += words[i : i + n] * factor
    return mix64(total)
