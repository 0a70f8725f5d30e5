"""Words, hashes and table access shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.session import tune

# Arrow batches stay small so that very long texts cannot fill a Python worker.
BATCH_ROWS = 500
CACHE_WORDS = 300_000

# ASCII white space, as bytes.split() cuts it.
BLANK = "\\x20\\x09-\\x0D"

_GAPS = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
ALNUM_LOWER = _GAPS.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return (text or "").encode("utf-8", "replace").lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and everything beyond ASCII, A-Z lowered."""
    return (text or "").encode("utf-8", "replace").translate(ALNUM_LOWER).split()


class WordCache(dict):
    """word -> 64-bit hash; forgets everything when full, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_kept: dict[str, tuple] = {}


def let_go(operator: str | None = None) -> int | None:
    """Drops what other operators kept in earlier stages: workers outlive stages, and their memory adds up."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    for other in [k for k, v in _kept.items() if k != operator and v[0] != stage]:
        del _kept[other]
    return stage


def kept(operator: str, key, make):
    """What an operator keeps in a worker process between batches and tasks, made anew for another ``key``.

    What operators of earlier stages kept is let go.
    """
    stage = let_go(operator)
    if operator not in _kept or _kept[operator][1] != key:
        _kept.pop(operator, None)  # one at a time
        _kept[operator] = (stage, key, make())
    value = _kept[operator][2]
    _kept[operator] = (stage, key, value)
    return value


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser of a public 64-bit mixing function)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_keys(count: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(hashes: np.ndarray, width: int, keys: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of all windows of ``width`` words; a shorter text is one window."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    count = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(count, width, np.uint64)
        for k in range(width):
            total += hashes[k:k + count] * keys[k]
        return np.unique(mixed(total))


def bucket(column, modulus: int):
    """crc32 of an id as text, modulo ``modulus``; null ids fall in bucket null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def gathered(batches, rows: int = 8000):
    """Small batches joined to frames of about ``rows`` rows."""
    part, size = [], 0
    for batch in batches:
        part.append(batch)
        size += len(batch)
        if size >= rows:
            yield pd.concat(part, ignore_index=True)
            part, size = [], 0
    if size:
        yield pd.concat(part, ignore_index=True)
