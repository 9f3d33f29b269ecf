"""Helpers of the operators: staged tables, words, and vector hashes over word sequences."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake.session import new_path

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Words whose hash a worker remembers; beyond it the memory starts anew. Results do not depend on it.
REMEMBERED_WORDS = 150_000


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back, which cuts the lineage.

    An executor may be lost afterwards without anything being computed again. Shuffle files of the
    write are freed as soon as it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() parts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to REMEMBERED_WORDS words."""

    def __missing__(self, word) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of a hash, so that its order and its low bits look random."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def sequence_hashes(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """The polynomial hash of every run of n hashes, in log n vector steps (none if there are fewer)."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, length = np.zeros(size, np.uint64), 0, h, 1
    while True:
        if n & length:
            out += np.uint64(pow(base, done, 1 << 64)) * run[done : done + size]
            done += length
        if done == n:
            return mix(out)
        run = run[:-length] + np.uint64(pow(base, length, 1 << 64)) * run[length:]
        length *= 2


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every run of n values, in log n vector steps."""
    run, length = x, 1
    while length * 2 <= n:
        run = np.minimum(run[:-length], run[length:])
        length *= 2
    return run if length == n else np.minimum(run[: len(x) - n + 1], run[n - length :])


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none clashes with columns made beside it; ``select("r.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])
