"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotgap.plans.components import ensure_checkpoint_dir

#: Fixed pattern: what separates words.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the value written as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def native_words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Hashed(dict):
    """64-bit hash of a word, remembered; forgets everything once ``most`` words are held."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as compressed Parquet: for tables with many small rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``stored`` once everything read from them has been written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    time.sleep(2)  # references held for Python are given up in the background, once a second
    spark.sparkContext._jvm.System.gc()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of each pair of hashes."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words, by doubling from single words."""
    if len(words) < length:
        return words[:0]
    now, size = words, 1
    while 2 * size <= length:
        now, size = mixed(now[:-size], now[size:]), 2 * size
    return mixed(now[:len(words) - length + 1], now[length - size:]) if size < length else now


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    now, size = values, 1
    while 2 * size <= width:
        now, size = np.minimum(now[:-size], now[size:]), 2 * size
    return np.minimum(now[:len(values) - width + 1], now[width - size:]) if size < width else now
