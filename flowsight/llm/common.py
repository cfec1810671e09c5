"""Shared parts of the training-data operators: stored tables, batches of rows, word digests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowsight.runtime import ensure_checkpoint_dir

#: Bytes that separate words: space and 0x09 to 0x0D. They are never part of a longer UTF-8 sequence.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_STEP = 0x9E3779B97F4A7C15

Batches = Iterator[pa.RecordBatch]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand rows to Python in batches of at most so many rows and about 8 MB, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def stored(df: DataFrame) -> DataFrame:
    """Write the rows once as Parquet below the shared checkpoint folder and read them from there.

    Plans that follow see only the columns they need, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, function: Callable[[Batches], Batches], schema: str, rows: int = 1000) -> DataFrame:
    small_batches(df.sparkSession, rows)
    return df.mapInArrow(function, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = _STEP):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 14, 1 << (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


_BYTES = Powers()
_WORDS = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words of a UTF-8 text."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = SPACES[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_digests(data: bytes) -> np.ndarray:
    """A 64-bit digest of each word of a UTF-8 text, from prefix sums over its bytes."""
    starts, ends = word_bounds(data)
    up, down = _BYTES.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(data, dtype=np.uint8) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Spans:
    """Digests of any spans of a sequence of word digests, each in constant time."""

    def __init__(self, words: np.ndarray, which: int = 0):
        up, self.down = _WORDS[which].to(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def digest(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
