"""Shared helpers: shipping the package, scratch tables, word splitting, bounded caches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.sources.scratch import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from its checkout, and send them texts in small batches.

    A cluster without the checkout needs spark.submit.pyFiles. A batch size that
    the session sets is kept.
    """
    env = spark.sparkContext.environment
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":  # texts are long rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach; on one machine, where the session names none, below a temporary one that goes with the process."""
    return scratch_path(spark)


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS = 200_000  # rows of a table of keys and numbers that is broadcast, at most


def few(df: DataFrame) -> DataFrame:
    """`df`, broadcast if it has at most ROWS rows; a larger one is joined by a shuffle, where skewed keys are split."""
    return F.broadcast(df) if df.limit(ROWS + 1).count() <= ROWS else df


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """`fn` on each Arrow batch of `df`; it returns the output columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                cols = fn(part)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes or one row, whichever is more."""
    n = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for k in range(0, batch.num_rows, n):
        yield batch.slice(k, n)


def free_key(taken: set[str], name: str) -> str:
    """A column name that is not taken."""
    while name in taken:
        name += "_"
    return name


def text_bytes(col: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


class WordCache(dict):
    """word -> value of `make(word)`, for the words of the last `most` to 2 * `most` misses and those met since."""

    def __init__(self, make: Callable, most: int = 60_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value


MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def scrambled(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = scrambled(out * MIX + h[k : len(h) - n + 1 + k])
    return out
