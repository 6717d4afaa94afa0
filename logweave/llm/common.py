"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship as ship_package
from ..functions.storage import cut, shared_dir  # noqa: F401

#: Rows and bytes of an Arrow batch, where the session sets none: whole texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


#: What workers keep from task to task, see worker_cache().
_caches: list[dict] = []


def worker_cache() -> dict:
    """A cache of one operator that outlives its tasks: workers are used again, and keep it until another operator's task lets it go."""
    _caches.append({})
    return _caches[-1]


def let_go(but: dict | None = None) -> None:
    """Empty this worker's caches but one's own: a worker that goes through several operators holds what one of them needs."""
    for held in _caches:
        if held is not but:
            held.clear()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the batches of texts that they get."""
    ship_package(spark)
    for key, ours in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, ours)


def few(df: DataFrame, rows: int) -> DataFrame:
    """No more partitions than the number of rows is worth: tasks and files of tiny tables cost more than their rows."""
    return df.coalesce(8 + rows // 250_000)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def slabs(lengths: list[int], limit: int):
    """Row ranges (start, stop) whose lengths add up to about `limit`; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def masked(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The rows under names that no operator uses: (renamed, its names, new name of each old one)."""
    names = [f"_col{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names, dict(zip(df.columns, names, strict=True))


class Bloom:
    """A filter with one hash: bits set by the low bits of 64-bit hashes."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (self.bits - 1)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def bloom(keys: DataFrame, column: str, most_bits: int = 1 << 26):
    """A broadcast Bloom filter of a column of 64-bit hashes, built by grouped bit-or; at most `most_bits` bits (8 MB), whatever the number of keys."""
    n = keys.count()
    bits = 1 << 16
    while bits < min(16 * n, most_bits):
        bits *= 2
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.select(F.shiftright(at, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Bloom(words, bits))
