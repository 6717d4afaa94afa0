"""Whitening of vectors from an exact integer scatter matrix.

Entries are quantised to integers. A block of rows shifts each dimension to its least value, so that few bit planes are left;
the planes of a dimension are packed across the rows of the block, 64 rows a word. The cross-product of two dimensions is then a
sum of popcounts of ANDed words, weighted by the planes' powers of two, and undoing the shift takes the dimensions' own sums.
Blocks give integers that Spark adds as decimals; the driver holds one number per pair of dimensions, centres them as integers
and takes the eigenvectors. Two more passes over the rows measure the whitened covariance and give the result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: An entry c becomes floor(GRID * c) + SHIFT. The shift does not matter to centred figures, so passes leave it out.
GRID, SHIFT = 64, 1_000_000
#: Rows of a block, in words of 64; bytes of ANDed words at once; entries from this size are an error; eigenvalues below this share of the largest count as none.
ROWS, AT_ONCE, LARGEST, NO_VARIANCE = 4096, 4 << 20, 2**52, 1e-12


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(GRID * c) as integers, without SHIFT."""
    z = np.floor(values.astype(np.float64) * GRID)
    if z.size and np.abs(z).max() >= LARGEST:
        raise ValueError(f"an entry of a vector is beyond {LARGEST // GRID}: its integer would not be exact")
    return z.astype(np.int64)


def bit_planes(y: np.ndarray) -> list[np.ndarray]:
    """Plane b of non-negative integers (rows, dimensions): bit b of each dimension, packed across rows into 64-bit words (dimensions, words)."""
    rows, dims = y.shape
    full = np.zeros((dims, -(-rows // 64) * 64), np.int64)
    full[:, :rows] = y.T
    return [np.packbits((full >> b & 1).astype(np.uint8), axis=1).view(np.uint64) for b in range(int(y.max(initial=0)).bit_length())]


def popcounts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of rows with both bits, for each pair of dimensions."""
    out = np.empty((len(a), len(b)), np.int64)
    step = max(1, AT_ONCE // max(1, b.nbytes))
    for lo in range(0, len(a), step):
        out[lo : lo + step] = np.bitwise_count(a[lo : lo + step, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def scatter(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of a block's integers (rows, dimensions), by bit planes; Python integers."""
    low = z.min(axis=0)
    y = z - low
    planes = bit_planes(y)
    small = len(planes) <= 24 and np.abs(low).max() < 1 << 24
    kind = np.int64 if small else object
    cross = np.zeros((z.shape[1], z.shape[1]), kind)
    for a, pa_ in enumerate(planes):
        for b in range(a, len(planes)):
            counts = popcounts(pa_, planes[b]).astype(kind)
            cross += (counts if a == b else counts + counts.T) * (1 << (a + b))
    sums, low = y.astype(kind).sum(axis=0), low.astype(kind)
    # y = z - low: put the shift back
    cross = cross + np.outer(low, sums) + np.outer(sums, low) + len(z) * np.outer(low, low)
    return (sums + len(z) * low).astype(object), cross.astype(object)


def _blocks(batches, dims: int, at: int = 0):
    """Integers of whole blocks of rows, however small the batches are."""
    held, n = [], 0
    for b in batches:
        z = quantised(b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
        held.append(z)
        n += len(z)
        while n >= ROWS:
            z = np.concatenate(held)
            yield z[:ROWS]
            held, n = [z[ROWS:]], n - ROWS
    if n:
        yield np.concatenate(held)


def total_scatter(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of rows, sums, cross-products) of all rows' integers: dims squared numbers reach the driver, whatever the number of rows."""
    left, right = np.triu_indices(dims)

    def run(batches):
        n, sums, cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for z in _blocks(batches, dims):
            s, c = scatter(z)
            n, sums, cross = n + len(z), sums + s, cross + c
        if n:
            i = np.concatenate([left, np.arange(dims), [-1]])
            j = np.concatenate([right, np.full(dims + 1, -1)])
            v = [Decimal(int(x)) for x in [*cross[left, right], *sums, n]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.decimal128(38, 0))], ["i", "j", "v"])

    found = vectors.select("_v").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow().to_pydict()
    n, sums, cross = 0, [0] * dims, np.zeros((dims, dims), object)
    for i, j, v in zip(found["i"], found["j"], found["v"], strict=True):
        if i < 0:
            n = int(v)
        elif j < 0:
            sums[i] = int(v)
        else:
            cross[i, j] = cross[j, i] = int(v)
    return n, np.array(sums, object), cross


class Whitening:
    """Number of rows, exact sums, and unit components with their eigenvalues, by falling eigenvalue."""

    def __init__(self, n: int, sums: np.ndarray, cross: np.ndarray, most: int):
        self.n, self.sums = n, sums
        # n * n times the covariance, exact; one rounding to double each
        self.centred = n * cross - np.outer(sums, sums)
        v = np.array([[x / (n * n) for x in row] for row in self.centred], np.float64)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:most]
        self.values, self.vectors = values[order], vectors[:, order]
        # either sign would do: the largest entry is positive
        top = np.abs(self.vectors).argmax(axis=0)
        self.vectors = self.vectors * np.where(self.vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)
        self.trace = float(np.trace(v))
        self.live = self.values > max(NO_VARIANCE * float(values.max(initial=0.0)), 0.0)
        self.mean = np.array([s / n for s in sums], np.float64)
        self.scale = 1.0 / np.sqrt(np.where(self.live, self.values, 1.0))

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z - self.mean) @ self.vectors * self.scale

    def deviations(self, z: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) squared, exact."""
        most = int(max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0))))) * self.n + max((abs(int(s)) for s in self.sums), default=0)
        kind = np.int64 if most * most * z.shape[1] < 1 << 62 else object
        d = self.n * z.astype(kind) - self.sums.astype(kind)
        return [int(x) for x in (d * d).sum(axis=1)]


def _identity_error(vectors: DataFrame, sent, dims: int) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components that have variance."""
    live = np.flatnonzero(sent.value.live)
    if not len(live):
        return None
    left, right = np.triu_indices(len(live))

    def run(batches):
        m, first, second = sent.value, 0.0, 0.0
        for z in _blocks(batches, dims):
            w = m.whitened(z)[:, live]
            first, second = first + w.sum(axis=0), second + w.T @ w
        if not np.isscalar(first):
            i = np.concatenate([left, np.arange(len(live))])
            j = np.concatenate([right, np.full(len(live), -1)])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([second[left, right], first]))], ["i", "j", "v"])

    found = vectors.select("_v").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = sent.value.n
    mean = {r["i"]: r["v"] / n for r in found if r["j"] < 0}
    return float(max(abs(r["v"] / n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in found if r["j"] >= 0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """One row per vector and component (id, component from 1, n, deviation decimal(38,0), whitened, explained, identity_error).

    Rows whose vector is null or empty, or holds a null, NaN or infinite entry, are dropped, and so are vectors of another length
    than most vectors have (the longer of two equally frequent ones counts). Null ids, repeated ids and repeated vectors are rows
    like others. A component without variance (one row, equal rows, dependent dimensions) has a null `whitened`; `explained` is
    null where nothing varies, and so is `identity_error`. Vectors of fewer dimensions than `most` have a component a dimension;
    no rows give no rows. An entry of 2^46 or more in size raises an error. Other columns are left out, whatever their names.
    """
    spark = rows.sparkSession
    ship(spark)
    v = F.col("_v")
    kind = dict(rows.dtypes)[id_col]
    clean = rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("_v")).where(
        v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    widest = clean.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if widest is None:
        return spark.createDataFrame([], schema)
    dims = widest["d"]
    clean = clean.where(F.size(v) == dims)
    sent = spark.sparkContext.broadcast(Whitening(*total_scatter(clean, dims), most))
    error = _identity_error(clean, sent, dims)

    def run(batches):
        m = sent.value
        k = len(m.values)
        for b in batches:
            z = quantised(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            each = np.repeat(np.arange(len(z)), k)
            deviation = pa.array([Decimal(x) for x in m.deviations(z)], pa.decimal128(38, 0))
            dead = np.tile(~m.live, len(z))
            explained = np.tile(m.values / m.trace if m.trace > 0 else np.zeros(k), len(z))
            columns = [
                b.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))),
                pa.array(np.full(len(each), m.n)),
                deviation.take(pa.array(each)),
                pa.array(m.whitened(z).ravel(), mask=dead),
                pa.array(explained, mask=np.full(len(each), m.trace <= 0)),
                pa.array([error] * len(each), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    return clean.mapInArrow(run, schema)
