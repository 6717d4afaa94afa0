"""Word shingles and exact Jaccard links inside groups of candidates.

Groups of any size are dealt out as pairs of blocks, so a task holds two blocks at most; within one only a spanning forest of
the verified links is emitted, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than `width`: one shingle of them all."""
    return np.unique(all_shingles(words, width))


def all_shingles(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included."""
    return np.frombuffer(shingle_digests(words, width), ">u8").astype(np.uint64)


def shingle_digests(words: list[bytes], width: int) -> bytes:
    """The same as bytes, eight for each shingle."""
    joined = b" ".join(words)
    digest = xxhash.xxh3_64_digest
    if len(words) <= width:
        return digest(joined)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b"".join([digest(joined[s:e]) for s, e in zip((ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)])


def jaccard_forest(pids: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs at `threshold` or more."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    values, ids = np.unique(flat, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(values), np.int64)
    unseen = np.ones(len(sets), bool)
    links = []
    for first in range(len(sets)):
        if not unseen[first]:
            continue
        unseen[first] = False
        frontier = [first]
        while frontier and unseen.any():
            x = frontier.pop()
            own = ids[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            common = np.add.reduceat(mark[ids], starts)
            mark[own] = 0
            near = unseen & (common >= threshold * (sizes + sizes[x] - common) - 1e-9)
            for y in np.flatnonzero(near):
                links.append((int(pids[x]), int(pids[y])))
                frontier.append(int(y))
            unseen &= ~near
    return links


def _links_of(pids: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    if len(pids) < 2:
        return []
    if len(pids) == 2:
        x, y = sets
        common = len(np.intersect1d(x, y, assume_unique=True))
        return [(pids[0], pids[1])] if common >= threshold * (len(x) + len(y) - common) - 1e-9 else []
    return jaccard_forest(np.array(pids), sets, threshold)


def _verify(threshold: float):
    """Over rows (bucket, i, j, pid, shingles) sorted by (bucket, i, j): links (a, b)."""

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], ["a", "b"])

    def run(batches):
        now, pids, sets = None, [], []
        for b in batches:
            found = []
            keys = list(zip(*[b.column(i).to_pylist() for i in range(4)], strict=True))
            shingles = b.column(4)
            offsets = shingles.offsets.to_numpy()
            flat = shingles.values.to_numpy(zero_copy_only=False)
            for r, (x, i, j, pid) in enumerate(keys):
                if (x, i, j) != now:
                    found += _links_of(pids, sets, threshold)
                    now, pids, sets = (x, i, j), [], []
                pids.append(pid)
                sets.append(flat[offsets[r] : offsets[r + 1]].copy())
            if found:
                yield batch(found)
        yield batch(_links_of(pids, sets, threshold))

    return run


def block_pairs(members: DataFrame, block: int) -> DataFrame:
    """Rows (bucket, pid, size of the bucket) as rows (bucket, i, j, pid): one for each pair of blocks the member is in."""
    own = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = own.withColumn("i", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"))
    pairs = own.select("bucket", "pid", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    return pairs.select("bucket", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "pid")


def verified_links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning set of the links of each bucket. pairs: (bucket, i, j, pid); sets: (pid, shingles)."""
    work = pairs.join(sets, "pid").select("bucket", "i", "j", "pid", "shingles").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return work.mapInArrow(_verify(threshold), "a bigint, b bigint")
