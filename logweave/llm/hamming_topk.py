"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are reduced to distinct values that carry their k smallest ids, all that a top-k can need of them. Each code is indexed
by its `segments` bit segments. To cover Hamming distance R the queries still open probe segment b = R mod m with every
value at distance exactly a = R div m from their own, after all smaller R. Then each code within distance R has been met: if
all segments differed by more than they have been probed with, the distance would exceed R. So a query is finished once its k-th
best verified distance is at most R. Candidates are verified in the join's condition against the query's k-th best so far.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

BITS = 64


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): bit i is set if component i is above zero. Null vectors and ids are left out; null or missing components count as zero.

    A code has 64 bits: a longer vector raises an error, as its further components would be lost.
    """
    v = F.when(F.size(vector_col) > BITS, F.raise_error(F.lit(f"a vector has more than {BITS} components"))).otherwise(F.col(vector_col))
    code = F.aggregate(
        F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x),
    )
    return vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), code.alias("code"))


def _with_masks(rows: DataFrame, width: int, weight: int, offset: int) -> DataFrame:
    """Each row once for every mask of `weight` bits in a segment: C(width, weight) rows, one exploded position after another."""
    rows = rows.withColumn("mask", F.lit(0).cast("bigint")).withColumn("_p", F.lit(-1))
    for i in range(weight):
        rows = rows.withColumn("_p", F.explode(F.sequence(F.col("_p") + 1, F.lit(width - weight + i))))
        rows = rows.withColumn("mask", F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_p") + offset)))
    return rows.drop("_p")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k first rows of each query by distance, then id."""
    w = W.partitionBy("q").orderBy("distance", "id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _steps(m: int, width: list[int]):
    """(radius covered afterwards, [(segment, probe distance), ...]): all segments at once while probes are few, then one by one."""
    for a in range(max(width) + 1):
        own = [(b, a) for b in range(m) if a <= width[b]]
        if a < 3:
            yield m * (a + 1) - 1, own
        else:
            for b, _ in own:
                yield m * a + b, [(b, a)]


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of `base` for each row of `queries`, by Hamming distance, then id.

    Both have columns (id, code). A query finds itself if it is in `base`. With fewer than k rows in `base`, all are returned.
    Repeated ids in `base` are one row for each (id, code); empty inputs give no rows.
    """
    spark = base.sparkSession
    base = base.distinct()
    by_code = W.partitionBy("code").orderBy("id")
    firsts = base.withColumn("_r", F.row_number().over(by_code)).where(F.col("_r") <= k)
    index = cut(firsts.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    n = index.count()
    rows = firsts.count() if n < k else k + 1  # only whether all of them fit into k matters
    total = min(k, rows)
    # segments of log2(n) bits at most: a bucket holds a code or more on average, so few probes go to empty ones
    m = segments or min(8, max(2, math.ceil(BITS / max(8.0, math.log2(max(n, 2))))))
    width = [BITS // m + (j < BITS % m) for j in range(m)]
    offset = [sum(width[:j]) for j in range(m)]
    # copies of a query's code share one search
    wanted = cut(queries.select("id", "code").distinct())
    open_q = wanted.select("code").distinct().select(F.monotonically_increasing_id().alias("q"), F.col("code").alias("qcode"), F.lit(BITS).alias("worst"))
    open_q = cut(open_q)
    names = open_q.select("q", "qcode")
    best = None
    finished = []
    for step in _steps(m, width):
        if n == 0 or open_q.isEmpty():
            break
        r = step[0]
        probes = side = None
        for b, a in step[1]:
            seg = ((1 << width[b]) - 1) << offset[b]
            seg = F.lit(seg - (1 << 64) if seg >> 63 else seg)
            p = _with_masks(open_q, width[b], a, offset[b]).select("q", "qcode", "worst", F.lit(b).alias("seg"), F.col("qcode").bitwiseAND(seg).bitwiseXOR(F.col("mask")).alias("key"))
            s = index.select("code", "ids", F.lit(b).alias("seg"), F.col("code").bitwiseAND(seg).alias("key"))
            probes, side = (p, s) if probes is None else (probes.unionByName(p), side.unionByName(s))
        near = _distance(F.col("qcode"), F.col("code"))
        hits = probes.join(side, (probes["seg"] == side["seg"]) & (probes["key"] == side["key"]) & (near <= F.col("worst"))).select("q", "code", "ids", near.alias("distance"))
        hits = hits.select("q", F.explode("ids").alias("id"), "distance")
        met = hits if best is None else hits.unionByName(best)
        best = cut(_best(met.distinct(), k))
        state = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        state = open_q.select("q", "qcode").join(state, "q", "left")
        done = (F.coalesce("n", F.lit(0)) >= total) & ((F.coalesce("far", F.lit(BITS)) <= r) | F.lit(rows <= k))
        state = cut(state.select("q", "qcode", done.alias("done"), F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(BITS)).alias("worst")))
        finished.append(best.join(state.where("done"), "q", "left_semi"))
        open_q = state.where("not done").select("q", "qcode", "worst")
        best = best.join(open_q, "q", "left_semi")
    if not finished:
        finished = [spark.createDataFrame([], "q bigint, id bigint, distance int")]
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "id")).cast("bigint"))
    named = wanted.select(F.col("id").alias("query_id"), F.col("code").alias("qcode")).join(names, "qcode").select("query_id", "q")
    return named.join(out, "q").select("query_id", "rank", "id", F.col("distance").cast("bigint").alias("distance"))
