"""Sketches kept by group and day, and merged for coarser groups without reading the log again.

Distinct counts are HyperLogLog sketches (2^lg entries, relative standard error about 1.04 / sqrt(2^lg)); quantiles are KLL
sketches (rank error about 1.3 % at k = 200). Sketches are a few kilobytes whatever they have seen, so a table of them by workflow
and day answers questions by month or over all workflows from as many rows as there are days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG, K = 12, 200


def daily(rows: DataFrame, keys: list[str], distinct: list[str], values: list[str], at: str = "occurred_at", lg: int = LG, k: int = K) -> DataFrame:
    """(keys, day, n, hll_<column> of each distinct column, kll_<column> of each value). Nulls are not counted; a day of nulls only has an empty sketch."""
    counts = [F.hll_sketch_agg(c, lg).alias(f"hll_{c}") for c in distinct]
    quantiles = [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"kll_{c}") for c in values]
    return rows.groupBy(*keys, F.to_date(at).alias("day")).agg(F.count("*").alias("n"), *counts, *quantiles)


def merged(table: DataFrame, *keys) -> DataFrame:
    """The sketches of each coarser group (columns or expressions; none: all together)."""
    parts = [F.sum("n").alias("n")]
    parts += [F.hll_union_agg(c, True).alias(c) for c in table.columns if c.startswith("hll_")]
    parts += [F.kll_merge_agg_double(c).alias(c) for c in table.columns if c.startswith("kll_")]
    return table.groupBy(*keys).agg(*parts)


def distinct_count(column: str):
    """Column: the estimate of a distinct sketch; exact for few values."""
    return F.hll_sketch_estimate(column)


def quantile(column: str, q: float):
    """Column: a value whose rank is near `q`; null for an empty sketch."""
    return F.when(F.kll_sketch_get_n_double(column) > 0, F.kll_sketch_get_quantile_double(column, F.lit(q)))
