"""Running values over runs of any length: a scan in two levels.

A window by run is one task's work for each run. Sums, maxima and last values are associative, so a run is cut into blocks of its
order column: each block gives one summary, a window over a run's summaries gives what each block starts from, and windows within
blocks, all in parallel, add that start. A run of a billion events is then ten thousand blocks of work and one window over as many
summaries. Results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Events of a block.
BLOCK = 100_000


def running(rows: DataFrame, values: dict[str, tuple[str, Column]], block: int = BLOCK, key: str = "run_id", order: str = "seq") -> DataFrame:
    """The rows with a running value for each name. values: name -> (kind, column).

    Kinds, over the rows of the key up to and with this one: sum, max, last (newest value that is not null); before: the newest
    value that is not null, without this row. A sum over nulls only is null. `order` is a whole number; rows of equal order are
    one step of a plain window, so it should be unique within the key. The rows are read twice: give a stored table.
    """
    names = {n: f"_v{i}" for i, n in enumerate(values)}
    at = F.floor(F.col(order) / F.lit(block)).cast("bigint")
    held = rows.select("*", at.alias("_b"), *[_packed(kind, value, order).alias(names[n]) for n, (kind, value) in values.items()])
    gather = {n: F.sum if kind == "sum" else F.max for n, (kind, _) in values.items()}
    starts = held.groupBy(key, "_b").agg(*[gather[n](names[n]).alias(f"{names[n]}c") for n in values])
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(key, "_b", *[gather[n](f"{names[n]}c").over(before).alias(f"{names[n]}c") for n in values])
    out = held.join(starts, [key, "_b"], "left")
    inside = W.partitionBy(key, "_b").orderBy(order)
    for n, (kind, _) in values.items():
        w = inside.rowsBetween(W.unboundedPreceding, -1 if kind == "before" else W.currentRow)
        own, carried = gather[n](names[n]).over(w), F.col(f"{names[n]}c")
        both = F.when(own.isNull(), carried).when(carried.isNull(), own)
        both = both.otherwise(own + carried if kind == "sum" else F.greatest(own, carried) if kind == "max" else own)
        out = out.withColumn(n, both if kind in ("sum", "max") else both["value"])
    return out.drop("_b", *names.values(), *[f"{x}c" for x in names.values()])


def newest_before(rows: DataFrame, name: str, value: Column, block: int = BLOCK, key: str = "run_id", order: str = "seq") -> DataFrame:
    """The rows with the newest value before each that is not null, as running() gives it, without a join of rows to starts.

    Most rows find it in their own block. Those that do not, a block's first ones, come along in the block's summary, which then
    meets what the blocks before have left. Rows in buckets by key are not dealt again; others are dealt once, by key and block.
    """
    at = F.floor(F.col(order) / F.lit(block)).cast("bigint")
    inside = W.partitionBy(key, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    held = rows.withColumn("_b", at).withColumn("_v", value).withColumn(name, F.last("_v", True).over(inside))
    found = held.where(F.col(name).isNotNull()).select(*rows.columns, name)
    heads = F.collect_list(F.when(F.col(name).isNull(), F.struct(*rows.columns))).alias("_heads")
    blocks = held.groupBy(key, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_v"), heads)
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("_heads", F.last("_v", True).over(before).alias(name))
    # heads first, as they come first in their runs
    return carried.select(F.explode("_heads").alias("_h"), name).select("_h.*", name).unionByName(found)


def _packed(kind: str, value: Column, order: str) -> Column:
    """What a block adds up: the value, or the value behind its place."""
    return value if kind in ("sum", "max") else F.when(value.isNotNull(), F.struct(F.col(order).alias("at"), value.alias("value")))
