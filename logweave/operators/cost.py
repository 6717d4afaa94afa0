"""Prices, charges and cost rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def price_lookup(models: DataFrame, prices: DataFrame, free_prefixes: list[str]) -> DataFrame:
    """Price of each distinct model id: exact name, else the first table row of which `name-` is a prefix, else free, else none.

    prices: (place, name, price_in, price_out). Prefixes of an id up to each dash are joined by equality, so no row pairs
    are compared; table order, not length, decides between several.
    """
    ids = models.select("model_id").distinct()
    parts = F.split("model_id", "-")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    tried = ids.withColumn("head", F.explode(F.array_distinct(F.array_append(heads, F.col("model_id")))))
    hit = tried.join(prices, tried["head"] == prices["name"])
    best = hit.groupBy("model_id").agg(F.min_by(F.struct("price_in", "price_out", "name"), F.struct(F.col("head") != F.col("model_id"), "place")).alias("p"))
    free = F.lit(False)
    for f in free_prefixes:
        free = free | F.lower("model_id").startswith(f)
    rows = ids.join(best, "model_id", "left")
    zero = F.lit(0).cast("decimal(12,4)")
    return rows.select(
        "model_id", F.col("p.name").alias("matched"), F.coalesce("p.price_in", F.when(free, zero)).alias("price_in"), F.coalesce("p.price_out", F.when(free, zero)).alias("price_out"),
        (F.col("p").isNotNull() | free).alias("priced"),
    )


def amount(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Charge for tokens at prices per million, half-up to six places; zero where there is no price."""
    exact = (tokens_in.cast("decimal(18,0)") * price_in + tokens_out.cast("decimal(18,0)") * price_out) / F.lit(1000000).cast("decimal(7,0)")
    return F.coalesce(F.round(exact, 6), F.lit(0)).cast("decimal(24,6)")


def amount_text(value: Column) -> Column:
    """Decimal text without trailing zeros."""
    text = F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(text, r"\.$", "")


def meter_rollup(rows: DataFrame) -> DataFrame:
    """Sum of each meter by workflow and agent; meters as (name, quantity) pairs in an array column."""
    return rows.select("workflow", "agent", F.explode("units").alias("u")).groupBy("workflow", "agent", F.col("u.name").alias("meter")).agg(F.sum("u.quantity").alias("quantity"))


def node_latency(log: DataFrame) -> DataFrame:
    """Per step: first start, first completion, starts, duration in ms and cost."""
    rows = log.where(F.col("event_type").isin("step.started", "step.completed"))
    started, done = F.col("event_type") == "step.started", F.col("event_type") == "step.completed"
    out = rows.groupBy("run_id", "step_id").agg(
        F.count(F.when(started, 1)).alias("attempts"), F.min_by(F.when(started, F.col("occurred_at")), F.when(started, F.col("seq"))).alias("started_at"),
        F.min_by(F.when(done, F.col("occurred_at")), F.when(done, F.col("seq"))).alias("finished_at"), F.min_by(F.when(done, F.col("cost")), F.when(done, F.col("seq"))).alias("cost"),
    )
    return out.withColumn("duration_ms", F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("finished_at")))


def reprice(charges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Charges against the price snapshot they name: recomputed amount and difference. Unknown snapshots give nulls."""
    rows = charges.join(snapshots, ["snapshot_hash", "model_id"], "left")
    again = F.when(F.col("price_in").isNotNull(), amount(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))
    return rows.withColumn("recomputed", again).withColumn("difference", F.col("charged") - again)
