"""Counters, histograms, quantiles and windowed rates over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds in seconds, infinity last. Fixed values.
RUN_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 300.0, 900.0, 3600.0, float("inf")]
STEP_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 300.0, float("inf")]


def seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def histogram(rows: DataFrame, keys: list[str], value: str, buckets: list[float]) -> DataFrame:
    """Cumulative counts per upper bound. Values are first counted by their own bucket, so what is exploded is keys times bounds."""
    own = F.lit(len(buckets) - 1)
    for i in reversed(range(len(buckets) - 1)):
        own = F.when(F.col(value) <= buckets[i], i).otherwise(own)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, own.alias("_b")).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    wide = counted.groupBy(*keys).agg(*[F.sum(F.when(F.col("_b") <= i, F.col("_n")).otherwise(0)).alias(f"b{i}") for i in range(len(buckets))], F.sum("_v").alias("total"))
    items = F.array(*[F.struct(F.lit("+Inf" if b == float("inf") else repr(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)])
    return wide.select(*keys, "total", F.explode(items).alias("x")).select(*keys, "x.le", "x.n", "total")


def step_outcome() -> Column:
    t = F.col("event_type")
    return F.when(t == "step.completed", "completed").when((t == "step.failed") & F.col("terminal"), "failed").when(t == "step.failed", "retry").when(t == "step.dead_lettered", "dead_lettered")


def first_settles(log: DataFrame) -> DataFrame:
    """Attempts with the first settlement after their start; a later settlement of the attempt observes nothing."""
    rows = log.where(F.col("event_type").isin("step.started", "step.completed", "step.failed", "step.dead_lettered")).withColumn("outcome", step_outcome())
    w = "over (partition by run_id, step_id, attempt order by seq)"
    rows = rows.withColumn("_before", F.expr(f"lag(event_type) {w}")).withColumn("_at", F.expr(f"lag(occurred_at) {w}"))
    return rows.where("outcome is not null and _before = 'step.started'").withColumn("seconds", seconds(F.col("_at"), F.col("occurred_at")))


def run_durations(log: DataFrame) -> DataFrame:
    """Seconds from the start to each terminal event."""
    start = log.where("event_type = 'run.started'").select("run_id", "workflow", F.col("occurred_at").alias("started_at"))
    ends = log.where(F.col("event_type").isin("run.completed", "run.failed", "run.cancelled")).select("run_id", F.substring("event_type", 5, 20).alias("outcome"), "occurred_at")
    return ends.join(start, "run_id").withColumn("seconds", seconds(F.col("started_at"), F.col("occurred_at")))


def approval_waits(approvals: DataFrame) -> DataFrame:
    return approvals.where("approval_status <> 'pending'").withColumn("seconds", seconds(F.col("requested_at"), F.col("decided_at")))


def windowed(rows: DataFrame, length: str, slide: str, keys: list, *aggs: Column) -> DataFrame:
    """Aggregates per sliding window of occurred_at."""
    w = F.window("occurred_at", length, slide)
    return rows.groupBy(w.alias("w"), *keys).agg(*aggs).withColumn("window_start", F.col("w.start")).drop("w")


def bucket_quantile(hist: DataFrame, keys: list[str], q: float, buckets: list[float]) -> DataFrame:
    """Quantile by linear interpolation in a cumulative histogram, as a dashboard computes it; the last bound for the open bucket."""
    le = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.expr("try_cast(le as double)"))
    lists = hist.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(le.alias("le"), F.col("n").cast("double").alias("n")))).alias("h"))
    total = F.element_at("h", -1)["n"]
    rank = F.lit(q) * total
    at = F.size(F.filter("h", lambda x: x["n"] < rank))
    low = F.when(at == 0, 0.0).otherwise(F.get("h", at - 1)["le"])
    below = F.when(at == 0, 0.0).otherwise(F.get("h", at - 1)["n"])
    here = F.get("h", at)
    value = F.when(here["le"] == float("inf"), F.lit(buckets[-2])).otherwise(low + (here["le"] - low) * (rank - below) / (here["n"] - below))
    return lists.where(total > 0).select(*keys, value.alias("quantile"))


def suspended_history(log: DataFrame) -> DataFrame:
    """Suspended runs over time and workflow: a running sum of runs entering and leaving the state, from states after each event."""
    from .fold import state_everywhere

    states = state_everywhere(log, "occurred_at")
    states = states.withColumn("_was", F.expr("lag(status) over (partition by run_id order by seq)"))
    step = F.when((F.col("status") == "suspended") & (F.coalesce("_was", F.lit("")) != "suspended"), 1).when((F.col("status") != "suspended") & (F.col("_was") == "suspended"), -1)
    moves = states.withColumn("step", step).where("step is not null").select("run_id", "occurred_at", "step")
    heads = log.where("event_type = 'run.started'").select("run_id", "workflow")
    daily = moves.join(heads, "run_id").groupBy("workflow", F.to_date("occurred_at").alias("day")).agg(F.sum("step").alias("change"))
    return daily.withColumn("suspended", F.expr("sum(change) over (partition by workflow order by day)"))
