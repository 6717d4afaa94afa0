"""Trace spans derived from events; the same log always gives the same spans and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL_EVENTS = ["run.completed", "run.failed", "run.cancelled"]
SETTLES = ["step.completed", "step.failed", "step.dead_lettered", "step.cancelled"]
POINTS = ["approval.requested", "approval.granted", "approval.rejected", "executor.substituted", "step.dead_lettered", "run.suspended", "run.paused", "run.resumed"]


def trace_id(run_id: Column) -> Column:
    """A run id of 32 hex digits is the trace id; anything else is hashed to that size."""
    return F.when(run_id.rlike("^[0-9a-f]{32}$"), run_id).otherwise(F.substring(F.sha2(run_id, 256), 1, 32))


def run_span_id(run_id: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("run:"), run_id), 256), 1, 16)


def run_spans(log: DataFrame) -> DataFrame:
    """One span per terminal event, from the run's start."""
    start = log.where("event_type = 'run.started'").select("run_id", "workflow", F.col("occurred_at").alias("started_at"))
    end = log.where(F.col("event_type").isin(TERMINAL_EVENTS)).select("run_id", "seq", "event_type", "error", F.col("occurred_at").alias("ended_at"))
    rows = end.join(start, "run_id", "left")
    return rows.select(
        trace_id(F.col("run_id")).alias("trace_id"), run_span_id(F.col("run_id")).alias("span_id"), F.concat(F.lit("run "), F.coalesce("workflow", F.lit("unknown"))).alias("name"),
        F.coalesce("started_at", "ended_at").alias("started_at"), "ended_at", F.when(F.col("event_type") == "run.completed", "OK").otherwise("ERROR").alias("status"), "error",
    )


def step_spans(log: DataFrame) -> DataFrame:
    """One span per started attempt: to its first settlement after the start, else to the run's next terminal event.

    A second settlement of an attempt finds no open span. An attempt started again replaces the span before it.
    """
    rows = log.where(F.col("event_type").isin("step.started", *SETTLES, *TERMINAL_EVENTS))
    # terminal events stand in groups of their own: they carry no attempt
    w = "over (partition by run_id, step_id, attempt, substr(event_type, 1, 4) order by seq)"
    rows = rows.withColumn("_kind", F.expr(f"lead(event_type) {w}")).withColumn("_end", F.expr(f"lead(occurred_at) {w}")).withColumn("_error", F.expr(f"lead(error) {w}"))
    # the run's next terminal event comes along in one running window by run
    terminal = ", ".join(f"'{x}'" for x in TERMINAL_EVENTS)
    out = rows.withColumn("run_end", F.expr(f"first(case when event_type in ({terminal}) then occurred_at end, true) over (partition by run_id order by seq rows between 1 following and unbounded following)"))
    out = out.where("event_type = 'step.started' and (_kind is null or _kind <> 'step.started')")
    settled = F.col("_kind").isNotNull()
    return out.where(settled | F.col("run_end").isNotNull()).select(
        "run_id", "step_id", "attempt", "agent", F.col("occurred_at").alias("started_at"), F.when(settled, F.col("_end")).otherwise(F.col("run_end")).alias("ended_at"),
        F.when(F.col("_kind") == "step.completed", "OK").otherwise("ERROR").alias("status"), F.when(settled, F.substring_index("_kind", ".", -1)).otherwise("unsettled").alias("outcome"),
        F.when(settled, F.col("_error")).otherwise("run ended before step settled").alias("error"),
    )


def point_spans(log: DataFrame) -> DataFrame:
    """Zero-length children of the run span."""
    rows = log.where(F.col("event_type").isin(POINTS))
    return rows.select(trace_id(F.col("run_id")).alias("trace_id"), run_span_id(F.col("run_id")).alias("parent_id"), "seq", F.col("event_type").alias("name"), F.col("occurred_at").alias("at"), "step_id", "approval_id")


def progress_events(log: DataFrame) -> DataFrame:
    """Progress reports inside the span of their attempt, in order."""
    rows = log.where(F.col("event_type").isin("step.started", "step.progress", *SETTLES))
    w = "over (partition by run_id, step_id, attempt order by seq rows between unbounded preceding and 1 preceding)"
    rows = rows.withColumn("_last", F.expr(f"max_by(event_type, case when event_type <> 'step.progress' then seq end) {w}"))
    inside = rows.where("event_type = 'step.progress' and _last = 'step.started'")
    return inside.groupBy("run_id", "step_id", "attempt").agg(F.array_sort(F.collect_list(F.struct("seq", "fraction"))).alias("events"))


def completion_attributes(log: DataFrame) -> DataFrame:
    """Attributes of a completed step's span as a map; token meters take their conventional names."""
    done = log.where("event_type = 'step.completed'")
    fixed = F.create_map(F.lit("cost.amount"), F.col("cost").cast("double").cast("string"), F.lit("cost.currency"), F.lit("USD"))
    model = F.when(F.col("model_id").isNotNull(), F.create_map(F.lit("gen_ai.request.model"), F.col("model_id"))).otherwise(F.create_map().cast("map<string,string>"))
    meters = F.map_from_arrays(F.array(F.lit("gen_ai.usage.input_tokens"), F.lit("meter.requests")), F.array(F.col("tokens").cast("string"), F.lit("1")))
    return done.select("run_id", "step_id", "seq", F.map_concat(fixed, model, meters).alias("attributes"))
