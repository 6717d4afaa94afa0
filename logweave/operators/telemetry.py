"""Rebuilding all telemetry from the log: every span and metric table out of one derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import bucketed
from ..sources.run_log import with_workflow
from . import fold, metrics, spans


def tables(log: DataFrame, wide: DataFrame | None = None) -> dict[str, DataFrame]:
    """Span and metric tables by name. The log is read for each of them: hand in one that is written or cached.

    wide: the log with its run's workflow in every row (with_workflow), if that is written already; else each table that wants it shuffles the log.
    """
    wide = with_workflow(log) if wide is None else wide
    settled = metrics.first_settles(wide)
    waits = metrics.approval_waits(fold.approvals(log)).withColumnRenamed("approval_status", "decision")
    count = F.count("*").alias("n")
    return {
        "run_spans": spans.run_spans(log),
        "step_spans": spans.step_spans(log),
        "point_spans": spans.point_spans(log),
        "progress_events": spans.progress_events(log),
        "runs": wide.where(F.col("event_type").isin("run.started", *spans.TERMINAL_EVENTS)).groupBy("workflow", F.substring("event_type", 5, 20).alias("outcome")).agg(count),
        "run_seconds": metrics.histogram(metrics.run_durations(log), ["workflow", "outcome"], "seconds", metrics.RUN_BUCKETS),
        "steps_started": wide.where("event_type = 'step.started'").groupBy("workflow", "step_id", "agent").agg(count),
        "steps_ended": wide.withColumn("outcome", metrics.step_outcome()).where("outcome is not null").groupBy("workflow", "step_id", "outcome").agg(count),
        "step_seconds": metrics.histogram(settled, ["workflow", "outcome"], "seconds", metrics.STEP_BUCKETS),
        "retries_and_dead_letters": wide.where("event_type = 'step.dead_lettered' or (event_type = 'step.failed' and not terminal)").groupBy("workflow", "event_type", F.coalesce("effect_class", F.lit("")).alias("effect_class")).agg(count),
        "approvals": wide.where("event_type like 'approval.%'").groupBy("workflow", "event_type", "effect_class", "principal_kind").agg(count),
        "approval_seconds": metrics.histogram(waits, ["decision"], "seconds", metrics.RUN_BUCKETS),
        "suspended": fold.status(log).where("status = 'suspended'").join(fold.header(log), "run_id").groupBy("workflow").agg(count),
    }


def rebuild(log: DataFrame, folder: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """Write every table of tables() as Parquet into a folder of its own below `folder`, and read them back. The log with its workflows is written first, in buckets by run, so that no table shuffles events by run again.

    buckets: best the number of partitions that the log is dealt into by run; the session's shuffle partitions if not given.
    """
    spark = log.sparkSession
    wide = bucketed(with_workflow(log), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), path=f"{folder}/events")
    out = {}
    for name, rows in tables(wide, wide).items():
        rows.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        out[name] = spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
    return out
