"""Row-level views of a run's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is told of an event, by type. The texts.
WHO = "'by ' || principal_kind"
DETAILS = {
    "step.started": "'attempt ' || coalesce(attempt, 1)",
    "step.completed": "if(cost <> 0, 'cost ' || cast(cost as decimal(18,4)), null)",
    "step.progress": "cast(round(fraction * 100) as bigint) || '%'",
    "step.failed": "error",
    "step.dead_lettered": "error",
    "run.failed": "error",
    "approval.requested": "effect_class",
    "approval.granted": WHO,
    "approval.rejected": WHO,
    "run.cancel_requested": WHO,
    "run.pause_requested": WHO,
    "run.resumed": WHO,
    "step.retry_requested": WHO,
    "governance.policy_applied": "'policy ' || left(policy, 12) || if(narrowed > 0, ', ' || narrowed || ' narrowing(s)', '')",
    "executor.substituted": "from_model || ' → ' || model_id",
}
SEAL_DETAILS = {"integrity.sealed": "'seals seq ' || sealed_seq || ' (key ' || key_id || ')'"}


def salient(details: dict[str, str] = DETAILS) -> Column:
    """The field of an event that comes first in a listing, as text; empty where its type has none or the field is null.

    details: event type to SQL expression. DETAILS is for a run log, SEAL_DETAILS for a chain with its seal columns; a log that has both takes both.
    """
    return F.expr(f"coalesce(case event_type {' '.join(f"when '{kind}' then {text}" for kind, text in details.items())} end, '')")


def family() -> Column:
    return F.substring_index("event_type", ".", 1)


def with_gap(log: DataFrame) -> DataFrame:
    """Signed milliseconds since the event before, by seq; null at a run's start."""
    before = F.expr("lag(occurred_at) over (partition by run_id order by seq)")
    return log.withColumn("_before", before).withColumn("gap_ms", F.timestamp_diff("MILLISECOND", F.col("_before"), F.col("occurred_at"))).drop("_before")


def of_step(log: DataFrame, step_id: str) -> DataFrame:
    """Events of one step and those of the run itself."""
    return log.where(F.col("step_id").isNull() | (F.col("step_id") == step_id))


def decided(approvals: DataFrame) -> DataFrame:
    """Decided approvals with their place in decision order within the run."""
    place = F.expr("cast(row_number() over (partition by run_id order by decided_at, decided_seq) as bigint)")
    return approvals.where("approval_status <> 'pending'").withColumn("place", place)
