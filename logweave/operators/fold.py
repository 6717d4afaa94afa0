"""State of every run: the fold of its events, as grouped aggregates.

Every field is "last setter by seq", a first, a sum or an ordered list, so runs of any length aggregate partially. Order is
always (run_id, seq). Input is a log with the columns of sources.run_log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut
from .scan import BLOCK, running

#: Status that an event sets; a grant sets it only on a suspended run without other pending approvals. Fixed values.
SETTERS = {
    "run.started": "running", "run.completed": "completed", "run.failed": "failed", "run.cancelled": "cancelled",
    "run.paused": "paused", "run.suspended": "suspended", "run.resumed": "running", "step.retry_requested": "running",
}
STATUSES = ["pending", "running", "suspended", "paused", "cancelled", "completed", "failed"]
TERMINAL = ["cancelled", "completed", "failed"]
DECISIONS = ["approval.granted", "approval.rejected"]


def _is(*kinds: str) -> Column:
    return F.col("event_type").isin(*kinds)


def _name(packed: Column) -> Column:
    """The status that a setter's code stands for; null where no event has set one."""
    return F.get(F.array(*[F.lit(s) for s in STATUSES]), (packed % 64).cast("int"))


def approval_transitions(log: DataFrame) -> DataFrame:
    """Per approval event of a run: how many approvals are pending after it. Reads approval events only."""
    rows = log.where(_is("approval.requested", *DECISIONS))
    change = "sum(case when event_type = 'approval.requested' then 1 else -1 end) over (partition by run_id order by seq)"
    return rows.withColumn("pending_after", F.expr(change))


def status(log: DataFrame) -> DataFrame:
    """(run_id, status, last_seq, last_at). The setter is packed with its seq, so the aggregate stays a hash aggregate."""
    code = F.lit(None).cast("bigint")
    for kind, value in SETTERS.items():
        code = F.when(_is(kind), STATUSES.index(value)).otherwise(code)
    packed = F.max(F.when(_is(*SETTERS), F.col("seq") * 64 + code))
    base = log.groupBy("run_id").agg(packed.alias("packed"), F.max("seq").alias("last_seq"), F.max_by("occurred_at", "seq").alias("last_at"))
    cleared = approval_transitions(log).where("event_type = 'approval.granted' and pending_after = 0").groupBy("run_id").agg(F.max("seq").alias("cleared_seq"))
    name = _name(F.col("packed"))
    reopened = (name == "suspended") & (F.col("cleared_seq") > F.floor(F.col("packed") / 64))
    return base.join(cleared, "run_id", "left").select("run_id", F.when(reopened, "running").otherwise(F.coalesce(name, F.lit("pending"))).alias("status"), "last_seq", "last_at")


def header(log: DataFrame) -> DataFrame:
    """Fields of the first event of a run."""
    return log.where("seq = 1 and event_type = 'run.started'").select("run_id", "workflow", "request_id", "parent_run_id", F.col("occurred_at").alias("started_at"))


def completed_steps(log: DataFrame) -> DataFrame:
    """One row per completion, in completion order."""
    rows = log.where(_is("step.completed"))
    return rows.select("run_id", "step_id", "seq", "attempt", "cost", "model_id", "tokens", F.col("occurred_at").alias("finished_at"), F.expr("cast(row_number() over (partition by run_id order by seq) as bigint)").alias("position"))


def attempts(log: DataFrame) -> DataFrame:
    """Attempt of each step's last start."""
    return log.where(_is("step.started")).groupBy("run_id", "step_id").agg(F.max_by("attempt", "seq").alias("attempt"), F.count("*").alias("starts"))


def progress(log: DataFrame) -> DataFrame:
    """Last reported fraction of each step; a completion counts as 1."""
    rows = log.where(_is("step.progress", "step.completed"))
    return rows.groupBy("run_id", "step_id").agg(F.max_by(F.when(_is("step.completed"), 1.0).otherwise(F.col("fraction")), "seq").alias("progress"))


def _last_set(log: DataFrame, is_set: Column, is_clear: Column, value: str, name: str) -> DataFrame:
    """Per step: the value of the last setter, unless something cleared it later."""
    rows = log.where((is_set | is_clear) & F.col("step_id").isNotNull())
    last = rows.groupBy("run_id", "step_id").agg(F.max_by(F.struct(is_set.alias("s"), F.col(value).alias("v")), "seq").alias("x"))
    return last.where("x.s").select("run_id", "step_id", F.col("x.v").alias(name))


def dead_lettered(log: DataFrame) -> DataFrame:
    return _last_set(log, _is("step.dead_lettered"), _is("step.retry_requested"), "error", "cause")


def failed_steps(log: DataFrame) -> DataFrame:
    return _last_set(log, _is("step.failed") & F.col("terminal"), _is("step.retry_requested"), "error", "error")


def pending_retries(log: DataFrame) -> DataFrame:
    """Steps whose retry is due later. A failure without a retry time neither sets nor clears."""
    sets = _is("step.failed") & ~F.coalesce("terminal", F.lit(True)) & F.col("retry_at").isNotNull()
    return _last_set(log, sets, _is("step.started", "step.retry_requested", "step.cancelled"), "retry_at", "retry_at")


def cancelled_steps(log: DataFrame) -> DataFrame:
    return log.where(_is("step.cancelled")).select("run_id", "step_id", "seq")


def flags(log: DataFrame) -> DataFrame:
    """cancel_requested and pause_requested: the last event that sets each of them."""
    cancel = F.when(_is("run.cancel_requested"), True).when(_is("run.cancelled"), False)
    pause = F.when(_is("run.pause_requested"), True).when(_is("run.cancelled", "run.paused"), False)

    def last(c: Column) -> Column:
        return F.coalesce(F.max_by(c, F.when(c.isNotNull(), F.col("seq"))), F.lit(False))

    return log.groupBy("run_id").agg(last(cancel).alias("cancel_requested"), last(pause).alias("pause_requested"))


def approvals(log: DataFrame) -> DataFrame:
    """One row per approval: its last request and the last decision after it; a new request makes it pending again."""
    asked = log.where(_is("approval.requested")).groupBy("run_id", "approval_id").agg(
        F.max("seq").alias("requested_seq"),
        F.max_by(F.struct("step_id", F.col("approval_kind").alias("kind"), "effect_class", "proposed_ceiling", "expires_at", F.col("occurred_at").alias("requested_at")), "seq").alias("r"),
    )
    decided = log.where(_is(*DECISIONS)).groupBy("run_id", "approval_id").agg(F.max("seq").alias("decided_seq"), F.max_by(F.struct("event_type", "principal_kind", "occurred_at"), "seq").alias("d"))
    both = asked.join(decided, ["run_id", "approval_id"], "left")
    valid = F.col("decided_seq") > F.col("requested_seq")
    return both.select(
        "run_id", "approval_id", "requested_seq", "r.*", F.when(valid, F.substring_index("d.event_type", ".", -1)).otherwise("pending").alias("approval_status"),
        F.when(valid, F.col("d.principal_kind")).alias("decided_by"), F.when(valid, F.col("d.occurred_at")).alias("decided_at"), F.when(valid, F.col("decided_seq")).alias("decided_seq"),
    )


def raised_ceiling(log: DataFrame) -> DataFrame:
    """Cost ceiling that the last granted cost approval proposes."""
    granted = log.where(_is("approval.granted")).select("run_id", "approval_id", F.col("seq").alias("grant_seq"))
    asked = log.where("event_type = 'approval.requested' and approval_kind = 'cost' and proposed_ceiling is not null").select("run_id", "approval_id", "proposed_ceiling", F.col("seq").alias("ask_seq"))
    return granted.join(asked, ["run_id", "approval_id"]).where("ask_seq < grant_seq").groupBy("run_id").agg(F.max_by("proposed_ceiling", F.struct("grant_seq", "ask_seq")).alias("cost_ceiling"))


def total_cost(log: DataFrame) -> DataFrame:
    """Cost of completed and dead-lettered steps; exact decimals."""
    counted = F.when(_is("step.completed", "step.dead_lettered"), F.col("cost"))
    return log.groupBy("run_id").agg(F.coalesce(F.sum(counted), F.lit(0)).cast("decimal(28,4)").alias("total_cost"), F.sum(_is("step.completed").cast("bigint")).alias("n_completed"))


def substitutions(log: DataFrame) -> DataFrame:
    return log.where(_is("executor.substituted")).select("run_id", "seq", "step_id", "agent", "from_model", F.col("model_id").alias("to_model"), "occurred_at")


def policy_stamp(log: DataFrame) -> DataFrame:
    rows = log.where(_is("governance.policy_applied")).groupBy("run_id").agg(F.max_by(F.struct("policy", "narrowed"), "seq").alias("p"))
    return rows.select("run_id", "p.policy", "p.narrowed")


def endings(log: DataFrame) -> DataFrame:
    """error and ended_at: last setters, with a retry clearing both. A null that clears wins over an older value."""
    retry = _is("step.retry_requested")
    sets_error = retry | _is("run.failed") | (_is("step.failed") & F.col("terminal"))
    text = F.when(retry, None).when(_is("run.failed"), F.col("error")).otherwise(F.concat(F.lit("step '"), F.col("step_id"), F.lit("': "), F.col("error")))
    ends = retry | _is("run.completed", "run.failed", "run.cancelled")
    return log.groupBy("run_id").agg(
        F.max_by(F.when(sets_error, text), F.when(sets_error, F.col("seq"))).alias("error"),
        F.max_by(F.when(ends & ~retry, F.col("occurred_at")), F.when(ends, F.col("seq"))).alias("ended_at"),
    )


def summary(log: DataFrame) -> DataFrame:
    """(run_id, status, last_seq, last_at, workflow, started_at, total_cost, n_completed): one aggregate, and one over the few approval events."""
    code = F.lit(None).cast("bigint")
    for kind, value in SETTERS.items():
        code = F.when(_is(kind), STATUSES.index(value)).otherwise(code)
    first = (F.col("seq") == 1) & _is("run.started")
    counted = F.when(_is("step.completed", "step.dead_lettered"), F.col("cost"))
    whole = log.groupBy("run_id").agg(
        F.max(F.when(_is(*SETTERS), F.col("seq") * 64 + code)).alias("packed"), F.max("seq").alias("last_seq"), F.max_by("occurred_at", "seq").alias("last_at"), F.max(F.when(first, F.col("workflow"))).alias("workflow"),
        F.max(F.when(first, F.col("occurred_at"))).alias("started_at"), F.coalesce(F.sum(counted), F.lit(0)).cast("decimal(28,4)").alias("total_cost"), F.sum(_is("step.completed").cast("bigint")).alias("n_completed"),
    )
    cleared = approval_transitions(log).where("event_type = 'approval.granted' and pending_after = 0").groupBy("run_id").agg(F.max("seq").alias("cleared_seq"))
    out = whole.join(cleared, "run_id", "left")
    return out.withColumn("status", _status_of(out)).select("run_id", "status", "last_seq", "last_at", "workflow", "started_at", "total_cost", "n_completed")


def run_row(log: DataFrame) -> DataFrame:
    """The whole nested row of each run: one aggregate by run, one by step, and what the few approval events add."""
    retry = _is("step.retry_requested")
    code = F.lit(None).cast("bigint")
    for kind, value in SETTERS.items():
        code = F.when(_is(kind), STATUSES.index(value)).otherwise(code)
    first = (F.col("seq") == 1) & _is("run.started")
    done = _is("step.completed")
    cancel = F.when(_is("run.cancel_requested"), True).when(_is("run.cancelled"), False)
    pause = F.when(_is("run.pause_requested"), True).when(_is("run.cancelled", "run.paused"), False)
    sets_error = retry | _is("run.failed") | (_is("step.failed") & F.col("terminal"))
    text = F.when(retry, None).when(_is("run.failed"), F.col("error")).otherwise(F.concat(F.lit("step '"), F.col("step_id"), F.lit("': "), F.col("error")))
    ends = retry | _is("run.completed", "run.failed", "run.cancelled")

    def last(value: Column, where: Column) -> Column:
        return F.max_by(value, F.when(where, F.col("seq")))

    whole = log.groupBy("run_id").agg(
        F.max(F.when(_is(*SETTERS), F.col("seq") * 64 + code)).alias("packed"), F.max("seq").alias("last_seq"), F.max_by("occurred_at", "seq").alias("last_at"),
        *[F.max(F.when(first, F.col(c))).alias(a) for c, a in (("workflow", "workflow"), ("request_id", "request_id"), ("parent_run_id", "parent_run_id"), ("occurred_at", "started_at"))],
        F.coalesce(last(cancel, cancel.isNotNull()), F.lit(False)).alias("cancel_requested"), F.coalesce(last(pause, pause.isNotNull()), F.lit(False)).alias("pause_requested"),
        F.coalesce(F.sum(F.when(_is("step.completed", "step.dead_lettered"), F.col("cost"))), F.lit(0)).cast("decimal(28,4)").alias("total_cost"), F.sum(done.cast("bigint")).alias("n_completed"),
        last(text, sets_error).alias("error"), last(F.when(~retry, F.col("occurred_at")), ends).alias("ended_at"),
        F.array_sort(F.collect_list(F.when(done, F.struct("seq", "step_id", "attempt", "cost", F.col("occurred_at").alias("finished_at"))))).alias("steps"),
        last(F.struct("policy", "narrowed"), _is("governance.policy_applied")).alias("p"),
    )
    moves = log.where(F.col("step_id").isNotNull() & _is("step.started", "step.progress", "step.completed")).groupBy("run_id", "step_id").agg(
        last(F.col("attempt"), _is("step.started")).alias("attempt"), F.max(_is("step.started")).alias("tried"),
        last(F.when(done, 1.0).otherwise(F.col("fraction")), done | _is("step.progress")).alias("progress"), F.max(done | _is("step.progress")).alias("moved"),
    )
    per_step = moves.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("tried"), F.struct("step_id", "attempt"))))).alias("attempts"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("moved"), F.struct("step_id", "progress"))))).alias("progress")
    )
    few = log.where(_is("approval.requested", *DECISIONS))
    cleared = approval_transitions(few).where("event_type = 'approval.granted' and pending_after = 0").groupBy("run_id").agg(F.max("seq").alias("cleared_seq"))
    gates = approvals(few).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("approval_id", F.struct("step_id", "kind", "approval_status", "decided_by"))))).alias("approvals"))
    out = whole.join(per_step, "run_id", "left").join(cleared.join(gates, "run_id", "full").join(raised_ceiling(few), "run_id", "full"), "run_id", "left")
    item = lambda x, i: F.struct((i + 1).cast("bigint").alias("position"), x["step_id"].alias("step_id"), x["attempt"].alias("attempt"), x["cost"].alias("cost"), x["finished_at"].alias("finished_at"))
    none = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return out.select(
        "run_id", _status_of(out).alias("status"), "last_seq", "last_at", "workflow", "request_id", "parent_run_id", "started_at", "cancel_requested", "pause_requested", "total_cost", "n_completed", "error", "ended_at",
        F.when(F.size("steps") > 0, F.transform("steps", item)).alias("steps"), none("attempts"), none("progress"), "approvals", "cost_ceiling", F.col("p.policy").alias("policy"), F.col("p.narrowed").alias("narrowed"),
    )


# ---------------------------------------------------------------- incremental


def accumulators(log: DataFrame) -> DataFrame:
    """Mergeable state of each run's log prefix: the newest setter, pending approvals, cost and counts."""
    code = F.lit(None).cast("bigint")
    for kind, value in SETTERS.items():
        code = F.when(_is(kind), STATUSES.index(value)).otherwise(code)
    asked = F.count(F.when(_is("approval.requested"), 1)) - F.count(F.when(_is(*DECISIONS), 1))
    counted = F.when(_is("step.completed", "step.dead_lettered"), F.col("cost"))
    cleared = approval_transitions(log).where("event_type = 'approval.granted' and pending_after = 0").groupBy("run_id").agg(F.max("seq").alias("cleared_seq"))
    return log.groupBy("run_id").agg(
        F.max(F.when(_is(*SETTERS), F.col("seq") * 64 + code)).alias("packed"), F.max("seq").alias("last_seq"), asked.alias("pending"),
        F.coalesce(F.sum(counted), F.lit(0)).cast("decimal(28,4)").alias("total_cost"), F.count(F.when(_is("step.completed"), 1)).alias("n_completed"),
    ).join(cleared, "run_id", "left")


def _status_of(acc: DataFrame) -> Column:
    name = _name(F.col("packed"))
    return F.when((name == "suspended") & (F.col("cleared_seq") > F.floor(F.col("packed") / 64)), "running").otherwise(F.coalesce(name, F.lit("pending")))


def fold_from(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """Snapshot accumulators and the events after them give the state of the whole log; only the tail is read."""
    after = tail.join(snapshot.select("run_id", F.col("last_seq").alias("_at")), "run_id", "left").where("_at is null or seq > _at").drop("_at")
    before = snapshot.select("run_id", F.col("pending").alias("_pending"))
    moved = approval_transitions(after).join(before, "run_id", "left").where("event_type = 'approval.granted' and pending_after + coalesce(_pending, 0) = 0")
    fresh = accumulators(after).drop("cleared_seq").join(moved.groupBy("run_id").agg(F.max("seq").alias("cleared_seq")), "run_id", "left")
    parts = snapshot.select(*fresh.columns).unionByName(fresh)
    merged = parts.groupBy("run_id").agg(
        F.max("packed").alias("packed"), F.max("last_seq").alias("last_seq"), F.sum("pending").alias("pending"), F.sum("total_cost").cast("decimal(28,4)").alias("total_cost"),
        F.sum("n_completed").alias("n_completed"), F.max("cleared_seq").alias("cleared_seq"),
    )
    return merged.withColumn("status", _status_of(merged))


def snapshot_choice(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """Newest usable snapshot of each run: the log has its seq with the same hash (nulls equal)."""
    at = log.select("run_id", "seq", "hash")
    ok = snapshots.join(at, (snapshots.run_id == at.run_id) & (snapshots.snap_seq == at.seq) & snapshots.last_hash.eqNullSafe(at.hash), "left_semi")
    return ok.groupBy("run_id").agg(F.max("snap_seq").alias("snap_seq"))


def snapshot_due(log: DataFrame, taken: DataFrame, every: int = 200) -> DataFrame:
    """Runs with `every` events or more since their last snapshot."""
    last = log.groupBy("run_id").agg(F.max("seq").alias("last_seq"))
    return last.join(taken, "run_id", "left").where(F.col("last_seq") - F.coalesce("snap_seq", F.lit(0)) >= every).select("run_id", "last_seq")


def state_at(log: DataFrame, points: DataFrame) -> DataFrame:
    """State of each (run_id, k); a k outside 1..last is reported as out of range. A run may have several."""
    wanted = points.select("run_id", "k").distinct()
    ends = log.select("run_id", "seq", "event_type", "cost", F.expr("max(seq) over (partition by run_id)").alias("n"))
    state = state_of_prefixes(ends.join(wanted, "run_id"))
    good = F.coalesce("in_range", F.lit(False)).alias("in_range")
    return wanted.join(state, ["run_id", "k"], "left").select("run_id", "k", good, "status", "total_cost")


def state_of_prefixes(rows: DataFrame) -> DataFrame:
    """state_at() for a log whose events carry their run's k and its last seq, n: one window and one aggregate by run."""
    code = F.lit(None).cast("bigint")
    for kind, value in SETTERS.items():
        code = F.when(_is(kind), STATUSES.index(value)).otherwise(code)
    held = F.col("seq") <= F.col("k")
    # what can set a state, and the last event, so that every run stays
    rows = rows.where(_is(*SETTERS, "approval.requested", *DECISIONS, "step.completed", "step.dead_lettered") | (F.col("seq") == F.col("n")))
    change = "sum(case when event_type = 'approval.requested' then 1 when event_type in ('approval.granted', 'approval.rejected') then -1 else 0 end) over (partition by run_id, k order by seq)"
    rows = rows.withColumn("_pending", F.expr(change))
    out = rows.groupBy("run_id", "k").agg(
        F.max("n").alias("n"), F.max(F.when(held & _is(*SETTERS), F.col("seq") * 64 + code)).alias("packed"),
        F.max(F.when(held & _is("approval.granted") & (F.col("_pending") == 0), F.col("seq"))).alias("cleared_seq"),
        F.coalesce(F.sum(F.when(held & _is("step.completed", "step.dead_lettered"), F.col("cost"))), F.lit(0)).cast("decimal(28,4)").alias("total_cost"),
    )
    good = F.coalesce(F.col("k").between(1, F.col("n")), F.lit(False))
    return out.select("run_id", "k", good.alias("in_range"), F.when(good, _status_of(out)).alias("status"), F.when(good, F.col("total_cost")).alias("total_cost"))


def state_everywhere(log: DataFrame, *carry: str) -> DataFrame:
    """State after every event, by running windows: one pass, no self-join. Columns to carry come after the state."""
    mapping = F.create_map(*[F.lit(x) for kv in SETTERS.items() for x in kv])
    w = "over (partition by run_id order by seq rows between unbounded preceding and current row)"
    rows = log.withColumn("_set", F.when(_is(*SETTERS), F.struct(F.col("seq").alias("s"), mapping[F.col("event_type")].alias("v"))))
    rows = rows.withColumn("_pend", F.expr(f"sum(case when event_type = 'approval.requested' then 1 when event_type in ('approval.granted', 'approval.rejected') then -1 else 0 end) {w}"))
    rows = rows.withColumn("_last", F.expr(f"max(_set) {w}")).withColumn("_clear", F.expr(f"max(case when event_type = 'approval.granted' and _pend = 0 then seq end) {w}"))
    rows = rows.withColumn("total_cost", F.expr(f"cast(coalesce(sum(case when event_type in ('step.completed', 'step.dead_lettered') then cost end) {w}, 0) as decimal(28,4))"))
    state = F.when((F.col("_last.v") == "suspended") & (F.col("_clear") > F.col("_last.s")), "running").otherwise(F.coalesce("_last.v", F.lit("pending")))
    return rows.select("run_id", "seq", state.alias("status"), "total_cost", *carry)


def state_everywhere_blocks(log: DataFrame, *carry: str, block: int = BLOCK) -> DataFrame:
    """state_everywhere() for runs of any length: blocks of a run go side by side (see scan). Which grants clear a suspension takes a second scan, over approval events only; those come in as rows of their own just before their event, so the log is dealt once, by block, and meets no join by event."""
    few = running(log.where(_is("approval.requested", *DECISIONS)), {"_pend": ("sum", F.when(_is("approval.requested"), 1).otherwise(-1))}, block)
    cleared = cut(few.where("event_type = 'approval.granted' and _pend = 0").select("run_id", "seq", F.lit(True).alias("_clears")))
    code = F.lit(None).cast("bigint")
    for kind, value in SETTERS.items():
        code = F.when(_is(kind), STATUSES.index(value)).otherwise(code)
    rows = log.select("run_id", "seq", "event_type", "cost", *[c for c in carry if c not in ("run_id", "seq", "event_type", "cost")])
    rows = rows.unionByName(cleared, allowMissingColumns=True).withColumn("_at", F.col("seq") * 2 - F.when(F.col("_clears"), 1).otherwise(0))
    spent = F.when(_is("step.completed", "step.dead_lettered"), F.col("cost"))
    out = running(rows, {"packed": ("max", F.when(_is(*SETTERS), F.col("seq") * 64 + code)), "cleared_seq": ("max", F.when(F.col("_clears"), F.col("seq"))), "_total": ("sum", spent)}, 2 * block, order="_at").where("_clears is null")
    total = F.coalesce("_total", F.lit(0)).cast("decimal(28,4)").alias("total_cost")
    return out.select("run_id", "seq", _status_of(out).alias("status"), total, *carry)


def violations(log: DataFrame) -> DataFrame:
    """Runs whose log does not fold: first bad seq and the reason, in the order the rules are checked."""
    w = "over (partition by run_id order by seq)"
    rows = log.withColumn("_n", F.expr(f"row_number() {w}")).withColumn("_done", F.expr("case when event_type = 'step.completed' then row_number() over (partition by run_id, event_type, step_id order by seq) end"))
    reason = (
        F.when((F.col("_n") == 1) & (F.col("event_type") != "run.started"), "does not start with run.started")
        .when(F.col("seq") != F.col("_n"), "seq gap")
        .when(F.col("_done") > 1, "step completed twice")
        .when((F.col("_n") > 1) & (F.col("event_type") == "run.started"), "run.started appears twice")
    )
    bad = rows.withColumn("reason", reason).where("reason is not null")
    return bad.groupBy("run_id").agg(F.min("seq").alias("bad_seq"), F.min_by("reason", F.struct("seq", "_n")).alias("reason"))


def hydrate(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """References with the content of their blobs, parsed as JSON."""
    return refs.join(blobs, refs.sha256 == blobs.blob_sha256, "left").select(refs["*"], F.expr("try_parse_json(cast(data as string))").alias("content"))
