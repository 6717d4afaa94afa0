"""Budgets, policies, gates and their audits, as set algebra and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import seconds
from .scan import running

#: Closed vocabulary of effect classes, and those that need a human. Fixed values.
CLASSES = ["compute", "execute_code", "read", "send_message", "spawn_run", "spend", "write_external"]
HUMAN_ONLY = ["spend", "write_external"]


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)  # nulls stand for no limit and are skipped


def effective_budget(rows: DataFrame) -> DataFrame:
    """Workflow budget under the operator's ceiling, with a line per narrowing, in rule order.

    Columns: allowed, approval, allow_agent, max_step_cost, max_run_cost, max_wall; policy side: ceiling (null: no limit),
    always_approve, agent_allowed, p_step_cost, p_run_cost, p_wall, has_policy.
    """
    has = F.col("has_policy")
    none = F.array().cast("array<string>")

    def inside(c: str) -> Column:
        return F.when(has & F.col("ceiling").isNotNull(), F.array_intersect(c, "ceiling")).otherwise(F.col(c))

    def gone(c: str) -> Column:
        return F.when(has & F.col("ceiling").isNotNull(), F.array_sort(F.array_except(c, "ceiling"))).otherwise(none)

    r = rows.withColumn("_gone_allowed", gone("allowed")).withColumn("_gone_approval", gone("approval")).withColumn("_a", inside("allowed")).withColumn("_p", inside("approval"))
    r = r.withColumn("_moved", F.when(has, F.array_sort(F.array_intersect("always_approve", "_a"))).otherwise(none))
    r = r.withColumn("eff_allowed", F.array_sort(F.array_except("_a", "_moved"))).withColumn("eff_approval", F.array_sort(F.array_union("_p", "_moved")))
    agent_cut = has & F.col("allow_agent") & ~F.col("agent_allowed")
    r = r.withColumn("eff_allow_agent", F.col("allow_agent") & ~agent_cut)
    limits = [("max_step_cost", "p_step_cost"), ("max_run_cost", "p_run_cost"), ("max_wall", "p_wall")]
    for own, cap in limits:
        r = r.withColumn(f"eff_{own}", F.when(has, _least(F.col(own), F.col(cap))).otherwise(F.col(own)))

    def removed(c: str) -> Column:
        name = {"allowed": "allowed_effect_classes", "approval": "approval_required_for"}[c]
        return F.when(F.size(f"_gone_{c}") > 0, F.concat(F.lit(f"{name}: removed "), F.array_join(f"_gone_{c}", ", "), F.lit(" (outside effect_ceiling)")))

    def changed(own: str) -> Column:
        shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
        name = {"max_wall": "max_step_wall_seconds"}.get(own, own)
        return F.when(~F.col(f"eff_{own}").eqNullSafe(F.col(own)), F.concat(F.lit(f"{name}: "), shown(own), F.lit(" → "), shown(f"eff_{own}")))

    moved = F.transform("_moved", lambda c: F.concat(c, F.lit(": allowed → approval_required (always_approve)")))
    agent = F.when(agent_cut, F.lit("allow_agent_approval: true → false (agent_approval_allowed=false)"))
    lines = F.flatten(F.array(F.array(removed("allowed"), removed("approval")), moved, F.array(agent, *[changed(o) for o, _ in limits])))
    return r.withColumn("narrowed", F.filter(lines, lambda x: x.isNotNull())).drop("_a", "_p", "_moved", "_gone_allowed", "_gone_approval")


def tier(cls: Column, allowed: Column, approval: Column) -> Column:
    return F.when(F.array_contains(allowed, cls), "runs").when(F.array_contains(approval, cls), "asks approval").otherwise("REFUSED")


def class_tiers(nodes: DataFrame) -> DataFrame:
    """One row per node and declared class: its tier. nodes carry declared, eff_allowed, eff_approval."""
    keys = [c for c in nodes.columns if c != "declared"]
    return nodes.select(*keys, F.explode("declared").alias("effect_class")).withColumn("tier", tier(F.col("effect_class"), F.col("eff_allowed"), F.col("eff_approval")))


def executor_allowed(executors: Column, name: Column) -> Column:
    return executors.isNull() | F.array_contains(executors, name)


def node_outcome(nodes: DataFrame, agents: DataFrame) -> DataFrame:
    """What becomes of each node: unknown agent, executor not allowed, refused, asks approval or runs, in that order."""
    rows = nodes.join(agents, "agent", "left")
    tiers = F.transform("declared", lambda c: tier(c, F.col("eff_allowed"), F.col("eff_approval")))
    outcome = (
        F.when(F.col("declared").isNull(), "unknown agent")
        .when(~executor_allowed(F.col("executors"), F.col("executor")), "fails at dispatch (executor not allowed)")
        .when(F.array_contains(tiers, "REFUSED"), "refused")
        .when(F.array_contains(tiers, "asks approval"), "asks approval")
        .otherwise("runs")
    )
    return rows.withColumn("outcome", outcome)


def gate_classes(declared: Column, allowed: Column, approval: Column) -> Column:
    """Classes to ask for: none if any declared class would be refused anyway."""
    refused = F.array_except(declared, F.array_union(allowed, approval))
    return F.when(F.size(refused) > 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except(F.array_intersect(declared, approval), allowed)))


def gate_decisions(steps: DataFrame, approvals: DataFrame) -> DataFrame:
    """Of each gated step: run under a grant, keep waiting, or ask. Only effect approvals count."""
    mine = approvals.where("kind = 'effect'").groupBy("run_id", "step_id").agg(
        F.min_by("approval_id", F.when(F.col("approval_status") == "granted", F.col("requested_seq"))).alias("granted_id"),
        F.max(F.when(F.col("approval_status") == "granted", 2).when(F.col("approval_status") == "pending", 1).otherwise(0)).alias("_best"),
    )
    rows = steps.join(mine, ["run_id", "step_id"], "left")
    return rows.select("run_id", "step_id", F.when(F.col("_best") == 2, "run").when(F.col("_best") == 1, "pending").otherwise("request").alias("decision"), F.when(F.col("_best") == 2, F.col("granted_id")).alias("granted_id"))


def undeclared_effects(completed: DataFrame) -> DataFrame:
    """Completions that report a class outside their declaration, with the first such class."""
    extra = F.array_except("reported", "declared")
    return completed.withColumn("undeclared", F.array_min(extra)).where("undeclared is not null")


def over_step_cost(completed: DataFrame, budgets: DataFrame) -> DataFrame:
    return completed.join(budgets, "workflow").where("max_step_cost is not null and cost > max_step_cost")


def over_wall_time(settled: DataFrame, budgets: DataFrame) -> DataFrame:
    return settled.join(budgets, "workflow").where("max_wall is not null and seconds > max_wall")


def ceiling_crossing(costs: DataFrame, block: int | None = None) -> DataFrame:
    """First event of a run after which its rolling cost exceeds the ceiling in force, and the ceiling a grant would set.

    costs: run_id, seq, cost (null for other events), granted_ceiling (null but on grants that raise it), max_run_cost.
    block: cut runs into blocks of so many events (see scan), where one run may be too long for a task; costs are then read twice.
    """
    if block is None:
        w = "over (partition by run_id order by seq rows between unbounded preceding and current row)"
        rows = costs.withColumn("total", F.expr(f"coalesce(sum(cost) {w}, 0)")).withColumn("ceiling", F.expr(f"coalesce(last(granted_ceiling, true) {w}, max_run_cost)"))
    else:
        rows = running(costs, {"_sum": ("sum", F.col("cost").cast("decimal(28,4)")), "_raised": ("last", F.col("granted_ceiling"))}, block)
        rows = rows.withColumn("total", F.coalesce("_sum", F.lit(0)).cast("decimal(28,4)")).withColumn("ceiling", F.coalesce("_raised", "max_run_cost")).drop("_sum", "_raised")
    over = rows.where("cost is not null and ceiling is not null and total > ceiling")
    first = over.groupBy("run_id").agg(F.min_by(F.struct("seq", "total", "ceiling", "max_run_cost"), "seq").alias("x"))
    return first.select("run_id", "x.seq", "x.total", "x.ceiling", (F.col("x.total") + F.col("x.max_run_cost")).alias("proposed"))


def human_only_violations(approvals: DataFrame, allow_agent: DataFrame) -> DataFrame:
    """Grants by someone not human on a gate that needs a human, where the effective budget does not allow agents."""
    rows = approvals.where("approval_status = 'granted' and decided_by <> 'human'").join(allow_agent, "run_id")
    return rows.where(((F.col("kind") == "cost") | F.col("effect_class").isin(HUMAN_ONLY)) & ~F.col("eff_allow_agent"))


def expired(approvals: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Of each suspended run, its first pending approval, by request, that has expired."""
    rows = approvals.where("approval_status = 'pending'").where(F.col("expires_at") <= now).join(states.where("status = 'suspended'").select("run_id"), "run_id")
    first = F.expr("row_number() over (partition by run_id order by requested_seq)")
    return rows.withColumn("_r", first).where("_r = 1").drop("_r")


def gate_order(approvals: DataFrame, log: DataFrame) -> DataFrame:
    """Gated steps: first start against the grant; ok if the step never started or started later."""
    starts = log.where("event_type = 'step.started'").groupBy("run_id", "step_id").agg(F.min("seq").alias("start_seq"))
    rows = approvals.join(starts, ["run_id", "step_id"], "left")
    granted = F.when(F.col("approval_status") == "granted", F.col("decided_seq"))
    return rows.select("run_id", "approval_id", "step_id", "start_seq", granted.alias("grant_seq"), (F.col("start_seq").isNull() | F.coalesce(F.col("start_seq") > granted, F.lit(False))).alias("ok"))


def policy_attribution(stamps: DataFrame, runs: DataFrame, policies: DataFrame) -> DataFrame:
    """Runs per governing policy; none and unknown documents are named so."""
    rows = runs.join(stamps, "run_id", "left").join(policies, "policy", "left")
    label = F.when(F.col("policy").isNull(), "none").when(F.col("known").isNull(), "unknown").otherwise(F.col("policy"))
    return rows.groupBy(label.alias("policy")).agg(F.count("*").alias("runs"), F.coalesce(F.sum("narrowed"), F.lit(0)).alias("narrowings"))


def as_of(probes: DataFrame, history: DataFrame, at: str, values: list[str], cell_rows: int = 10_000, most_cells: int = 200_000) -> DataFrame:
    """Each probe with the newest history row at or before it; equal instants count. History columns: at, place, values.

    Rows meet by time cell; what a cell starts with is carried over from the cells before it, one row each, so no task orders
    the whole table. Cells are as wide as leaves `cell_rows` rows for one on average, and at most `most_cells`.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at))
    n, low, high = probes.select(at).unionByName(history.select(at)).agg(F.count("*"), F.min(micros), F.max(micros)).first()
    width = max(1, ((high or 0) - (low or 0)) // min(max(1, n // cell_rows), most_cells) + 1)
    cell = F.floor((micros - F.lit(low or 0)) / F.lit(width))
    item = F.struct(F.col(at).alias("_t"), "place", *values)
    ends = history.groupBy(cell.alias("_cell")).agg(F.max(item).alias("_last"))
    cells = probes.select(cell.alias("_cell")).distinct().join(ends, "_cell", "full")
    carried = cells.withColumn("_carry", F.expr("last(_last, true) over (order by _cell rows between unbounded preceding and 1 preceding)")).select("_cell", "_carry")
    h = history.select(F.col(at), cell.alias("_cell"), F.lit(0).alias("_side"), "place", item.alias("_item"))
    p = probes.withColumn("_cell", cell).withColumn("_side", F.lit(1)).withColumn("place", F.lit(None).cast(history.schema["place"].dataType)).withColumn("_item", F.lit(None).cast(h.schema["_item"].dataType))
    both = h.unionByName(p, allowMissingColumns=True)
    both = both.withColumn("_now", F.expr(f"last(_item, true) over (partition by _cell order by {at}, _side, place rows between unbounded preceding and current row)"))
    out = both.where("_side = 1").join(carried, "_cell", "left").withColumn("_found", F.coalesce("_now", "_carry"))
    keep = [c for c in probes.columns]
    return out.select(*keep, *[F.col(f"_found.{v}").alias(v) for v in values])


def retryable(dead: DataFrame, failed: DataFrame) -> DataFrame:
    return dead.select("run_id", "step_id").union(failed.select("run_id", "step_id")).distinct()


def rejection_audit(approvals: DataFrame, log: DataFrame) -> DataFrame:
    """What follows a rejection: an effect gate needs the step's dead letter and the run's failure, a cost gate the failure only."""
    after = log.where(F.col("event_type").isin("step.dead_lettered", "run.failed")).select("run_id", F.col("seq").alias("_s"), "event_type", F.col("step_id").alias("_step"))
    # in the join's condition: a rejection with earlier events only comes out too
    rejected = approvals.where("approval_status = 'rejected'").withColumnRenamed("run_id", "_run")
    rows = rejected.join(after, (F.col("_run") == F.col("run_id")) & (F.col("_s") > F.col("decided_seq")), "left").drop("run_id").withColumnRenamed("_run", "run_id")
    out = rows.groupBy("run_id", "approval_id", "kind").agg(
        F.coalesce(F.max((F.col("event_type") == "step.dead_lettered") & (F.col("_step") == F.col("step_id"))), F.lit(False)).alias("dead_lettered"),
        F.coalesce(F.max(F.col("event_type") == "run.failed"), F.lit(False)).alias("run_failed"),
    )
    return out.withColumn("ok", F.col("run_failed") & F.when(F.col("kind") == "effect", F.col("dead_lettered")).otherwise(~F.col("dead_lettered")))


def unsafe_reason(config: Column) -> Column:
    """Why a tool definition must not be accepted from a caller nobody verified; null if it may. config: JSON text."""
    v = F.try_parse_json(config)

    def refers(field: str) -> Column:
        return F.coalesce(F.get_json_object(config, f"$.{field}").contains("${"), F.lit(False))

    return (
        F.when(F.variant_get(v, "$.kind", "string") == "subprocess", "subprocess")
        .when(refers("headers"), "environment reference in headers")
        .when(refers("env"), "environment reference in env")
        .when(F.coalesce(F.variant_get(v, "$.allow_private_networks", "boolean"), F.lit(False)), "private networks")
    )


def started_while_paused(starts: DataFrame, pauses: DataFrame) -> DataFrame:
    """Starts whose newest scheduler row at their time says paused."""
    return as_of(starts, pauses, "occurred_at", ["paused"]).where("paused")


def duration(start: str, end: str) -> Column:
    return seconds(F.col(start), F.col(end))
