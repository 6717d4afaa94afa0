"""Queries of spans and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.storage import shared_dir
from ..operators import fold, metrics, sketches, spans, telemetry
from ..sources.run_log import derive, partitions, with_workflow
from .base import SQL, on_log, query
from .fold_queries import APPROVALS, STATUS_CTES
from .view_queries import DONE_SQL

HEADS = "heads as (select run_id, workflow, occurred_at as started_at from log where event_type = 'run.started')"
WF = "wf as (select l.* replace (h.workflow as workflow) from log l join heads h using (run_id))"

on_log(
    "h01_run_spans", spans.run_spans,
    """select run_id as trace_id, left(sha256('run:' || run_id), 16) as span_id, 'run ' || workflow as name, started_at, ended_at, case kind when 'run.completed' then 'OK' else 'ERROR' end as status, error from (
      select run_id, max(workflow) as workflow, min(occurred_at) filter (event_type = 'run.started') as started_at, max(occurred_at) filter (event_type in ('run.completed', 'run.failed', 'run.cancelled')) as ended_at,
        max(event_type) filter (event_type in ('run.completed', 'run.failed', 'run.cancelled')) as kind, max(error) filter (event_type in ('run.completed', 'run.failed', 'run.cancelled')) as error from log group by run_id) where ended_at is not null""",
)
SPANS = """
starts as (select * from log where event_type = 'step.started'),
ended as (select s.run_id, s.step_id, s.attempt, s.agent, s.occurred_at as started_at,
  (select min(e.seq) from log e where e.run_id = s.run_id and e.step_id = s.step_id and e.attempt = s.attempt and e.seq > s.seq and e.event_type in ('step.completed', 'step.failed', 'step.dead_lettered', 'step.cancelled')) as eseq,
  (select min(e.seq) from log e where e.run_id = s.run_id and e.seq > s.seq and e.event_type in ('run.completed', 'run.failed', 'run.cancelled')) as rseq from starts s)
"""
#: Runs cut at seq 6, so that some attempts are still open; their ends stay.
CUT = "(select * from base where seq <= 6 or event_type in ('run.completed', 'run.failed', 'run.cancelled'))"
on_log(
    "h02_step_spans", spans.step_spans,
    "select s.run_id, s.step_id, s.attempt, s.agent, s.started_at, e.occurred_at as ended_at, case when eseq is not null and e.event_type = 'step.completed' then 'OK' else 'ERROR' end as status, case when eseq is not null then substr(e.event_type, 6) else 'unsettled' end as outcome, case when eseq is not null then e.error else 'run ended before step settled' end as error from ended s join log e on e.run_id = s.run_id and e.seq = coalesce(eseq, rseq)",
    SPANS,
)


def _open(log):
    return log.where("seq <= 6 or event_type in ('run.completed', 'run.failed', 'run.cancelled')")


on_log(
    "h03_unsettled_spans", lambda g: spans.step_spans(_open(g)).where("outcome = 'unsettled'").select("run_id", "step_id", "attempt", "started_at", "ended_at", "error"),
    "select s.run_id, s.step_id, s.attempt, s.started_at, e.occurred_at as ended_at, 'run ended before step settled' as error from ended s join log e on e.run_id = s.run_id and e.seq = rseq where eseq is null",
    SPANS.replace("from log", "from (select * from log where seq <= 6 or event_type in ('run.completed', 'run.failed', 'run.cancelled'))"),
)
on_log(
    "h04_point_spans", spans.point_spans,
    "select run_id as trace_id, left(sha256('run:' || run_id), 16) as parent_id, seq, event_type as name, occurred_at as at, step_id, approval_id from log where event_type in ('approval.requested', 'approval.granted', 'approval.rejected', 'executor.substituted', 'step.dead_lettered', 'run.suspended', 'run.paused', 'run.resumed')",
)
on_log(
    "h05_progress_events", lambda g: spans.progress_events(g).withColumn("events", F.array_join(F.transform("events", lambda e: F.concat(e["seq"], F.lit("@"), e["fraction"])), ",")),
    "select run_id, step_id, attempt, string_agg(seq || '@' || fraction, ',' order by seq) as events from log where event_type = 'step.progress' group by run_id, step_id, attempt",
)
on_log(
    "h06_trace_ids", lambda g: g.select("run_id").distinct().withColumn("odd", F.concat(F.lit("r-"), "run_id")).select("run_id", spans.trace_id(F.col("run_id")).alias("trace_id"), spans.trace_id(F.col("odd")).alias("odd_trace_id"), spans.run_span_id(F.col("odd")).alias("odd_span_id")),
    "select distinct run_id, run_id as trace_id, left(sha256('r-' || run_id), 32) as odd_trace_id, left(sha256('run:r-' || run_id), 16) as odd_span_id from log",
)
on_log(
    "h07_completion_attributes", lambda g: spans.completion_attributes(g).select("run_id", "step_id", F.element_at("attributes", "gen_ai.usage.input_tokens").alias("tokens"), F.element_at("attributes", "gen_ai.request.model").alias("model"), F.size("attributes").cast("bigint").alias("n")),
    "select run_id, step_id, tokens::varchar as tokens, model_id as model, 5::bigint as n from log where event_type = 'step.completed'",
)

# ---------------------------------------------------------------- metrics
on_log(
    "i01_run_counters", lambda g: with_workflow(g).where(F.col("event_type").isin("run.started", *spans.TERMINAL_EVENTS)).groupBy("workflow", F.substring("event_type", 5, 20).alias("outcome")).agg(F.count("*").alias("n")),
    "select workflow, substr(event_type, 5) as outcome, count(*) as n from wf where event_type in ('run.started', 'run.completed', 'run.failed', 'run.cancelled') group by all", f"{HEADS}, {WF}",
)


def hist_sql(source: str, keys: str, buckets: list[float]) -> str:
    les = ", ".join(f"('{'+Inf' if b == float('inf') else repr(b)}', {'1e300' if b == float('inf') else b})" for b in buckets)
    return f"select {keys}, b.le, count(*) filter (seconds <= b.hi) as n, sum(seconds) as total from {source} cross join (values {les}) b(le, hi) group by {keys}, b.le"


DUR = "dur as (select h.workflow, substr(event_type, 5) as outcome, date_diff('microsecond', started_at, l.occurred_at) / 1e6 as seconds, l.occurred_at from log l join heads h using (run_id) where event_type in ('run.completed', 'run.failed', 'run.cancelled'))"
on_log("i02_run_duration_histogram", lambda g: metrics.histogram(metrics.run_durations(g), ["workflow", "outcome"], "seconds", metrics.RUN_BUCKETS), hist_sql("dur", "workflow, outcome", metrics.RUN_BUCKETS), f"{HEADS}, {DUR}")
OUTCOME = "case when event_type = 'step.completed' then 'completed' when event_type = 'step.failed' and terminal then 'failed' when event_type = 'step.failed' then 'retry' when event_type = 'step.dead_lettered' then 'dead_lettered' end"
on_log(
    "i03_steps_started", lambda g: with_workflow(g).where("event_type = 'step.started'").groupBy("workflow", "step_id", "agent").agg(F.count("*").alias("n")),
    "select workflow, step_id, agent, count(*) as n from wf where event_type = 'step.started' group by all", f"{HEADS}, {WF}",
)
on_log(
    "i03_steps_ended", lambda g: with_workflow(g).withColumn("outcome", metrics.step_outcome()).where("outcome is not null").groupBy("workflow", "step_id", "outcome").agg(F.count("*").alias("n")),
    f"select workflow, step_id, {OUTCOME} as outcome, count(*) as n from wf where event_type in ('step.completed', 'step.failed', 'step.dead_lettered') group by all", f"{HEADS}, {WF}",
)
SETTLED = f"settled as (select w.workflow, w.step_id, {OUTCOME.replace('event_type', 'w.event_type').replace('terminal', 'w.terminal')} as outcome, date_diff('microsecond', s.occurred_at, w.occurred_at) / 1e6 as seconds from wf w join log s on s.run_id = w.run_id and s.step_id = w.step_id and s.attempt = w.attempt and s.event_type = 'step.started' where w.event_type in ('step.completed', 'step.failed', 'step.dead_lettered') and not exists (select 1 from log x where x.run_id = w.run_id and x.step_id = w.step_id and x.attempt = w.attempt and x.seq < w.seq and x.seq > s.seq and x.event_type in ('step.failed', 'step.completed', 'step.dead_lettered')))"
on_log(
    "i04_step_duration_histogram", lambda g: metrics.histogram(metrics.first_settles(with_workflow(g)), ["workflow", "outcome"], "seconds", metrics.STEP_BUCKETS),
    hist_sql("settled", "workflow, outcome", metrics.STEP_BUCKETS), f"{HEADS}, {WF}, {SETTLED}",
)
on_log(
    "i05_retries_and_dead_letters", lambda g: with_workflow(g).where("event_type = 'step.dead_lettered' or (event_type = 'step.failed' and not terminal)").groupBy("workflow", "event_type", F.coalesce("effect_class", F.lit("")).alias("effect_class")).agg(F.count("*").alias("n")),
    "select workflow, event_type, coalesce(effect_class, '') as effect_class, count(*) as n from wf where event_type = 'step.dead_lettered' or (event_type = 'step.failed' and not terminal) group by all", f"{HEADS}, {WF}",
)
on_log(
    "i06_approval_counters", lambda g: with_workflow(g).where("event_type like 'approval.%'").groupBy("workflow", "event_type", "effect_class", "principal_kind").agg(F.count("*").alias("n")),
    "select workflow, event_type, effect_class, principal_kind, count(*) as n from wf where event_type like 'approval.%' group by all", f"{HEADS}, {WF}",
)
WAITS = "waits as (select approval_status as decision, date_diff('microsecond', requested_at, decided_at) / 1e6 as seconds, decided_at from approvals where approval_status <> 'pending')"
on_log("i07_approval_wait_histogram", lambda g: metrics.histogram(metrics.approval_waits(fold.approvals(g)).withColumnRenamed("approval_status", "decision"), ["decision"], "seconds", metrics.RUN_BUCKETS), hist_sql("waits", "decision", metrics.RUN_BUCKETS), f"{APPROVALS}, {WAITS}")
on_log(
    "i08_suspended_now", lambda g: fold.status(g.where("seq <= 8")).where("status = 'suspended'").join(fold.header(g), "run_id").groupBy("workflow").agg(F.count("*").alias("n")),
    "select workflow, count(*) as n from run_status s join (select run_id, workflow from base where event_type = 'run.started') h using (run_id) where status = 'suspended' group by workflow",
    "base as (select * from log), " + STATUS_CTES.replace("from log", "from (select * from base where seq <= 8)"),
)
on_log(
    "i08_suspended_history", lambda g: metrics.suspended_history(g).select("workflow", "day", F.col("change").cast("bigint").alias("change"), F.col("suspended").cast("bigint").alias("suspended")),
    f"""select workflow, day, change::bigint as change, (sum(change) over (partition by workflow order by day))::bigint as suspended from (
      select h.workflow, occurred_at::date as day, sum(step) as change from (
        select *, case when status = 'suspended' and coalesce(was, '') <> 'suspended' then 1 when status <> 'suspended' and was = 'suspended' then -1 end as step from (
          select *, lag(status) over (partition by run_id order by seq) as was from (
            select run_id, seq, occurred_at, case when w = 'suspended' and g > set_at then 'running' else w end as status from (
              select l.run_id, l.seq, l.occurred_at, last_value(case when {"event_type in ('run.started','run.completed','run.failed','run.cancelled','run.paused','run.suspended','run.resumed','step.retry_requested')"} then case event_type when 'run.started' then 'running' when 'run.resumed' then 'running' when 'step.retry_requested' then 'running' else substr(event_type, 5) end end ignore nulls) over w as w,
                max(case when {"event_type in ('run.started','run.completed','run.failed','run.cancelled','run.paused','run.suspended','run.resumed','step.retry_requested')"} then l.seq end) over w as set_at, max(gr.seq) over w as g
              from log l left join grants gr on gr.run_id = l.run_id and gr.seq = l.seq window w as (partition by l.run_id order by l.seq rows between unbounded preceding and current row))))) s join heads h using (run_id) where step is not null group by all)""",
    f"{STATUS_CTES}, {HEADS}",
)
#: The log's instants are dealt over days; windows are days and slides hours in place of minutes.
RATE = "select w as window_start{keys}, {aggs} from (select *, unnest(generate_series(time_bucket(interval '6 hours', occurred_at) - interval '18 hours', time_bucket(interval '6 hours', occurred_at), interval '6 hours')) as w from {rows}) group by w{keys}"


def rate_sql(rows: str, keys: str, aggs: str) -> str:
    return RATE.format(rows=rows, keys=f", {keys}" if keys else "", aggs=aggs)


def rated(rows, keys, *aggs):
    return metrics.windowed(rows, "1 day", "6 hours", keys, *aggs)


on_log("i09_run_rate", lambda g: rated(g.where("event_type = 'run.started'"), [], (F.count("*") / 24.0).alias("per_hour")), rate_sql("(select * from log where event_type = 'run.started')", "", "count(*) / 24.0::double as per_hour"))
on_log(
    "i10_error_rate", lambda g: rated(g.where(F.col("event_type").isin(spans.TERMINAL_EVENTS)), [], (F.sum((F.col("event_type") == "run.failed").cast("double")) / F.greatest(F.count("*").cast("double"), F.lit(1e-9))).alias("error_rate")),
    rate_sql("(select * from log where event_type in ('run.completed', 'run.failed', 'run.cancelled'))", "", "(count(*) filter (event_type = 'run.failed'))::double / greatest(count(*)::double, 1e-9) as error_rate"),
)
on_log(
    "i11_latency_exact", lambda g: metrics.run_durations(g).groupBy("workflow").agg(*[F.percentile("seconds", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]),
    "select workflow, quantile_cont(seconds, 0.5) as p50, quantile_cont(seconds, 0.95) as p95, quantile_cont(seconds, 0.99) as p99 from dur group by workflow", f"{HEADS}, {DUR}",
)
#: At an accuracy above the number of values the approximation is the discrete quantile.
on_log(
    "i11_latency_approx", lambda g: metrics.run_durations(g).groupBy("workflow").agg(F.percentile_approx("seconds", 0.5, 1000000).alias("p50"), F.percentile_approx("seconds", 0.95, 1000000).alias("p95")),
    "select workflow, quantile_disc(seconds, 0.5) as p50, quantile_disc(seconds, 0.95) as p95 from dur group by workflow", f"{HEADS}, {DUR}",
)
on_log(
    "i11_latency_buckets", lambda g: metrics.bucket_quantile(metrics.histogram(metrics.run_durations(g), ["workflow"], "seconds", metrics.RUN_BUCKETS), ["workflow"], 0.5, metrics.RUN_BUCKETS),
    """select workflow, case when hi = 1e300 then 3600.0 else lo + (hi - lo) * (rank - below) / (n - below) end::double as quantile from (
      select *, lag(hi, 1, 0.0) over (partition by workflow order by hi) as lo, lag(n, 1, 0) over (partition by workflow order by hi) as below, 0.5 * max(n) over (partition by workflow) as rank from (
        select workflow, b.hi::double as hi, (count(*) filter (seconds <= b.hi))::double as n from dur cross join (values (0.1), (0.5), (1.0), (2.0), (5.0), (10.0), (30.0), (60.0), (300.0), (900.0), (3600.0), (1e300)) b(hi) group by all)) where n >= rank qualify row_number() over (partition by workflow order by hi) = 1""",
    f"{HEADS}, {DUR}",
)
on_log(
    "i12_step_outcome_rate", lambda g: rated(g.withColumn("outcome", metrics.step_outcome()).where("outcome is not null"), ["outcome"], (F.count("*") / 86400.0).alias("per_second")),
    rate_sql(f"(select *, {OUTCOME} as outcome from log where event_type in ('step.completed', 'step.failed', 'step.dead_lettered'))", "outcome", "count(*) / 86400.0::double as per_second"),
)
on_log(
    "i13_retry_rate", lambda g: rated(g.where("event_type = 'step.failed' and not terminal"), ["step_id"], F.count("*").alias("n")),
    rate_sql("(select * from log where event_type = 'step.failed' and not terminal)", "step_id", "count(*) as n"),
)


def _tokens(g):
    agents = g.where("event_type = 'step.started'").groupBy("run_id", "step_id").agg(F.max("agent").alias("executor"))
    done = g.where("event_type = 'step.completed'").join(agents, ["run_id", "step_id"])
    units = F.explode(F.array(F.struct(F.lit("input_tokens").alias("meter"), F.col("tokens").alias("q")), F.struct(F.lit("requests").alias("meter"), F.lit(1).cast("bigint").alias("q"))))
    rows = done.select("executor", "occurred_at", units.alias("u")).select("executor", "occurred_at", "u.meter", "u.q").where(F.col("meter").rlike(".*tokens"))
    return rated(rows, ["executor", "meter"], F.sum("q").alias("tokens"))


on_log(
    "i14_token_rate", _tokens,
    rate_sql("(select l.*  replace (a.agent as agent), a.agent as executor, 'input_tokens' as meter from log l join agents a on a.run_id = l.run_id and a.step_id = l.step_id where event_type = 'step.completed')", "executor, meter", "sum(tokens)::bigint as tokens"), DONE_SQL,
)
on_log(
    "i15_approval_wait_p95", lambda g: rated(metrics.approval_waits(fold.approvals(g)).withColumn("occurred_at", F.col("decided_at")), ["approval_status"], F.percentile("seconds", 0.95).alias("p95")),
    rate_sql("(select decision as approval_status, seconds, decided_at as occurred_at from waits)", "approval_status", "quantile_cont(seconds, 0.95) as p95"), f"{APPROVALS}, {WAITS}",
)
on_log(
    "i16_cost_rate", lambda g: rated(with_workflow(g).where("event_type = 'step.completed'"), ["workflow"], F.sum("cost").cast("double").alias("cost")),
    rate_sql("(select * from wf where event_type = 'step.completed')", "workflow", "sum(cost)::double as cost"), f"{HEADS}, {WF}",
)
on_log(
    "i17_fleet_cube", lambda g: metrics.run_durations(g).withColumn("month", F.date_format("occurred_at", "yyyy-MM")).cube("workflow", "outcome", "month").agg(F.count("*").alias("runs"), F.sum("seconds").alias("seconds"), F.grouping_id().cast("bigint").alias("level")),
    "select workflow, outcome, strftime(occurred_at, '%Y-%m') as month, count(*) as runs, sum(seconds) as seconds, grouping(workflow, outcome, strftime(occurred_at, '%Y-%m'))::bigint as level from dur group by cube (workflow, outcome, strftime(occurred_at, '%Y-%m'))", f"{HEADS}, {DUR}",
)
on_log(
    "i17_fleet_rollup", lambda g: metrics.run_durations(g).rollup("workflow", "outcome").agg(F.count("*").alias("runs"), F.grouping_id().cast("bigint").alias("level")),
    "select workflow, outcome, count(*) as runs, grouping(workflow, outcome)::bigint as level from dur group by rollup (workflow, outcome)", f"{HEADS}, {DUR}",
)
on_log(
    "i18_distinct_exact", lambda g: g.agg(F.count_distinct("run_id").alias("runs"), F.count_distinct("agent").alias("agents"), F.count_distinct("model_id").alias("models")),
    "select count(distinct run_id) as runs, count(distinct agent) as agents, count(distinct model_id) as models from log",
)
#: Whether the sketch lies within five percent; the sketch itself differs between engines.
on_log(
    "i18_distinct_approx", lambda g: g.agg((F.abs(F.approx_count_distinct("run_id", 0.01) / F.count_distinct("run_id") - 1) < 0.05).alias("close")),
    "select true as close",
)


def _rollup(spark, g):
    """Sketches by workflow and day go to a table; a workflow's and all workflows' figures come from merging them."""
    folder = f"{shared_dir(spark)}/sketches-{uuid.uuid4().hex}"
    runs, steps = metrics.run_durations(g), with_workflow(g.where("event_type in ('run.started', 'step.started', 'step.completed')"))
    tables = []
    for name, rows in (("runs", sketches.daily(runs, ["workflow"], ["run_id"], ["seconds"])), ("steps", sketches.daily(steps, ["workflow"], ["agent", "model_id"], []))):
        rows.write.parquet(f"{folder}/{name}")
        tables.append(spark.read.schema(rows.schema).parquet(f"{folder}/{name}"))
    out = None
    for key in (F.col("workflow"), F.lit("all")):
        a, b = (sketches.merged(t, key.alias("workflow")) for t in tables)
        part = a.join(b.drop("n"), "workflow")
        out = part if out is None else out.unionByName(part)
    return out


def _rolled(g):
    merged = _rollup(g.sparkSession, g)
    close = F.abs(sketches.distinct_count("hll_run_id") / F.col("n") - 1) < 0.05
    return merged.select("workflow", F.col("n").alias("runs"), close.alias("runs_close"), sketches.distinct_count("hll_agent").alias("agents"), sketches.distinct_count("hll_model_id").alias("models"))


#: Agents and models are so few that their sketches count exactly; of runs the estimate's distance from their number is told.
on_log(
    "i18_sketch_rollup", _rolled,
    """select workflow, count(*) filter (event_type in ('run.completed', 'run.failed', 'run.cancelled')) as runs, true as runs_close, count(distinct agent) as agents, count(distinct model_id) as models from both_wf group by workflow""",
    f"{HEADS}, own_wf as (select h.workflow as workflow, event_type, case when event_type = 'step.started' then agent end as agent, case when event_type = 'step.completed' then model_id end as model_id from log l join heads h using (run_id)), both_wf as (select * from own_wf union all select * replace ('all' as workflow) from own_wf)",
    store=["run_id", "seq", "event_type", "occurred_at", "workflow", "agent", "model_id"],
)


#: Columns of each metric table in the long form, at most four labels; spans are counted by status or name.
SAMPLES = {
    "runs": ["workflow", "outcome"], "run_seconds": ["workflow", "outcome", "le"], "steps_started": ["workflow", "step_id", "agent"], "steps_ended": ["workflow", "step_id", "outcome"], "step_seconds": ["workflow", "outcome", "le"],
    "retries_and_dead_letters": ["workflow", "event_type", "effect_class"], "approvals": ["workflow", "event_type", "effect_class", "principal_kind"], "approval_seconds": ["decision", "le"],
}
COUNTED = {"run_spans": ["name", "status"], "step_spans": ["outcome", "status"], "point_spans": ["name"]}
TWINS = {
    "runs": "i01_run_counters", "run_seconds": "i02_run_duration_histogram", "steps_started": "i03_steps_started", "steps_ended": "i03_steps_ended", "step_seconds": "i04_step_duration_histogram", "retries_and_dead_letters": "i05_retries_and_dead_letters",
    "approvals": "i06_approval_counters", "approval_seconds": "i07_approval_wait_histogram", "run_spans": "h01_run_spans", "step_spans": "h02_step_spans", "point_spans": "h04_point_spans",
}


def _rebuilt_sql() -> str:
    parts = []
    for name, labels in (SAMPLES | COUNTED).items():
        wide = ", ".join(f"{c} as l{i}" for i, c in enumerate([*labels, *["null::varchar"] * (4 - len(labels))]))
        n = "n" if name in SAMPLES else "count(*)"
        parts.append(f"select '{name}' as series, {wide}, {n}::bigint as n from ({SQL[TWINS[name]]}) t{'' if name in SAMPLES else ' group by ' + ', '.join(labels)}")
    return " union all ".join(parts)


@query("a18_rebuilt_telemetry", _rebuilt_sql())
def _a18(spark, sf_dir):
    """All tables written from one derivation of the log; the samples and span counts read back from them."""
    written = telemetry.rebuild(derive(spark, sf_dir), f"{shared_dir(spark)}/telemetry-{uuid.uuid4().hex}", partitions(spark, sf_dir))
    out = None
    for name, labels in (SAMPLES | COUNTED).items():
        rows = written[name] if name in SAMPLES else written[name].groupBy(*labels).agg(F.count("*").alias("n"))
        wide = [F.col(labels[i]).alias(f"l{i}") if i < len(labels) else F.lit(None).cast("string").alias(f"l{i}") for i in range(4)]
        part = rows.select(F.lit(name).alias("series"), *wide, F.col("n").cast("bigint").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
