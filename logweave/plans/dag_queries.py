"""Queries of workflow graphs. A workflow per order: its lines are nodes, its dependencies follow from suppliers and quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dag, fold, spans
from ..sources.run_log import STEP_SQL, derive, steps
from .base import on_log, query
from .log_sql import over_log
from .metric_queries import SPANS

DEPS = "case when k > 1 then array(concat('s', cast(k - 1 - mod(supp, least(k - 1, 3)) as string))) else array() end"
MORE = "case when k > 2 and qty > 30 then array(concat('s', cast(div(k, 2) as string))) else array() end"
BROKEN = "case when mod(okey, 29) = 0 and k = 2 then array('s99') when mod(okey, 31) = 0 and k = 1 then array(concat('s', cast(last as string))) else array() end"


def definitions(spark, sf_dir, broken=False):
    """Nodes per order; with `broken`, some orders depend on a node that is not there, and some on their own last node."""
    rows = steps(spark, sf_dir).withColumn("last", F.expr("max(k) over (partition by run_id)"))
    more = MORE.replace("div(k, 2)", "k div 2")
    deps = f"array_distinct(concat({DEPS}, {more}{', ' + BROKEN if broken else ''}))"
    return rows.selectExpr("run_id as workflow", "concat('s', cast(k as string)) as node", "concat('agent', cast(mod(supp, 7) as string)) as agent", f"{deps} as depends_on")


NODES = f"""
all_steps as ({STEP_SQL.format(lineitem='lineitem', orders='orders', part='part')}),
ns as (select *, max(k) over (partition by okey) as last, md5('run:' || okey) as wf from all_steps),
nodes as (select wf as workflow, 's' || k as node, 'agent' || (supp % 7) as agent from ns),
raw_edges as (
  select wf as workflow, 's' || (k - 1 - supp % least(k - 1, 3)) as dep, 's' || k as node from ns where k > 1
  union select wf, 's' || (k // 2), 's' || k from ns where k > 2 and qty > 30),
broken_edges as (select * from raw_edges union select wf, 's99', 's2' from ns where okey % 29 = 0 and k = 2 union select wf, 's' || last, 's1' from ns where okey % 31 = 0 and okey % 29 <> 0 and k = 1 union select wf, 's' || last, 's1' from ns where okey % 31 = 0 and okey % 29 = 0 and k = 1)
"""


@query("f01_edges", f"with {NODES} select * from raw_edges")
def _f01(spark, sf_dir):
    return dag.edges(definitions(spark, sf_dir))


@query("f02_dangling", f"with {NODES} select * from broken_edges e where not exists (select 1 from nodes n where n.workflow = e.workflow and n.node = e.dep)")
def _f02(spark, sf_dir):
    return dag.dangling(definitions(spark, sf_dir, broken=True))


@query(
    "f02_cyclic",
    f"""with recursive {NODES}, known as (select e.* from broken_edges e join nodes n on n.workflow = e.workflow and n.node = e.dep where e.workflow in (select workflow from broken_edges where dep <> 's99' and node = 's1')),
    reach(workflow, a, b) as (select workflow, dep, node from known union select r.workflow, r.a, k.node from reach r join known k on k.workflow = r.workflow and k.dep = r.b),
    loops as (select workflow, a as node from reach where a = b),
    stuck as (select workflow, node from loops union select r.workflow, r.b from reach r join loops l on l.workflow = r.workflow and l.node = r.a)
    select workflow, min(node) as stuck from stuck group by workflow""",
)
def _f02c(spark, sf_dir):
    return dag.cyclic(definitions(spark, sf_dir, broken=True))


WAVES = f"with recursive {NODES}, paths(workflow, node, level) as (select n.workflow, n.node, 0::bigint from nodes n where not exists (select 1 from raw_edges e where e.workflow = n.workflow and e.node = n.node) union select e.workflow, e.node, p.level + 1 from paths p join raw_edges e on e.workflow = p.workflow and e.dep = p.node)"


@query("f03_waves", f"{WAVES} select workflow, node, max(level) as wave from paths group by all")
def _f03(spark, sf_dir):
    return dag.waves(definitions(spark, sf_dir))


#: By waves: a node stands behind the latest of its dependencies, which is of the wave before; ties by name.
ORDER = f"""{WAVES}, wave as (select workflow, node, max(level) as wave from paths group by all),
widths as (select workflow, wave, coalesce(sum(count(*)) over (partition by workflow order by wave rows between unbounded preceding and 1 preceding), 0) as before from wave group by workflow, wave),
sized as (select w.workflow, w.node, w.wave, c.before from wave w join widths c on c.workflow = w.workflow and c.wave = w.wave),
places(workflow, node, wave, place) as (
  select workflow, node, wave, row_number() over (partition by workflow order by node) from sized where wave = 0
  union all
  select workflow, node, wave, before + row_number() over (partition by workflow order by latest, node) from (
    select s.workflow, s.node, s.wave, s.before, max(p.place) as latest from places p join raw_edges e on e.workflow = p.workflow and e.dep = p.node
    join sized s on s.workflow = e.workflow and s.node = e.node and s.wave = p.wave + 1 group by all))"""


@query("f04_topological_order", f"{ORDER} select workflow, place, node from places")
def _f04(spark, sf_dir):
    return dag.topological_order(definitions(spark, sf_dir))


def _prefix(spark, sf_dir):
    g = derive(spark, sf_dir).where("seq <= 7")
    as_node = lambda df: df.withColumnsRenamed({"run_id": "workflow", "step_id": "node"})
    return g, as_node


PREFIX = """
pre as (select * from log where seq <= 7),
done as (select run_id as workflow, step_id as node from pre where event_type = 'step.completed'),
waiting as (select a.run_id as workflow, a.step_id as node, retry_at from pre a where event_type = 'step.failed' and not terminal and not exists (select 1 from pre b where b.run_id = a.run_id and b.step_id = a.step_id and b.seq > a.seq and b.event_type = 'step.started'))
"""
SHARED = NODES.replace("nodes as (", "nodes as (").strip()


@query(
    "f05_ready_nodes",
    over_log("select workflow, node from nodes n where not exists (select 1 from done d where d.workflow = n.workflow and d.node = n.node) and not exists (select 1 from raw_edges e where e.workflow = n.workflow and e.node = n.node and not exists (select 1 from done d where d.workflow = e.workflow and d.node = e.dep)) and not exists (select 1 from waiting w where w.workflow = n.workflow and w.node = n.node and w.retry_at > timestamp '1996-01-01')", f"{PREFIX}, {SHARED}"),
)
def _f05(spark, sf_dir):
    g, as_node = _prefix(spark, sf_dir)
    return dag.ready(definitions(spark, sf_dir), as_node(fold.completed_steps(g)), as_node(fold.pending_retries(g)), F.lit("1996-01-01").cast("timestamp_ntz"))


@query(
    "f06_node_states",
    over_log(
        """select n.workflow, n.node, case when exists (select 1 from done d where d.workflow = n.workflow and d.node = n.node) then 'completed'
        when exists (select 1 from pre p where p.run_id = n.workflow and p.step_id = n.node and event_type = 'step.dead_lettered' and not exists (select 1 from pre r where r.run_id = p.run_id and r.step_id = p.step_id and r.seq > p.seq and r.event_type = 'step.retry_requested')) then 'dead_lettered'
        when exists (select 1 from pre p where p.run_id = n.workflow and p.step_id = n.node and event_type = 'step.failed' and terminal and not exists (select 1 from pre r where r.run_id = p.run_id and r.step_id = p.step_id and r.seq > p.seq and r.event_type = 'step.retry_requested')) then 'failed'
        when exists (select 1 from pre p where p.run_id = n.workflow and p.step_id = n.node and event_type = 'approval.requested' and not exists (select 1 from pre r where r.run_id = p.run_id and r.approval_id = p.approval_id and r.seq > p.seq)) then 'awaiting_approval'
        when exists (select 1 from waiting w where w.workflow = n.workflow and w.node = n.node) then 'retry_backoff'
        when exists (select 1 from pre p where p.run_id = n.workflow and p.step_id = n.node and event_type = 'step.started') then 'running' else 'pending' end as state from nodes n""",
        f"{PREFIX}, {SHARED}",
    ),
)
def _f06(spark, sf_dir):
    g, as_node = _prefix(spark, sf_dir)
    parts = {
        "completed": fold.completed_steps(g), "dead_lettered": fold.dead_lettered(g), "failed": fold.failed_steps(g), "cancelled": fold.cancelled_steps(g),
        "awaiting_approval": fold.approvals(g).where("approval_status = 'pending'"), "retry_backoff": fold.pending_retries(g), "running": fold.attempts(g),
    }
    return dag.node_states(definitions(spark, sf_dir), {k: as_node(v.select("run_id", "step_id")) for k, v in parts.items()})


on_log(
    "f07_parallelism", lambda g: dag.parallelism(spans.step_spans(g)),
    "select run_id, max(n)::bigint as peak from (select run_id, sum(d) over (partition by run_id order by t, d rows between unbounded preceding and current row) as n from (select s.run_id, s.started_at as t, 1 as d from ended s where coalesce(eseq, rseq) is not null union all select s.run_id, e.occurred_at, -1 from ended s join log e on e.run_id = s.run_id and e.seq = coalesce(eseq, rseq))) group by run_id", SPANS,
)


#: Spans stretched by up to half an hour, by the run's first digit, so that attempts overlap.
STRETCH = "cast(conv(substr(run_id, 1, 1), 16, 10) as int) % 4 * 600"
OPEN = "open_spans as (select s.run_id, s.step_id, s.attempt, s.started_at, e.occurred_at + to_seconds(('0x' || substr(s.run_id, 1, 1))::int % 4 * 600) as ended_at from ended s join log e on e.run_id = s.run_id and e.seq = coalesce(eseq, rseq))"


def _overlapping(g):
    return spans.step_spans(g).withColumn("ended_at", F.expr(f"ended_at + make_dt_interval(0, 0, 0, {STRETCH})"))


on_log(
    "f07_observed_waves", lambda g: dag.observed_waves(_overlapping(g)),
    """select run_id, step_id, attempt, sum(fresh) over (partition by run_id order by started_at, step_id, attempt)::bigint as wave from (
      select *, case when before is null or before <= started_at then 1 else 0 end as fresh from (select *, max(ended_at) over (partition by run_id order by started_at, step_id, attempt rows between unbounded preceding and 1 preceding) as before from open_spans))""",
    f"{SPANS}, {OPEN}",
)
on_log(
    "f07_over_parallelism", lambda g: dag.over_parallelism(_overlapping(g), g.where("event_type = 'run.started'").selectExpr("run_id", "cast(if(workflow < '3', 2, 3) as bigint) as max_parallelism")),
    """select run_id, peak, max_parallelism from (select run_id, max(n)::bigint as peak from (select run_id, sum(d) over (partition by run_id order by t, d rows between unbounded preceding and current row) as n
      from (select run_id, started_at as t, 1 as d from open_spans union all select run_id, ended_at, -1 from open_spans)) group by run_id)
      join (select run_id, case when workflow < '3' then 2 else 3 end::bigint as max_parallelism from log where event_type = 'run.started') using (run_id) where peak > max_parallelism""",
    f"{SPANS}, {OPEN}",
)


@query("f08_order_audit", over_log("select e.workflow as run_id, e.dep, e.node, s.seq as start_seq, d.seq as done_seq from broken_edges e join (select run_id, step_id, min(seq) as seq from log where event_type = 'step.started' group by all) s on s.run_id = e.workflow and s.step_id = e.node left join (select run_id, step_id, min(seq) as seq from log where event_type = 'step.completed' group by all) d on d.run_id = e.workflow and d.step_id = e.dep where d.seq is null or d.seq > s.seq", SHARED))
def _f08(spark, sf_dir):
    links = dag.edges(definitions(spark, sf_dir, broken=True)).withColumnRenamed("workflow", "run_id")
    return dag.order_audit(links, derive(spark, sf_dir))


DIGIT = "cast(conv(substr(run_id, 1, 1), 16, 10) as bigint)"
on_log(
    "f09_version_mismatch", lambda g: dag.version_mismatch(fold.header(g).selectExpr("run_id", "workflow", f"{DIGIT} % 4 + 1 as pinned_version"), g.where("event_type = 'run.started'").groupBy("workflow").agg(F.expr(f"max({DIGIT} % 3) + 1").alias("version"))).select("run_id", "pinned_version", "version"),
    "select run_id, pinned_version, version from (select run_id, workflow, ('0x' || substr(run_id, 1, 1))::bigint % 4 + 1 as pinned_version from log where event_type = 'run.started') join (select workflow, max(('0x' || substr(run_id, 1, 1))::bigint % 3) + 1 as version from log where event_type = 'run.started' group by 1) using (workflow) where pinned_version <> version",
)


def _pins(g):
    starts = g.where("event_type = 'step.started'")
    versions = starts.selectExpr("agent", f"{DIGIT} % 3 + cast(substr(agent, 6) as bigint) % 2 as version").where("version > 0").distinct()
    pins = starts.selectExpr("run_id", "step_id", "agent", f"{DIGIT} % 5 as pinned").distinct()
    return dag.resolve_pins(pins, versions)


on_log(
    "f10_resolved_pins", _pins,
    "select p.*, case when pinned > 0 then (select max(version) from v where v.agent = p.agent and v.version = p.pinned) else (select max(version) from v where v.agent = p.agent) end as resolved from (select distinct run_id, step_id, agent, ('0x' || substr(run_id, 1, 1))::bigint % 5 as pinned from log where event_type = 'step.started') p",
    "v as (select distinct agent, ('0x' || substr(run_id, 1, 1))::bigint % 3 + substr(agent, 6)::bigint % 2 as version from log where event_type = 'step.started' and ('0x' || substr(run_id, 1, 1))::bigint % 3 + substr(agent, 6)::bigint % 2 > 0)",
)


def _by_agent(g):
    agents = g.where("event_type = 'step.started'").groupBy("run_id", "step_id").agg(F.max("agent").alias("agent"))
    return fold.completed_steps(g).join(agents, ["run_id", "step_id"])


on_log(
    "f11_detected_substitutions", lambda g: dag.detected_substitutions(_by_agent(g)).select("run_id", "step_id", "agent", "from_model", "model_id"),
    "select run_id, step_id, agent, from_model, model_id from (select l.run_id, l.step_id, a.agent, l.model_id, lag(l.model_id) over (partition by l.run_id, a.agent order by l.seq) as from_model from log l join (select run_id, step_id, max(agent) as agent from log where event_type = 'step.started' group by all) a on a.run_id = l.run_id and a.step_id = l.step_id where l.event_type = 'step.completed') where from_model <> model_id",
)
on_log(
    "f12_backoff_check", lambda g: g.where("event_type = 'step.failed' and retry_at is not null").select("run_id", "step_id", dag.backoff_seconds(F.col("attempt") + 1, 300.0, 2.0, 3600.0).alias("expected"), (F.timestamp_diff("SECOND", F.col("occurred_at"), F.col("retry_at"))).alias("recorded")),
    "select run_id, step_id, least(3600.0, 300.0 * power(2.0, attempt + 1 - 2))::double as expected, date_diff('second', occurred_at, retry_at) as recorded from log where event_type = 'step.failed' and retry_at is not null",
)
on_log("f13_retry_storms", lambda g: dag.retry_storms(g, 100), "select run_id, step_id, count(*) as starts, max(attempt) as attempt from log where event_type = 'step.started' group by all order by starts desc, run_id, step_id limit 100")
on_log(
    "f14_completed_twice", lambda g: dag.completed_twice(g.unionByName(g.where("event_type = 'step.completed' and mod(seq, 5) = 0"))),
    "select run_id, step_id, count(*) + 1 as n from log where event_type = 'step.completed' and seq % 5 = 0 group by all",
)


def _inputs(spark, sf_dir):
    g = derive(spark, sf_dir)
    links = dag.edges(definitions(spark, sf_dir)).withColumnRenamed("workflow", "run_id")
    outputs = fold.completed_steps(g).select("run_id", "step_id", F.concat(F.lit('{"tokens":'), "tokens", F.lit("}")).alias("output"))
    whole = fold.header(g).select("run_id", F.concat(F.lit('{"request":"'), "request_id", F.lit('"}')).alias("output"))
    return dag.step_inputs(links, outputs, whole)


INPUTS = "outs as (select run_id, step_id, '{\"tokens\":' || tokens || '}' as output from log where event_type = 'step.completed'), ins as (select e.workflow as run_id, e.node as step_id, e.dep as name, o.output from raw_edges e join outs o on o.run_id = e.workflow and o.step_id = e.dep union all select distinct e.workflow, e.node, 'run', '{\"request\":\"' || l.request_id || '\"}' from raw_edges e join log l on l.run_id = e.workflow and l.event_type = 'run.started')"


@query("f15_idempotency_keys", over_log("select run_id, step_id, run_id || ':' || step_id || ':' || sha256('{' || string_agg('\"' || name || '\":' || output, ',' order by name) || '}') as idempotency_key from ins group by run_id, step_id", f"{SHARED}, {INPUTS}"))
def _f15(spark, sf_dir):
    return dag.idempotency_keys(_inputs(spark, sf_dir))


on_log(
    "f16_run_lineage", lambda g: dag.lineage(fold.header(g)),
    "select run_id, root, depth from up where parent is null or not exists (select 1 from heads h where h.run_id = up.parent)",
    "heads as (select run_id, parent_run_id as parent from log where event_type = 'run.started'), up as (with recursive u(run_id, root, parent, depth) as (select run_id, run_id, parent, 0::bigint from heads union all select u.run_id, h.run_id, h.parent, u.depth + 1 from u join heads h on h.run_id = u.parent) select * from u)",
)

on_log(
    "f16_subtree_cost", lambda g: dag.subtree_totals(fold.header(g).select("run_id", "parent_run_id").join(fold.total_cost(g).select("run_id", "total_cost"), "run_id"), ["total_cost"]).withColumn("total_cost", F.col("total_cost").cast("double")),
    "select a as run_id, count(*) as n_runs, sum(cost)::double as total_cost from up join costs c on c.run_id = up.d group by a",
    """heads as (select run_id, parent_run_id as parent from log where event_type = 'run.started'), costs as (select run_id, coalesce(sum(cost) filter (event_type in ('step.completed', 'step.dead_lettered')), 0) as cost from log group by run_id),
    up as (with recursive u(d, a, parent) as (select run_id, run_id, parent from heads union all select u.d, h.run_id, h.parent from u join heads h on h.run_id = u.parent) select * from u)""",
    ["run_id", "seq", "event_type", "occurred_at", "workflow", "request_id", "parent_run_id", "cost"],
)


@query("f17_step_inputs", over_log("select run_id, step_id, string_agg(name || '=' || output, ',' order by name) as inputs from ins group by run_id, step_id", f"{SHARED}, {INPUTS}"))
def _f17(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.map_entries("inputs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _inputs(spark, sf_dir).select("run_id", "step_id", text.alias("inputs"))


on_log(
    "f18_failing_wave", dag.failing_wave,
    "select d.run_id, d.step_id, d.seq as dead_seq, f.seq as failed_seq, (select count(*) from log l where l.run_id = d.run_id and l.event_type = 'step.completed' and l.seq between d.seq and f.seq) as survivors from (select * from log where event_type = 'step.dead_lettered' qualify row_number() over (partition by run_id order by seq) = 1) d join log f on f.run_id = d.run_id and f.event_type = 'run.failed'",
)
