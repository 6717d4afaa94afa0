"""Queries of budgets, policies and gates. Budgets come from customers, policies from nations, agents from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fold, governance, metrics
from ..sources.run_log import with_workflow
from .base import on_log, query, table
from .fold_queries import APPROVALS
from .metric_queries import HEADS, SETTLED, WF
from .view_queries import _undecided

C = governance.CLASSES
BITS = {"allowed": "c_custkey", "approval": "floor(c_custkey / 3)", "ceiling": "n_nationkey * 5 + 3", "always_approve": "n_nationkey * 11"}


def _set(expr: str) -> str:
    """Classes whose bit is set, as a sorted Spark array."""
    return "filter(array(" + ", ".join(f"case when mod(floor(({expr}) / {2**i}), 2) = 1 then '{c}' end" for i, c in enumerate(C)) + "), x -> x is not null)"


def budgets(spark, sf_dir):
    """One budget per customer under its nation's policy; nations divisible by 6 have none, and some no effect ceiling."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.selectExpr(
        "c_custkey", "c_nationkey", f"{_set(BITS['allowed'])} as allowed", f"array_except({_set(BITS['approval'])}, {_set(BITS['allowed'])}) as approval", "c_custkey % 2 = 0 as allow_agent",
        "if(c_custkey % 3 = 0, null, cast(c_custkey % 50 as bigint)) as max_step_cost", "if(c_custkey % 5 = 0, null, cast(c_custkey % 500 as bigint)) as max_run_cost", "if(c_custkey % 7 = 0, null, cast(c_custkey % 60 as bigint)) as max_wall",
        "n_nationkey % 6 <> 0 as has_policy", f"if(n_nationkey % 4 = 0, null, {_set(BITS['ceiling'])}) as ceiling", f"{_set(BITS['always_approve'])} as always_approve", "n_nationkey % 2 = 1 as agent_allowed",
        "if(n_nationkey % 3 = 0, null, 20L) as p_step_cost", "if(n_nationkey % 3 = 1, null, 200L) as p_run_cost", "if(n_nationkey % 3 = 2, null, 30L) as p_wall",
    )


def _bit(expr: str, i: int) -> str:
    return f"mod(floor(({expr}) / {2**i}), 2) = 1"


#: The twin keeps sets as rows (customer, class).
SETS_SQL = f"""
b as (select *, n_nationkey % 6 <> 0 as has_policy, n_nationkey % 4 = 0 as no_ceiling from customer join nation on c_nationkey = n_nationkey),
cls(i, cls) as (values {", ".join(f"({i}, '{c}')" for i, c in enumerate(C))}),
mem as (select c_custkey, c_nationkey, has_policy, no_ceiling, cls,
  mod(floor(c_custkey / power(2, i)), 2) = 1 as a0, mod(floor(floor(c_custkey / 3) / power(2, i)), 2) = 1 and not mod(floor(c_custkey / power(2, i)), 2) = 1 as p0,
  not has_policy or no_ceiling or mod(floor((n_nationkey * 5 + 3) / power(2, i)), 2) = 1 as inside, has_policy and mod(floor((n_nationkey * 11) / power(2, i)), 2) = 1 as always from b cross join cls),
eff as (select *, a0 and inside and not always as ea, (p0 and inside) or (a0 and inside and always) as ep from mem),
sets as (select c_custkey, coalesce(string_agg(cls, ',' order by cls) filter (ea), '') as eff_allowed, coalesce(string_agg(cls, ',' order by cls) filter (ep), '') as eff_approval,
  string_agg(cls, ', ' order by cls) filter (a0 and not inside) as gone_a, string_agg(cls, ', ' order by cls) filter (p0 and not inside) as gone_p,
  string_agg(cls || ': allowed → approval_required (always_approve)', ' | ' order by cls) filter (a0 and inside and always) as moved from eff group by c_custkey),
lim as (select c_custkey, c_custkey % 2 = 0 as allow_agent, c_custkey % 2 = 0 and not (has_policy and n_nationkey % 2 = 0) as eff_allow_agent, has_policy,
  case when c_custkey % 3 <> 0 then c_custkey % 50 end as s, case when c_custkey % 5 <> 0 then c_custkey % 500 end as r, case when c_custkey % 7 <> 0 then c_custkey % 60 end as w,
  case when n_nationkey % 3 <> 0 then 20 end as ps, case when n_nationkey % 3 <> 1 then 200 end as pr, case when n_nationkey % 3 <> 2 then 30 end as pw from b),
lim2 as (select *, case when has_policy then least(s, ps) else s end as es, case when has_policy then least(r, pr) else r end as er, case when has_policy then least(w, pw) else w end as ew from lim)
"""


@query("e01_effective_budget", f"with {SETS_SQL} select c_custkey, eff_allowed, eff_approval, eff_allow_agent, es::bigint as eff_max_step_cost, er::bigint as eff_max_run_cost, ew::bigint as eff_max_wall from sets join lim2 using (c_custkey)")
def _e01(spark, sf_dir):
    rows = governance.effective_budget(budgets(spark, sf_dir))
    return rows.select("c_custkey", F.array_join("eff_allowed", ",").alias("eff_allowed"), F.array_join("eff_approval", ",").alias("eff_approval"), "eff_allow_agent", "eff_max_step_cost", "eff_max_run_cost", "eff_max_wall")


@query(
    "e02_narrowings",
    f"""with {SETS_SQL} select c_custkey, concat_ws(' | ', case when gone_a is not null then 'allowed_effect_classes: removed ' || gone_a || ' (outside effect_ceiling)' end, case when gone_p is not null then 'approval_required_for: removed ' || gone_p || ' (outside effect_ceiling)' end, moved,
    case when allow_agent and not eff_allow_agent then 'allow_agent_approval: true → false (agent_approval_allowed=false)' end, case when es is distinct from s then 'max_step_cost: ' || coalesce(s::varchar, 'None') || ' → ' || es end,
    case when er is distinct from r then 'max_run_cost: ' || coalesce(r::varchar, 'None') || ' → ' || er end, case when ew is distinct from w then 'max_step_wall_seconds: ' || coalesce(w::varchar, 'None') || ' → ' || ew end) as narrowed from sets join lim2 using (c_custkey)""",
)
def _e02(spark, sf_dir):
    return governance.effective_budget(budgets(spark, sf_dir)).select("c_custkey", F.array_join("narrowed", " | ").alias("narrowed"))


def _nodes(spark, sf_dir):
    """A node per order for its customer's workflow, with the agent named after a part; some agents are unknown."""
    eff = governance.effective_budget(budgets(spark, sf_dir)).select("c_custkey", "eff_allowed", "eff_approval", F.expr("if(c_nationkey % 5 = 0, null, array('e0', concat('e', c_nationkey % 3)))").alias("executors"))
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "concat('p', o_orderkey % 900) as agent").join(eff, F.col("o_custkey") == F.col("c_custkey"))


def _agents(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey < 800").selectExpr("concat('p', p_partkey) as agent", f"{_set('p_size')} as declared", "concat('e', p_partkey % 3) as executor").dropDuplicates(["agent"])


AGENT_SQL = "ag as (select 'p' || p_partkey as agent, p_size, 'e' || (p_partkey % 3) as executor from part where p_partkey < 800), nodes as (select o_orderkey, o_custkey, 'p' || (o_orderkey % 900) as agent, c_nationkey from orders join customer on o_custkey = c_custkey)"
TIER_SQL = "tiers as (select n.o_orderkey, n.c_nationkey, a.executor, e.cls, case when e.ea then 'runs' when e.ep then 'asks approval' else 'REFUSED' end as tier from nodes n join ag a using (agent) join eff e on e.c_custkey = n.o_custkey join cls c on c.cls = e.cls where mod(floor(a.p_size / power(2, c.i)), 2) = 1)"


@query("e03_class_tiers", f"with {SETS_SQL}, {AGENT_SQL}, {TIER_SQL} select o_orderkey, cls as effect_class, tier from tiers")
def _e03(spark, sf_dir):
    return governance.class_tiers(_nodes(spark, sf_dir).join(_agents(spark, sf_dir), "agent")).select("o_orderkey", "effect_class", "tier")


@query(
    "e04_node_outcome",
    f"""with {SETS_SQL}, {AGENT_SQL}, {TIER_SQL}, worst as (select o_orderkey, bool_or(tier = 'REFUSED') as refused, bool_or(tier = 'asks approval') as asks from tiers group by 1)
    select n.o_orderkey, n.agent, case when a.agent is null then 'unknown agent' when not (c_nationkey % 5 = 0 or a.executor in ('e0', 'e' || (c_nationkey % 3))) then 'fails at dispatch (executor not allowed)' when refused then 'refused' when asks then 'asks approval' else 'runs' end as outcome
    from nodes n left join ag a using (agent) left join worst using (o_orderkey)""",
)
def _e04(spark, sf_dir):
    return governance.node_outcome(_nodes(spark, sf_dir), _agents(spark, sf_dir)).select("o_orderkey", "agent", "outcome")


@query("e05_executor_allowed", f"with {AGENT_SQL} select c_nationkey, executor, (c_nationkey % 5 = 0 or executor in ('e0', 'e' || (c_nationkey % 3))) as ok, count(*) as nodes from nodes join ag using (agent) group by all")
def _e05(spark, sf_dir):
    nation = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = _nodes(spark, sf_dir).drop("c_custkey").join(_agents(spark, sf_dir), "agent").join(nation, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey", "executor", governance.executor_allowed(F.col("executors"), F.col("executor")).alias("ok")).agg(F.count("*").alias("nodes"))


@query(
    "e06_gate_classes",
    f"with {SETS_SQL}, {AGENT_SQL}, {TIER_SQL} select n.o_orderkey, coalesce(case when not bool_or(tier = 'REFUSED') then string_agg(cls, ',' order by cls) filter (tier = 'asks approval') end, '') as classes from nodes n join ag using (agent) left join tiers t using (o_orderkey) group by n.o_orderkey",
)
def _e06(spark, sf_dir):
    rows = _nodes(spark, sf_dir).join(_agents(spark, sf_dir), "agent")
    return rows.select("o_orderkey", F.array_join(governance.gate_classes(F.col("declared"), F.col("eff_allowed"), F.col("eff_approval")), ",").alias("classes"))


def _gated_steps(g):
    return g.where("event_type = 'approval.requested'").select("run_id", "step_id").distinct()


on_log(
    "e07_gate_decisions", lambda g: governance.gate_decisions(_gated_steps(g), fold.approvals(_undecided(g))),
    """select g.run_id, g.step_id, case when a.kind = 'effect' and a.approval_status = 'granted' then 'run' when a.kind = 'effect' and a.approval_status = 'pending' then 'pending' else 'request' end as decision, case when a.kind = 'effect' and a.approval_status = 'granted' then a.approval_id end as granted_id
    from (select distinct run_id, step_id from base where event_type = 'approval.requested') g left join approvals a on a.run_id = g.run_id and a.step_id = g.step_id""",
    "base as (select l.*, (select min(s.seq) from log s where s.run_id = l.run_id and s.event_type = 'run.suspended') as cut from log l), " + APPROVALS.replace("from log", "from (select * exclude (cut) from base where seq <= cut)").replace("join log q", "join base q"),
)


def _reported(g):
    """Completions with what their agent declares and what they report."""
    agents = g.where("event_type = 'step.started'").groupBy("run_id", "step_id").agg(F.max("agent").alias("agent"))
    done = g.where("event_type = 'step.completed'").drop("agent").join(agents, ["run_id", "step_id"])
    names = ", ".join(f"'{c}'" for c in C)
    return done.selectExpr("run_id", "step_id", f"{_set('cast(substr(agent, 6) as bigint) * 13 + 5')} as declared", f"array_distinct(array(element_at(array({names}), cast(mod(tokens / 100, 7) as int) + 1), element_at(array({names}), cast(mod(tokens / 100, 3) as int) + 1))) as reported")


NAMES_SQL = "[" + ", ".join(f"'{c}'" for c in C) + "]"
on_log(
    "e08_undeclared_effects", lambda g: governance.undeclared_effects(_reported(g)).select("run_id", "step_id", "undeclared"),
    "select run_id, step_id, min(r) as undeclared from rep join cls on cls = r where not mod(floor((a * 13 + 5) / power(2, i)), 2) = 1 group by all",
    f"cls(i, cls) as (values {', '.join(f'({i}, {c!r})' for i, c in enumerate(C))}), ags as (select run_id, step_id, substr(max(agent), 6)::int as a from log where event_type = 'step.started' group by all), rep as (select l.run_id, l.step_id, a, unnest([{NAMES_SQL}[(tokens // 100 % 7 + 1)::int], {NAMES_SQL}[(tokens // 100 % 3 + 1)::int]]) as r from log l join ags a on a.run_id = l.run_id and a.step_id = l.step_id where event_type = 'step.completed')",
)


def _limits(g):
    return g.where("event_type = 'run.started'").select("workflow").distinct().selectExpr("workflow", "if(substr(workflow, 1, 1) = '5', null, cast(substr(workflow, 1, 1) as int) * 12000) as max_step_cost", "cast(substr(workflow, 1, 1) as int) * 60 as max_wall")


on_log(
    "e09_over_step_cost", lambda g: governance.over_step_cost(with_workflow(g).where("event_type = 'step.completed'"), _limits(g)).select("run_id", "step_id", F.col("cost").cast("double").alias("cost")),
    "select run_id, step_id, cost::double as cost from (select *, max(workflow) over (partition by run_id) as w from log) where event_type = 'step.completed' and substr(w, 1, 1) <> '5' and cost > substr(w, 1, 1)::int * 12000",
)
on_log(
    "e10_over_wall_time", lambda g: governance.over_wall_time(metrics.first_settles(with_workflow(g)), _limits(g)).select("workflow", "step_id", "outcome", "seconds"),
    "select workflow, step_id, outcome, seconds from settled where seconds > substr(workflow, 1, 1)::int * 60", f"{HEADS}, {WF}, {SETTLED}",
)


def _costs(g):
    raised = g.where("event_type = 'approval.requested' and approval_kind = 'cost'").select("run_id", "approval_id", F.col("proposed_ceiling").alias("granted_ceiling"))
    rows = g.join(raised, ["run_id", "approval_id"], "left")
    counted = F.when(F.col("event_type").isin("step.completed", "step.dead_lettered"), F.col("cost"))
    return rows.select("run_id", "seq", counted.alias("cost"), F.when(F.col("event_type") == "approval.granted", F.col("granted_ceiling")).alias("granted_ceiling"), F.lit(40000).cast("decimal(18,4)").alias("max_run_cost"))


CROSSING = """select run_id, seq, total::double as total, ceiling::double as ceiling, (total + 40000)::double as proposed from (
      select run_id, seq, c, sum(c) over w as total, coalesce(last_value(gc ignore nulls) over w, 40000) as ceiling from (
        select l.run_id, l.seq, case when l.event_type in ('step.completed', 'step.dead_lettered') then l.cost end as c, case when l.event_type = 'approval.granted' then r.proposed_ceiling end as gc
        from log l left join log r on r.run_id = l.run_id and r.approval_id = l.approval_id and r.event_type = 'approval.requested' and r.approval_kind = 'cost')
      window w as (partition by run_id order by seq rows between unbounded preceding and current row)) where c is not null and total > ceiling qualify row_number() over (partition by run_id order by seq) = 1"""


def _crossing(g, **how):
    return governance.ceiling_crossing(_costs(g), **how).select("run_id", "seq", *[F.col(c).cast("double").alias(c) for c in ("total", "ceiling", "proposed")])


on_log("e11_ceiling_crossing", _crossing, CROSSING)
#: Blocks so short that most runs have several.
on_log("e11_ceiling_crossing_blocks", lambda g: _crossing(g, block=5), CROSSING, "", ["run_id", "seq", "event_type", "cost", "approval_id", "approval_kind", "proposed_ceiling"])


def _allow_agent(g):
    return g.where("event_type = 'run.started'").selectExpr("run_id", "conv(substr(run_id, 1, 1), 16, 10) % 2 = 0 as eff_allow_agent")


on_log(
    "e12_human_only", lambda g: governance.human_only_violations(fold.approvals(g), _allow_agent(g)).select("run_id", "approval_id", "kind", "effect_class", "decided_by"),
    "select run_id, approval_id, kind, effect_class, decided_by from approvals where approval_status = 'granted' and decided_by <> 'human' and (kind = 'cost' or effect_class in ('spend', 'write_external')) and ('0x' || substr(run_id, 1, 1))::int % 2 = 1", APPROVALS,
)
on_log(
    "e14_expired_approvals", lambda g: governance.expired(fold.approvals(_undecided(g)), fold.status(_undecided(g)), F.lit("1997-06-01").cast("timestamp_ntz")).select("run_id", "approval_id", "expires_at"),
    "select run_id, approval_id, expires_at from log l where event_type = 'approval.requested' and expires_at <= timestamp '1997-06-01' and seq < (select min(seq) from log s where s.run_id = l.run_id and s.event_type = 'run.suspended')",
)
on_log(
    "e15_gate_order", lambda g: governance.gate_order(fold.approvals(g), g),
    "select a.run_id, approval_id, a.step_id, start_seq, case when approval_status = 'granted' then decided_seq end as grant_seq, start_seq is null or coalesce(start_seq > case when approval_status = 'granted' then decided_seq end, false) as ok from approvals a left join (select run_id, step_id, min(seq) as start_seq from log where event_type = 'step.started' group by all) s on s.run_id = a.run_id and s.step_id = a.step_id", APPROVALS,
)


def _policies(g):
    return g.sparkSession.range(1).select(F.md5(F.lit("policy0")).alias("policy"), F.lit(True).alias("known"))


on_log(
    "e16_policy_attribution", lambda g: governance.policy_attribution(fold.policy_stamp(g), fold.header(g).select("run_id"), _policies(g)),
    "select case when policy is null then 'none' when policy <> md5('policy0') then 'unknown' else policy end as policy, count(*) as runs, coalesce(sum(narrowed), 0)::bigint as narrowings from (select run_id from log where event_type = 'run.started') left join (select run_id, policy, narrowed from log where event_type = 'governance.policy_applied') using (run_id) group by 1",
)


def _pauses(spark, sf_dir):
    """Scheduler rows from the events stream: errors pause, signups resume."""
    return table(spark, sf_dir, "events").where("event_type in ('error', 'signup')").selectExpr("ts as occurred_at", "event_id as place", "event_type = 'error' as paused", "user_id as by_user")


PAUSE_SQL = "pauses as (select ts, event_id, event_type = 'error' as paused, user_id as by_user from events where event_type in ('error', 'signup'))"


@query("e17_pause_state", f"with {PAUSE_SQL}, probes as (select event_id, ts from events where event_type = 'purchase') select event_id, paused, by_user from (select p.event_id, h.paused, h.by_user, row_number() over (partition by p.event_id order by h.ts desc, h.event_id desc) as r from probes p left join (select *, lead(ts) over (order by ts, event_id) as next_ts from pauses) h on h.ts <= p.ts and (h.next_ts is null or h.next_ts > p.ts)) where r = 1")
def _e17(spark, sf_dir):
    probes = table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr("event_id", "ts as occurred_at")
    return governance.as_of(probes, _pauses(spark, sf_dir), "occurred_at", ["paused", "by_user"]).select("event_id", "paused", "by_user")


@query("e18_started_while_paused", f"with {PAUSE_SQL}, probes as (select event_id, ts from events where event_type = 'click') select event_id from (select p.event_id, h.paused, row_number() over (partition by p.event_id order by h.ts desc, h.event_id desc) as r from probes p left join (select *, lead(ts) over (order by ts, event_id) as next_ts from pauses) h on h.ts <= p.ts and (h.next_ts is null or h.next_ts > p.ts)) where r = 1 and paused")
def _e18(spark, sf_dir):
    starts = table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("event_id", "ts as occurred_at")
    return governance.started_while_paused(starts, _pauses(spark, sf_dir)).select("event_id")


on_log("e20_retryable", lambda g: governance.retryable(fold.dead_lettered(g), fold.failed_steps(g)), "select distinct run_id, step_id from log a where (event_type = 'step.dead_lettered' or (event_type = 'step.failed' and terminal)) and not exists (select 1 from log b where b.run_id = a.run_id and b.step_id = a.step_id and b.seq > a.seq and b.event_type = 'step.retry_requested')")
on_log(
    "e21_rejection_audit", lambda g: governance.rejection_audit(fold.approvals(g), g),
    "select run_id, approval_id, kind, d as dead_lettered, f as run_failed, f and case when kind = 'effect' then d else not d end as ok from (select *, exists (select 1 from log l where l.run_id = a.run_id and l.seq > a.decided_seq and l.event_type = 'step.dead_lettered' and l.step_id = a.step_id) as d, exists (select 1 from log l where l.run_id = a.run_id and l.seq > a.decided_seq and l.event_type = 'run.failed') as f from approvals a where approval_status = 'rejected')", APPROVALS,
)
CONFIG = """concat('{"kind": "', case when p_size % 5 = 0 then 'subprocess' else 'http' end, '", "headers": {"a": "', case when p_size % 7 = 0 then concat('$', '{KEY}') else 'x' end, '"}, "env": {"b": "', case when p_size % 11 = 0 then concat('$', '{KEY}') else 'y' end, '"}, "allow_private_networks": ', case when p_size % 2 = 0 then 'true' else 'false' end, '}')"""


@query("e22_unsafe_definitions", "select p_partkey, case when p_size % 5 = 0 then 'subprocess' when p_size % 7 = 0 then 'environment reference in headers' when p_size % 11 = 0 then 'environment reference in env' when p_size % 2 = 0 then 'private networks' end as reason from part")
def _e22(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{CONFIG} as config").select("p_partkey", governance.unsafe_reason(F.col("config")).alias("reason"))


