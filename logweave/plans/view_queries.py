"""Queries of the index, the timeline and costs."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ..functions.storage import bucketed, shared_dir
from ..operators import cost, fold, index, timeline
from ..operators.index_table import IndexTable
from ..sources.run_log import derive, partitions, with_workflow
from .base import on_log, query
from .fold_queries import APPROVALS, APPROVED, STATUS_CTES
from .log_sql import over_log

RUNS = "run_rows2 as (select s.run_id, status, workflow, occurred_at as created_at from run_status s join (select run_id, workflow, occurred_at from log where event_type = 'run.started') using (run_id))"
CURSOR = (datetime.datetime(1996, 1, 1), "8")


def runs(log):
    return fold.summary(log).where("started_at is not null").select("run_id", "status", "workflow", F.col("started_at").alias("created_at"))


on_log(
    "c01_index_rows", lambda g: index.index_rows(g).withColumn("pending", F.array_join("pending", ",")),
    "select run_id, status, coalesce((select string_agg(approval_id, ',' order by approval_id) from approvals a where a.run_id = s.run_id and approval_status = 'pending'), '') as pending, last_seq as indexed_seq, last_at as updated_at from run_status s",
    f"{STATUS_CTES}, {APPROVALS}",
)
on_log(
    "c02_list_runs", lambda g: index.list_runs(runs(g), 50, ["running", "completed"], "1-URGENT"),
    "select * from run_rows2 where status in ('running', 'completed') and workflow = '1-URGENT' order by created_at desc, run_id desc limit 50", f"{STATUS_CTES}, {RUNS}",
)
on_log(
    "c03_keyset_page", lambda g: index.page(runs(g), 25, cursor=CURSOR),
    "select *, (select count(*) from (select 1 from run_rows2 where (created_at, run_id) < (timestamp '1996-01-01', '8') limit 26)) > 25 as more from (select *, row_number() over (order by created_at desc, run_id desc) as place from run_rows2 where (created_at, run_id) < (timestamp '1996-01-01', '8')) where place <= 25",
    f"{STATUS_CTES}, {RUNS}",
)
on_log(
    "c05_status_counts", lambda g: index.status_counts(fold.status(g)),
    "select status, count(*) as runs, list_position(['suspended', 'running', 'paused', 'pending', 'failed', 'cancelled', 'completed'], status)::bigint as place from run_status group by status", STATUS_CTES,
)


def _stale(log):
    """Index rows as of seq 12: right for short runs, behind for long ones."""
    return index.index_rows(log.where("seq <= 12"))


STALE = STATUS_CTES.replace("run_status", "stale_status").replace("grants", "stale_grants").replace("setter", "stale_setter").replace("from log g", "from (select * from log where seq <= 12) g").replace("from log group", "from log where seq <= 12 group")
on_log(
    "c06_list_rows", lambda g: index.list_rows(fold.status(g), _stale(g), fold.approvals(g), ["running", "failed"]),
    "select s.run_id, s.status, (select count(*) from approvals a where a.run_id = s.run_id and approval_status = 'pending') as n_pending from run_status s join stale_status t using (run_id) where t.status in ('running', 'failed') and s.status = t.status",
    f"{STATUS_CTES}, {STALE}, {APPROVALS}", APPROVED,
)
on_log(
    "c07_needs_advance", lambda g: index.needs_advance(runs(g), 100),
    "select * from run_rows2 where status in ('pending', 'running') order by created_at, run_id limit 100", f"{STATUS_CTES}, {RUNS}",
)


def _undecided(log):
    """Prefixes of the runs in which an approval is still open: up to a run's first suspension."""
    first = F.expr("min(case when event_type = 'run.suspended' then seq end) over (partition by run_id)")
    return log.withColumn("cut", first).where("seq <= cut").drop("cut")


@query(
    "c08_inbox",
    over_log(
        "select a.run_id, a.approval_id, a.step_id, a.effect_class, h.occurred_at as created_at from log a join (select run_id, min(seq) as cut from log where event_type = 'run.suspended' group by run_id) c using (run_id) join log h on h.run_id = a.run_id and h.event_type = 'run.started' where a.event_type = 'approval.requested' and a.seq <= cut"
    ),
)
def _c08(spark, sf_dir):
    """The open prefixes are written once, in buckets by run; what reads them meets by run."""
    g = bucketed(_undecided(derive(spark, sf_dir)).select(*APPROVED), partitions(spark, sf_dir))
    return index.inbox(fold.approvals(g), runs(g)).select("run_id", "approval_id", "step_id", "effect_class", "created_at")


on_log(
    "c09_index_drift", lambda g: index.drift(_stale(g), fold.status(g)),
    "select run_id, s.status, t.status as stored_status from run_status s left join stale_status t using (run_id) where s.status is distinct from t.status", f"{STATUS_CTES}, {STALE}",
)
on_log(
    "c10_index_behind", lambda g: index.behind(_stale(g), g),
    "select run_id, least(max(seq), 12)::bigint as indexed_seq, max(seq) as last_seq, max(seq) - least(max(seq), 12)::bigint as tail from log group by run_id having max(seq) > 12",
)


@query("c10_index_catch_up", over_log("select run_id, status, coalesce((select string_agg(approval_id, ',' order by approval_id) from approvals a where a.run_id = s.run_id and approval_status = 'pending'), '') as pending, last_seq as indexed_seq, last_at as updated_at from run_status s", f"{STATUS_CTES}, {APPROVALS}"))
def _caught_up(spark, sf_dir):
    """The log arrives in three batches (up to seq 4, up to 11, the rest); the index catches up after each."""
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    rows = derive(spark, sf_dir).select("run_id", "seq", "event_type", "occurred_at", "cost", "approval_id", F.expr("case when seq <= 4 then 1 when seq <= 11 then 2 else 3 end").alias("batch"))
    rows.write.partitionBy("batch").parquet(f"{folder}/log")
    log = spark.read.schema(rows.schema).parquet(f"{folder}/log")
    table = IndexTable(spark, f"{folder}/index").create()
    for batch in (1, 2, 3):
        table.advance(log, upto=batch)
    return table.rows().withColumn("pending", F.array_join("pending", ","))


on_log(
    "c11_text_filter", lambda g: fold.header(g).where(index.text_match("A") | index.text_match("urg")).select("run_id", "workflow"),
    "select run_id, workflow from log where event_type = 'run.started' and (starts_with(lower(run_id), 'a') or contains(lower(workflow), 'a') or starts_with(lower(run_id), 'urg') or contains(lower(workflow), 'urg'))",
)
on_log(
    "c13_event_page", lambda g: index.event_page(g, 3, 5).select("run_id", "seq", "event_type", "has_more", "page_last_seq"),
    "select run_id, seq, event_type, n > 8 as has_more, least(n, 8)::bigint as page_last_seq from (select *, max(seq) over (partition by run_id) as n from log) where seq between 4 and 8",
)
on_log(
    "c14_merge_pages", lambda g: index.merge_pages(g.where("seq <= 10").select("run_id", "seq", F.lit("held").alias("page"), "event_type"), g.where("seq between 6 and 14").select("run_id", "seq", F.lit("fresh").alias("page"), "event_type")),
    "select run_id, seq, case when seq >= 6 then 'fresh' else 'held' end as page, event_type from log where seq <= 14",
)
on_log(
    "c15_approval_context", lambda g: index.approval_context(fold.approvals(g), fold.completed_steps(g), fold.attempts(g)).withColumn("cost_so_far", F.col("cost_so_far").cast("double")),
    """select a.run_id, a.approval_id, a.step_id, kind, approval_status, coalesce(sum(l.cost), 0)::double as cost_so_far, count(l.cost) as steps_done,
    (select count(*) from log b where b.run_id = a.run_id and b.step_id = a.step_id and b.event_type = 'step.started') as starts
    from approvals a left join log l on l.run_id = a.run_id and l.event_type = 'step.completed' and l.seq < a.requested_seq group by a.run_id, a.approval_id, a.step_id, kind, approval_status""",
    APPROVALS,
)

# ---------------------------------------------------------------- timeline
on_log(
    "j01_salient", lambda g: g.select("run_id", "seq", timeline.salient().alias("detail")),
    """select run_id, seq, coalesce(case when event_type = 'step.started' then 'attempt ' || coalesce(attempt, 1) when event_type = 'step.completed' and cost <> 0 then 'cost ' || cost::varchar
    when event_type = 'step.progress' then (fraction * 100)::bigint || '%' when event_type in ('step.failed', 'step.dead_lettered', 'run.failed') then error when event_type = 'approval.requested' then effect_class
    when event_type in ('approval.granted', 'approval.rejected', 'run.cancel_requested', 'run.pause_requested', 'run.resumed', 'step.retry_requested') then 'by ' || principal_kind
    when event_type = 'governance.policy_applied' then 'policy ' || left(policy, 12) || case when narrowed > 0 then ', ' || narrowed || ' narrowing(s)' else '' end
    when event_type = 'executor.substituted' then from_model || ' → ' || model_id end, '') as detail from log""",
)
on_log("j02_event_gap", lambda g: timeline.with_gap(g).select("run_id", "seq", "gap_ms"), "select run_id, seq, date_diff('millisecond', lag(occurred_at) over (partition by run_id order by seq), occurred_at) as gap_ms from log")
on_log("j04_event_family", lambda g: g.groupBy(timeline.family().alias("family")).agg(F.count("*").alias("events")), "select split_part(event_type, '.', 1) as family, count(*) as events from log group by 1")
on_log("j05_step_timeline", lambda g: timeline.of_step(g, "s2").select("run_id", "seq", "event_type", "step_id"), "select run_id, seq, event_type, step_id from log where step_id is null or step_id = 's2'")
on_log(
    "j07_decided_approvals", lambda g: timeline.decided(fold.approvals(g)).select("run_id", "approval_id", "approval_status", "decided_at", "place"),
    "select run_id, approval_id, approval_status, decided_at, row_number() over (partition by run_id order by decided_at, decided_seq) as place from approvals where approval_status <> 'pending'", APPROVALS,
)

# ---------------------------------------------------------------- cost
PRICES = [(0, "Brand#1", 1.5, 6.0), (1, "Brand#1-mini", 0.15, 0.6), (2, "Brand#2", 3.0, 15.0), (3, "Brand#3-pro", 2.5, 10.0)]
PRICES_SQL = "prices(place, name, price_in, price_out) as (values " + ", ".join(f"({a}, '{b}', {c}::decimal(12,4), {d}::decimal(12,4))" for a, b, c, d in PRICES) + ")"
#: Model ids in the shape of families: Brand#2 becomes Brand#2-mini-2024, and so on by its digit.
MODEL = "case when substr(model_id, 7, 1) in ('1', '4') then concat(substr(model_id, 1, 7), '-mini-2024') when substr(model_id, 7, 1) = '5' then concat('Local-', model_id) else model_id end"
CHARGES_SQL = f"charges as (select run_id, step_id, seq, {MODEL} as model_id, tokens as tokens_in, tokens // 4 as tokens_out from log where event_type = 'step.completed')"
LOOKUP_SQL = """
ids as (select distinct model_id from charges),
matched as (select i.model_id, p.*, row_number() over (partition by i.model_id order by i.model_id <> p.name, p.place) as r from ids i join prices p on p.name = i.model_id or starts_with(i.model_id, p.name || '-')),
looked as (select i.model_id, m.name as matched, coalesce(m.price_in, case when starts_with(lower(i.model_id), 'local-') then 0 end) as price_in, coalesce(m.price_out, case when starts_with(lower(i.model_id), 'local-') then 0 end) as price_out,
  m.name is not null or starts_with(lower(i.model_id), 'local-') as priced from ids i left join matched m on m.model_id = i.model_id and r = 1)
"""


def charges(log):
    return log.where("event_type = 'step.completed'").selectExpr("run_id", "step_id", "seq", f"{MODEL} as model_id", "tokens as tokens_in", "tokens div 4 as tokens_out")


def prices(spark):
    return spark.createDataFrame(PRICES, "place int, name string, price_in double, price_out double").selectExpr("place", "name", "cast(price_in as decimal(12,4)) as price_in", "cast(price_out as decimal(12,4)) as price_out")


def _looked(g):
    return cost.price_lookup(charges(g), prices(g.sparkSession), ["local-"])


on_log(
    "g01_price_lookup", lambda g: _looked(g).withColumn("price_in", F.col("price_in").cast("double")).withColumn("price_out", F.col("price_out").cast("double")),
    "select model_id, matched, price_in::double as price_in, price_out::double as price_out, priced from looked", f"{PRICES_SQL}, {CHARGES_SQL}, {LOOKUP_SQL}",
)


def _charged(g):
    rows = charges(g).join(_looked(g), "model_id")
    return rows.withColumn("amount", cost.amount(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))


on_log(
    "g02_charge_amount", lambda g: _charged(g).select("run_id", "step_id", cost.amount_text(F.col("amount")).alias("amount"), "priced"),
    "select run_id, step_id, case when a = 0 then '0' else regexp_replace(regexp_replace(a::varchar, '0+$', ''), '[.]$', '') end as amount, priced from (select run_id, step_id, coalesce(round((tokens_in::decimal(18,0) * price_in + tokens_out::decimal(18,0) * price_out)::decimal(30,4) * 0.000001::decimal(8,6), 6), 0)::decimal(24,6) as a, priced from charges join looked using (model_id))",
    f"{PRICES_SQL}, {CHARGES_SQL}, {LOOKUP_SQL}",
)


def _meters(g):
    started = with_workflow(g)
    agents = g.where("event_type = 'step.started'").groupBy("run_id", "step_id").agg(F.max("agent").alias("agent"))
    done = started.where("event_type = 'step.completed'").select("run_id", "step_id", "workflow", "tokens").join(agents, ["run_id", "step_id"])
    units = F.array(F.struct(F.lit("input_tokens").alias("name"), F.col("tokens").alias("quantity")), F.struct(F.lit("requests").alias("name"), F.lit(1).cast("bigint").alias("quantity")))
    return cost.meter_rollup(done.withColumn("units", units))


DONE_SQL = "heads as (select run_id, workflow from log where event_type = 'run.started'), agents as (select run_id, step_id, max(agent) as agent from log where event_type = 'step.started' group by all), done as (select l.run_id, l.step_id, h.workflow, a.agent, l.tokens, l.cost from log l join heads h using (run_id) join agents a on a.run_id = l.run_id and a.step_id = l.step_id where event_type = 'step.completed')"
on_log(
    "g03_meter_rollup", _meters,
    "select workflow, agent, meter, sum(q)::bigint as quantity from (select workflow, agent, 'input_tokens' as meter, tokens as q from done union all select workflow, agent, 'requests', 1 from done) group by all", DONE_SQL,
)
on_log(
    "g04_cost_by_workflow", lambda g: with_workflow(g).where("event_type = 'step.completed'").groupBy("workflow", F.lit("USD").alias("currency")).agg(F.sum("cost").cast("double").alias("cost")),
    "select workflow, 'USD' as currency, sum(cost)::double as cost from done group by workflow", DONE_SQL,
)
on_log(
    "g05_node_latency", lambda g: cost.node_latency(g).withColumn("cost", F.col("cost").cast("double")),
    "select run_id, step_id, count(*) filter (event_type = 'step.started') as attempts, min(occurred_at) filter (event_type = 'step.started') as started_at, min(occurred_at) filter (event_type = 'step.completed') as finished_at, max(cost)::double as cost, date_diff('millisecond', min(occurred_at) filter (event_type = 'step.started'), min(occurred_at) filter (event_type = 'step.completed')) as duration_ms from log where event_type in ('step.started', 'step.completed') group by run_id, step_id",
)


@query(
    "g06_reprice",
    over_log("select run_id, step_id, charged::double as charged, coalesce(round((tokens_in::decimal(18,0) * price_in + tokens_out::decimal(18,0) * price_out)::decimal(30,4) * 0.000001::decimal(8,6), 6))::double as recomputed from (select c.*, (tokens_in / 1000)::decimal(24,6) as charged from charges c) join looked l using (model_id)", f"{PRICES_SQL}, {CHARGES_SQL}, {LOOKUP_SQL}"),
)
def _repriced(spark, sf_dir):
    g = derive(spark, sf_dir)
    rows = charges(g).withColumn("charged", (F.col("tokens_in") / 1000).cast("decimal(24,6)")).withColumn("snapshot_hash", F.lit("p1"))
    snapshots = _looked(g).select(F.lit("p1").alias("snapshot_hash"), "model_id", "price_in", "price_out")
    return cost.reprice(rows, snapshots).select("run_id", "step_id", F.col("charged").cast("double").alias("charged"), F.col("recomputed").cast("double").alias("recomputed"))
