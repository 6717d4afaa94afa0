"""Two-level scans and the kept index against plain windows and loops, with very long runs, gaps and repeated work."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, TYPES, make_log, random_run, sequential  # noqa: F401

from logweave.operators import fold, governance, index, integrity
from logweave.operators.index_table import IndexTable
from logweave.operators.scan import running


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_values_equal_windows(spark, block):
    r = random.Random(block)
    rows = [(f"k{r.randint(0, 4)}", i, r.choice([None, r.randint(-9, 9)]), r.choice([None, "a", "b", "c"])) for i in range(400)]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, n bigint, name string")
    got = running(df, {"s": ("sum", F.col("n")), "m": ("max", F.col("n")), "l": ("last", F.col("name")), "b": ("before", F.col("name"))}, block)
    w, before = "over (partition by run_id order by seq rows between unbounded preceding and {})", "over (partition by run_id order by seq rows between unbounded preceding and 1 preceding)"
    now = w.format("current row")
    want = df.selectExpr("*", f"sum(n) {now} as s", f"max(n) {now} as m", f"last(name, true) {now} as l", f"last(name, true) {before} as b")
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert running(df.limit(0), {"s": ("sum", F.col("n"))}).count() == 0


def test_state_by_blocks_equals_a_loop(spark):
    r = random.Random(11)
    runs = {f"r{i}": random_run(r) for i in range(60)}
    log = make_log(spark, runs)
    for block in (2, 5):
        got = {(x["run_id"], x["seq"]): x["status"] for x in fold.state_everywhere_blocks(log, block=block).collect()}
        assert got == {(k, n): sequential(e[:n])[0] for k, e in runs.items() for n in range(1, len(e) + 1)}


def test_one_run_of_a_million_events(spark, tmp_path):
    """Blocks of the run are spread over tasks, and the results are those of a formula."""
    n = 1_000_000
    kinds = "case seq % 10 when 1 then 'approval.requested' when 2 then 'run.suspended' when 5 then 'approval.granted' when 7 then 'step.completed' else 'step.progress' end"
    rows = spark.range(1, n + 1).selectExpr("'hot' as run_id", "id as seq").selectExpr("*", f"if(seq = 1000000, 'run.completed', {kinds}) as event_type", "cast(1.5 as decimal(18,4)) as cost", "md5(cast(seq as string)) as hash", "if(seq = 777777, 'x', md5(cast(seq - 1 as string))) as prev_hash")
    rows.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    out = fold.state_everywhere_blocks(log, block=20_000)
    got = out.selectExpr("seq", "status", "total_cost", "case when seq = 1000000 then 'completed' when seq = 1 then 'pending' when seq % 10 between 2 and 4 then 'suspended' else 'running' end as expected").withColumn("part", F.spark_partition_id())
    assert got.where("status <> expected and seq > 1").count() == 0 and got.where("seq >= 7 and total_cost <> 1.5 * floor((seq + 3) / 10)").count() == 0
    assert got.count() == n and got.select("part").distinct().count() > 1
    bad = integrity.link_reasons(log, F.lit(True), block=20_000).where("reason is not null").select("seq", "reason").collect()
    assert [tuple(x) for x in bad] == [(1, "prev_hash does not match"), (777777, "prev_hash does not match")]
    costs = log.selectExpr("run_id", "seq", "case when event_type = 'step.completed' then cost end as cost", "cast(if(seq = 500000, 100000, null) as decimal(18,4)) as granted_ceiling", "cast(60000 as decimal(18,4)) as max_run_cost")
    first = governance.ceiling_crossing(costs, block=20_000).first()
    assert first["seq"] == 399_997 + 10 and first["total"] == 60_001.5


COLUMNS = "batch int, " + SCHEMA


def batched(spark, runs, deal):
    """The runs' log with the batch that each event comes in."""
    return make_log(spark, runs).withColumn("batch", deal)


def plain(df):
    return sorted((r["run_id"], r["status"], tuple(r["pending"]), r["indexed_seq"], r["updated_at"]) for r in df.collect())


@pytest.mark.parametrize("compact_after", [1, 2, 8])
def test_index_after_increments_equals_one_from_scratch(spark, tmp_path, compact_after):
    r = random.Random(21)
    runs = {f"r{i}": random_run(r) for i in range(80)}
    rows = batched(spark, runs, F.expr("cast(case when seq <= 2 then 1 when seq <= 5 then 2 when seq <= 9 then 3 else 5 end as int)"))
    rows.write.partitionBy("batch").parquet(str(tmp_path / "log"))
    log = spark.read.schema(rows.schema).parquet(str(tmp_path / "log"))
    table = IndexTable(spark, str(tmp_path / "index"), compact_after).create().create()
    assert table.rows().count() == 0
    for batch, most in ((1, 2), (2, 5), (3, 9), (4, 9), (5, 99)):
        version = table.advance(log, upto=batch)
        assert plain(table.rows()) == plain(index.index_rows(log.where(F.col("seq") <= most)))
        assert table.advance(log, upto=batch) == version  # nothing new changes nothing
    assert len(table.version()["parts"]) <= compact_after
    cost = {x["run_id"]: (x["total_cost"], x["n_completed"]) for x in fold.total_cost(log).collect()}
    assert {x["run_id"]: (x["total_cost"], x["n_completed"]) for x in table.states().collect()} == cost


def test_index_reads_the_tail_only(spark, tmp_path, capsys):
    rows = batched(spark, {"a": ["run.started"] * 6}, F.expr("cast(seq as int)"))
    rows.write.partitionBy("batch").parquet(str(tmp_path / "log"))
    log = spark.read.schema(rows.schema).parquet(str(tmp_path / "log"))
    IndexTable(spark, str(tmp_path / "index")).create().advance(log, upto=4)
    tail = log.where(F.col("batch") > 4)
    tail.explain("formatted")
    assert "PartitionFilters: [isnotnull(batch" in capsys.readouterr().out and tail.inputFiles() and all("batch=" in f for f in tail.inputFiles())
    assert not [f for f in tail.inputFiles() if "batch=1/" in f] or tail.count() == 2


def test_index_waits_before_gaps_and_survives_a_lost_writer(spark, tmp_path):
    """Seq 3 comes late, seq 5 comes twice, and a catch-up dies before its version is written."""
    runs = {"a": ["run.started", "step.started", "run.suspended", "step.progress", "run.completed"], "b": ["run.started", "run.paused"]}
    rows = batched(spark, runs, F.expr("cast(case when run_id = 'b' then seq when seq = 3 then 4 when seq = 5 then 3 else seq end as int)"))
    rows = rows.unionByName(rows.where("run_id = 'a' and seq = 5").withColumn("batch", F.lit(5)))
    rows.write.partitionBy("batch").parquet(str(tmp_path / "log"))
    log = spark.read.schema(rows.schema).parquet(str(tmp_path / "log"))
    table = IndexTable(spark, str(tmp_path / "index")).create()
    table.advance(log, upto=2)
    table.advance(log, upto=3)
    assert [(x[0], x[1], x[3]) for x in plain(table.rows())] == [("a", "running", 2), ("b", "paused", 2)] and table.version()["through"] == 2
    # a part that no version names is not read
    spark.createDataFrame([("a", 99 * 64 + 5, None, 0, [], None, 0, 99, None)], table.states().schema).write.parquet(str(tmp_path / "index" / "states" / "9-lost"))
    table.advance(log)
    assert plain(table.rows()) == plain(index.index_rows(make_log(spark, runs))) and table.version()["through"] == 5
    newest = table.version()
    spark.createDataFrame([(newest["version"], "other", newest["parts"], 5)], "version bigint, writer string, parts array<string>, through bigint").write.mode("append").parquet(str(tmp_path / "index" / "versions"))
    with pytest.raises(RuntimeError, match="two writers"):
        table.version()


def test_blocks_meet_no_join_by_event(spark):
    """The log of state_everywhere_blocks is dealt once, by block: no join by run and seq deals it before."""
    import re

    from logweave.operators import fold

    kinds = ["run.started", "approval.requested", "run.suspended", "approval.granted", "step.completed", "approval.requested", "run.suspended", "approval.requested", "approval.granted", "approval.granted"]
    rows = [("a", i, kind, i / 4) for i, kind in enumerate(kinds, 1)]
    log = spark.createDataFrame(rows, "run_id string, seq bigint, event_type string, cost double").withColumn("cost", F.col("cost").cast("decimal(18,4)"))
    for block in (1, 2, 3, 100):
        out = fold.state_everywhere_blocks(log, block=block)
        assert not re.search(r"Join \[run_id#\d+, seq#\d+", out._jdf.queryExecution().executedPlan().toString())
        got = [(x["seq"], x["status"], float(x["total_cost"])) for x in out.orderBy("seq").collect()]
        states = ["running", "running", "suspended", "running", "running", "running", "suspended", "suspended", "suspended", "running"]
        assert got == [(i, s, 1.25 if i >= 5 else 0.0) for i, s in enumerate(states, 1)]
