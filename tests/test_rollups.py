"""Subtree totals, waves, zones with changing clocks and merged sketches, against loops."""

import datetime
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from logweave.operators import dag, schedule, sketches

UTC = datetime.timezone.utc


def brute_totals(parents, values):
    out = {}
    for r in parents:
        at, seen = r, 0
        while at is not None and at in parents:
            n, v = out.get(at, (0, 0))
            out[at] = (n + 1, v + (values[r] or 0))
            at, seen = parents[at], seen + 1
    return out


def test_subtree_totals_of_forests(spark):
    r = random.Random(2)
    names = [f"r{i}" for i in range(400)]
    parents = {n: r.choice(names[: max(1, i)] + ["elsewhere"]) if i else None for i, n in enumerate(names)}
    parents |= {f"leaf{i}": "r3" for i in range(300)}  # one parent of a third
    values = {n: r.choice([None, 1, 5, -2]) for n in parents}
    df = spark.createDataFrame([(n, p, values[n]) for n, p in parents.items()], "run_id string, parent_run_id string, v bigint").repartition(5)
    got = {x["run_id"]: (x["n_runs"], x["v"] or 0) for x in dag.subtree_totals(df, ["v"]).collect()}
    assert got == brute_totals(parents, values)
    assert dag.subtree_totals(df.limit(0), ["v"]).count() == 0


def test_subtree_totals_of_a_chain_of_ten_thousand(spark):
    n = 10_000
    df = spark.range(n).selectExpr("concat('r', id) as run_id", "if(id > 0, concat('r', id - 1), null) as parent_run_id", "id as v", "cast(1.5 as decimal(18,4)) as cost")
    out = dag.subtree_totals(df, ["v", "cost"]).withColumn("id", F.substring("run_id", 2, 9).cast("bigint"))
    assert out.count() == n and out.where(f"n_runs <> {n} - id or v <> ({n} - id) * ({n} - 1 + id) / 2 or cost <> 1.5 * ({n} - id)").count() == 0


@pytest.mark.parametrize("rows", [[("a", "a")], [("a", "b"), ("b", "a"), ("c", "a"), ("d", None)]])
def test_subtree_totals_refuse_cycles(spark, rows):
    with pytest.raises(ValueError, match="its own ancestor"):
        dag.subtree_totals(spark.createDataFrame([(*x, 1) for x in rows], "run_id string, parent_run_id string, v bigint"), ["v"])


def test_waves_equal_a_sweep(spark):
    r = random.Random(7)
    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for run in range(30):
        for k in range(r.randint(1, 12)):
            start = t0 + datetime.timedelta(minutes=r.randint(0, 60))
            rows.append((f"r{run}", f"s{k}", 1, start, r.choice([None if k == 11 else start, start + datetime.timedelta(minutes=r.randint(1, 12))])))
    df = spark.createDataFrame(rows, "run_id string, step_id string, attempt bigint, started_at timestamp_ntz, ended_at timestamp_ntz")
    got = {(x["run_id"], x["step_id"]): x["wave"] for x in dag.observed_waves(df).collect()}
    want = {}
    for run in {x[0] for x in rows}:
        wave, until = 0, None
        for _, step, _, start, end in sorted((x for x in rows if x[0] == run), key=lambda x: (x[3], x[1])):
            if until is None or until <= start:
                wave += 1
            until = max(until or start, end or datetime.datetime.max)
            want[run, step] = wave
    assert got == want
    peaks = {x["run_id"]: x["peak"] for x in dag.parallelism(df.where("ended_at is not null")).collect()}
    over = dag.over_parallelism(df.where("ended_at is not null"), df.select("run_id", F.when(F.col("run_id") != "r1", 2).cast("bigint").alias("max_parallelism")).distinct()).collect()
    assert {x["run_id"] for x in over} == {k for k, p in peaks.items() if p > 2 and k != "r1"}


def loop_next(minutes, hours, after, zone):
    """Minute by minute along the zone's wall clock; the first of a doubled time, a skipped one as before the change."""
    wall = after.astimezone(ZoneInfo(zone)).replace(tzinfo=None, second=0, microsecond=0)
    for _ in range(60 * 24 * 3):
        wall += datetime.timedelta(minutes=1)
        if wall.hour in hours and wall.minute in minutes:
            there = wall.replace(tzinfo=ZoneInfo(zone), fold=0)
            return wall, there.astimezone(UTC).replace(tzinfo=None), f"cron:x:{there.isoformat(timespec='seconds')}"


@pytest.mark.parametrize("zone,changes", [("Europe/Berlin", ["2024-03-31 01:00", "2024-10-27 01:00"]), ("America/New_York", ["2024-03-10 07:00", "2024-11-03 06:00"]), ("Australia/Lord_Howe", ["2024-04-06 15:00", "2024-10-05 15:30"]), ("Asia/Kolkata", ["2024-05-01 00:00"])])
def test_next_fire_around_changes_of_clocks(spark, zone, changes):
    specs = ["0,30 * * * *", "10,50 1-3 * * *", "*/7 0-4 * * *", "15 2 * * *"]
    fields = [({0, 30}, range(24)), ({10, 50}, range(1, 4)), (set(range(0, 60, 7)), range(5)), ({15}, {2})]
    parsed = schedule.parse(spark.createDataFrame([("x", e, i, zone) for i, e in enumerate(specs)], "name string, expr string, i int, zone string"))
    for change in changes:
        for offset in (-130, -61, -31, -15, -1, 0, 1, 29, 31, 45, 61, 119, 121):
            after = datetime.datetime.fromisoformat(change).replace(tzinfo=UTC) + datetime.timedelta(minutes=offset, seconds=20)
            stamp = F.lit(after.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
            if offset in (-61, 1, 45):
                for i, (minutes, hours) in enumerate(fields):
                    x = schedule.next_fire_zones(parsed.where(F.col("i") == i), stamp, days=4).first()
                    assert (x["slot"], x["next_utc"], x["key"]) == loop_next(minutes, hours, after, zone), (change, offset, specs[i])


def test_merged_sketches(spark):
    """Merged by group they answer as sketches of the whole group do, within their bounds."""
    rows = spark.range(200_000).selectExpr("concat('g', id % 3) as g", "id % 60000 as run", "cast(id % 1000 as double) as seconds", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 40 as int)) as occurred_at", "if(id % 2 = 0, null, id % 7) as agent")
    table = sketches.daily(rows, ["g"], ["run", "agent"], ["seconds"])
    assert table.count() == 3 * 40
    for keys in (["g"], []):
        out = sketches.merged(table, *keys)
        x = out.select(*keys, "n", sketches.distinct_count("hll_run").alias("runs"), sketches.distinct_count("hll_agent").alias("agents"), *[sketches.quantile("kll_seconds", q).alias(f"q{int(100 * q)}") for q in (0.5, 0.95)]).orderBy("n", *keys).collect()
        exact = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"), F.count_distinct("agent").alias("agents")).orderBy("n", *keys).collect()
        direct = rows.groupBy(*keys).agg(F.approx_count_distinct("run").alias("r")).count()
        assert len(x) == len(exact) == direct
        for a, b in zip(x, exact, strict=True):
            assert a["n"] == b["n"] and a["agents"] == b["agents"] and abs(a["runs"] / b["runs"] - 1) < 0.05
            assert abs(a["q50"] - 500) < 30 and abs(a["q95"] - 950) < 30
    months = sketches.merged(table, F.date_trunc("month", "day").alias("month"))
    assert months.count() == 2 and sketches.merged(table.limit(0), "g").count() == 0
    only_null = sketches.daily(rows.where("agent is null").withColumn("seconds", F.lit(None).cast("double")), ["g"], ["agent"], ["seconds"])
    x = sketches.merged(only_null).select(sketches.distinct_count("hll_agent").alias("a"), sketches.quantile("kll_seconds", 0.5).alias("q")).first()
    assert (x["a"], x["q"]) == (0, None)


def test_details_of_seals_and_of_nulls(spark):
    from logweave.operators import timeline

    log = spark.createDataFrame(
        [("integrity.sealed", 7, "k1", None, 0.0), ("run.failed", None, None, "broke", None), ("run.failed", None, None, None, None), ("other", 1, "k", "e", 0.5), ("step.progress", None, None, None, 0.5)],
        "event_type string, sealed_seq bigint, key_id string, error string, fraction double",
    )
    some = {k: v for k, v in timeline.DETAILS.items() if k in ("run.failed", "step.progress")} | timeline.SEAL_DETAILS
    assert [r[0] for r in log.select(timeline.salient(some)).collect()] == ["seals seq 7 (key k1)", "broke", "", "", "50%"]


def test_approval_context_counts_what_came_before(spark):
    from logweave.operators import index

    done = spark.createDataFrame([("r", 3, 2.0), ("r", 5, 4.0), ("r", 9, None), ("q", 1, 1.0)], "run_id string, seq bigint, cost double")
    asked = spark.createDataFrame([("r", "a", "s1", 5, "effect", "pending"), ("r", "b", "s2", 10, "cost", "granted"), ("p", "c", "s1", 1, "effect", "pending")], "run_id string, approval_id string, step_id string, requested_seq bigint, kind string, approval_status string")
    tries = spark.createDataFrame([("r", "s1", 2)], "run_id string, step_id string, starts bigint")
    got = {r.approval_id: (float(r.cost_so_far), r.steps_done, r.starts) for r in index.approval_context(asked, done, tries).collect()}
    assert got == {"a": (2.0, 1, 2), "b": (6.0, 2, 0), "c": (0.0, 0, 0)}
