"""Streams with state: what they give whatever the order of arrival, and that their state goes."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import random_run, sequential

from logweave.operators.fold import TERMINAL
from logweave.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)
EVENTS = "mix bigint, run_id string, seq bigint, event_type string, occurred_at timestamp_ntz"


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def left_over(stream, tmp_path, names):
    """Run a stream to its end; (rows of its output, number of entries that each state variable still holds)."""
    spark = stream.sparkSession
    got = []
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("update" if "last_seq" in stream.columns and "status" in stream.columns else "append")
    query = query.foreachBatch(lambda df, i: got.extend((i, r) for r in df.collect())).start()
    query.awaitTermination()
    return got, {n: spark.read.format("statestore").option("stateVarName", n).load(str(tmp_path / "state")).count() for n in names}


def test_files_of_a_stream_come_in_order(spark):
    rows = spark.range(50).selectExpr("49 - id as place", "id")
    got = []
    jobs.as_stream(rows, 5).writeStream.trigger(availableNow=True).foreachBatch(lambda df, i: got.append([r["place"] for r in df.collect()])).start().awaitTermination()
    got = [sorted(x) for x in got if x]
    assert sum(got, []) == list(range(50)) and len(got) == 5


RUNS = [(0, "a", 1, "run.started", at(0)), (0, "a", 3, "run.completed", at(2)), (0, "b", 1, "run.started", at(0)), (1, "a", 2, "step.started", at(1)), (1, "b", 2, "run.failed", at(3)), (2, "a", 4, "step.retry_requested", at(4)), (3, "c", 1, "run.started", at(900)), (4, "c", 2, "run.completed", at(2000)), (5, "d", 1, "run.started", at(9000))]


def test_states_of_ended_runs_go(spark, tmp_path):
    """Two ended runs and a late event of one of them: before its tombstone goes it is dropped; then the state is empty but for a run that has just begun."""
    log = spark.createDataFrame(RUNS, EVENTS)
    got, left = left_over(jobs.until_terminal(jobs.as_stream(log, 6), "occurred_at", "10 hours", 3600_000), tmp_path, ["run", "early"])
    assert sorted((x["run_id"], x["seq"]) for _, x in got) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("d", 1)]
    assert left == {"run": 1, "early": 0}


def test_live_states_go(spark, tmp_path):
    log = spark.createDataFrame(RUNS, EVENTS)
    got, left = left_over(jobs.live_state(jobs.as_stream(log, 6), "occurred_at", "10 hours", 3600_000), tmp_path, ["run", "early"])
    last = {x["run_id"]: (x["status"], x["last_seq"]) for _, x in sorted(got, key=lambda x: x[0])}
    assert last == {"a": ("running", 4), "b": ("failed", 2), "c": ("completed", 2), "d": ("running", 1)}
    assert left == {"run": 2, "early": 0}  # a was reopened, d has just begun


@pytest.mark.parametrize("seed", [1, 2])
def test_live_state_in_any_order(spark, seed):
    """Events backwards, at random and repeated: the last state of each run is the fold of its events."""
    r = random.Random(seed)
    runs = {f"r{i}": [e if isinstance(e, str) else e["event_type"] for e in random_run(r)] for i in range(25)}
    rows = [(r.randint(0, 9) if run != "r0" else 99 - k, run, k, e, at(0)) for run, es in runs.items() for k, e in enumerate(es, 1)]
    rows += [x for x in rows if r.random() < 0.2]
    out = jobs.drain(jobs.live_state(jobs.as_stream(spark.createDataFrame(rows, EVENTS), 4)), "update")
    last = out.groupBy("run_id").agg(F.max_by(F.struct("status", "last_seq"), "batch_id").alias("s")).collect()
    plain = {run: [{"event_type": e, "approval_id": "x", "step_id": "s", "attempt": 1, "terminal": False, "error": "", "retry_at": None} for e in es] for run, es in runs.items()}
    for x in last:
        assert x["s"]["last_seq"] == len(runs[x["run_id"]])
        if sum(e == "approval.requested" for e in runs[x["run_id"]]) <= 1:
            assert x["s"]["status"] == sequential(plain[x["run_id"]])[0]
    assert len(last) == len(runs)


@pytest.mark.parametrize("buckets", [1, 3])
def test_runs_of_a_bucket_share_its_state(spark, tmp_path, buckets):
    """One call takes all runs of a bucket; states and tombstones are still kept and dropped run by run."""
    log = spark.createDataFrame(RUNS, EVENTS)
    got, left = left_over(jobs.live_state(jobs.as_stream(log, 6), "occurred_at", "10 hours", 3600_000, buckets=buckets), tmp_path, ["run", "early"])
    last = {x["run_id"]: (x["status"], x["last_seq"]) for _, x in sorted(got, key=lambda x: x[0])}
    assert last == {"a": ("running", 4), "b": ("failed", 2), "c": ("completed", 2), "d": ("running", 1)}
    assert left == {"run": 2, "early": 0}


def test_a_run_that_arrives_backwards(spark, tmp_path):
    n = 300
    rows = [(n - k, "a", k, "run.started" if k == 1 else "run.completed" if k == n else "step.progress", at(0)) for k in range(1, n + 1)]
    got, left = left_over(jobs.until_terminal(jobs.as_stream(spark.createDataFrame(rows, EVENTS), 4)), tmp_path, ["run", "early"])
    assert [x["seq"] for _, x in got] == list(range(1, n + 1)) and left == {"run": 1, "early": 0}


def test_expiries_and_their_state(spark, tmp_path):
    """Undecided approvals expire once; decided ones do not, whichever of request and decision comes first; nothing is left."""
    ask, yes = "approval.requested", "approval.granted"
    rows = [(0, "open", ask, at(0), at(5)), (0, "done", ask, at(0), at(5)), (1, "done", yes, at(4), None), (1, "early", yes, at(3), None), (2, "early", ask, at(1), at(6)), (0, "none", ask, at(0), None), (0, "again", ask, at(0), at(4)), (1, "again", ask, at(1), at(40)), (4, "end", yes, at(500), None), (5, "end2", yes, at(5000), None), (6, "end3", yes, at(50_000), None)]
    df = spark.createDataFrame(rows, "mix bigint, approval_id string, event_type string, occurred_at timestamp, expires_at timestamp")
    stream = jobs.as_stream(df, 7).withWatermark("occurred_at", "2 hours")
    got, left = left_over(jobs.expire(stream, 3600_000), tmp_path, ["approval"])
    assert sorted((x["approval_id"], x["expired_at"]) for _, x in got) == [("again", at(40)), ("open", at(5))]
    assert left == {"approval": 1}  # the last row, which nothing follows


def brute_stalled(rows, ttl):
    out = []
    by = {}
    for _, run, step, attempt, seq, kind, when in rows:
        by.setdefault((run, step, attempt), []).append((when, seq, kind))
    for key, events in by.items():
        events.sort()
        over = False
        for i, (when, seq, kind) in enumerate(events):
            over = over or kind in jobs.SETTLED
            if not over and (i + 1 == len(events) or events[i + 1][0] > when + ttl):
                out.append((*key, seq, when + ttl))
    return sorted(out)


def test_stalled_attempts(spark, tmp_path):
    """Attempts in any order of arrival within the delay: a settlement that arrives late but happened in time counts, attempts do not share a lease, and nothing is left."""
    r = random.Random(4)
    rows = []
    for a in range(60):
        when = at(r.uniform(0, 3)).replace(microsecond=0)
        kinds = ["step.started", *["step.progress"] * r.randint(0, 4), *r.choice([[], ["step.completed"], ["step.failed", "step.dead_lettered"]])]
        for seq, kind in enumerate(kinds, 1):
            rows.append((r.randint(0, 3), f"r{a % 7}", f"s{a % 5}", a, seq, kind, when))
            when += datetime.timedelta(seconds=r.choice([5, 50, 60, 61, 200]))
    ends = [(4 + i, "end", "end", 0, i, "step.completed", at(1000 * (i + 1))) for i in range(3)]
    df = spark.createDataFrame(rows + ends, "mix bigint, run_id string, step_id string, attempt bigint, seq bigint, event_type string, occurred_at timestamp_ntz")
    got, left = left_over(jobs.stalled(jobs.as_stream(df, 7), "occurred_at", "10 hours", 60), tmp_path, ["attempt", "events"])
    assert sorted(tuple(x) for _, x in got) == brute_stalled(rows, datetime.timedelta(seconds=60)) and len(got) > 20
    assert left == {"attempt": 1, "events": 1}  # the last row, which nothing follows


def test_undecided_requests_come_out(spark):
    asked = [(0, "in time", at(0)), (0, "late", at(0)), (0, "never", at(1)), (1, "end", at(9000))]
    done = [(0, "in time", at(0.5)), (0, "late", at(3)), (1, "end", at(9000))]
    left = jobs.as_stream(spark.createDataFrame(asked, "place bigint, approval_id string, requested_at timestamp"), 2)
    right = jobs.as_stream(spark.createDataFrame(done, "place bigint, approval_id string, decided_at timestamp"), 2)
    out = jobs.drain(jobs.decision_join(left.drop("place"), right.drop("place"), "10 hours", "1 hour")).where("approval_id <> 'end'").collect()
    assert sorted((x["approval_id"], x["wait_seconds"]) for x in out) == [("in time", 1800), ("late", None), ("never", None)]
    assert not pd.isna(T0) and TERMINAL
