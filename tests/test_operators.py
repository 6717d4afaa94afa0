"""Sequential second oracles, properties and hand-made logs."""

import datetime
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions import cron
from logweave.operators import dag, fold, governance, index, integrity, schedule, textjobs
from logweave.sources import ingest
from logweave.sources.run_log import COLUMNS, HEADER_COLUMNS, RUN_EVENTS, STEP_COLUMNS, STEP_EVENTS

T0 = datetime.datetime(2024, 1, 1)
#: Of two events and a seal, as sha256sum and openssl give them.
HASHES = ["b11c3d355cdd0608aebede92e2ad9bb2e0419bab703fe79c4bdd685e89d08b83", "087869715aa04f0fc834458539aca111d99bead4ede70b88e62065f01b778153", "c66188a0e9415f9ca1a976cc36fc866a9c92b05fb7334ca222eaa089adfd1f80"]
SIGNATURE = "8d99b5c68e3e48697dff118ec13103415135c3c71b021be2a16a3311eb7542c2"
TYPES = {"run_id": "string", "seq": "bigint", "event_type": "string", "occurred_at": "timestamp_ntz"} | {n: t for n, t, _ in HEADER_COLUMNS + STEP_COLUMNS}
SCHEMA = ", ".join(f"{c} {TYPES[c]}" for c in COLUMNS)


def make_log(spark, runs):
    rows = []
    for run_id, events in runs.items():
        for i, e in enumerate(events, 1):
            e = {"event_type": e} if isinstance(e, str) else e
            rows.append(tuple({"run_id": run_id, "seq": i, "occurred_at": T0 + datetime.timedelta(minutes=i), **e}.get(c) for c in COLUMNS))
    return spark.createDataFrame(rows, SCHEMA)


def random_run(r):
    """A random but legal log: approvals may overlap and be asked for again."""
    events, open_ids, n = ["run.started"], [], 0
    for _ in range(r.randint(1, 14)):
        kind = r.choice(["step", "ask", "suspend", "decide", "pause", "resume", "fail", "retry", "cancel", "complete"])
        step = f"s{r.randint(1, 3)}"
        if kind == "ask":
            n += 1
            open_ids.append(f"a{n}")
            events.append({"event_type": "approval.requested", "approval_id": f"a{n}", "step_id": step, "approval_kind": "effect"})
        elif kind == "decide" and open_ids:
            a = open_ids.pop(r.randrange(len(open_ids)))
            events.append({"event_type": r.choice(["approval.granted", "approval.rejected"]), "approval_id": a, "step_id": step, "principal_kind": "human"})
        elif kind == "fail":
            events.append({"event_type": "step.failed", "step_id": step, "attempt": 1, "terminal": r.random() < 0.5, "error": "e", "retry_at": T0})
        elif kind == "retry":
            events.append({"event_type": "step.retry_requested", "step_id": step})
        elif kind == "step":
            events.append({"event_type": "step.started", "step_id": step, "attempt": r.randint(1, 3), "agent": "a"})
        else:
            name = {"suspend": "run.suspended", "pause": "run.paused", "resume": "run.resumed", "cancel": "run.cancelled", "complete": "run.completed"}.get(kind)
            if name:
                events.append(name)
    return events


def sequential(events):
    """One loop over the events, as a plain reading of the rules."""
    status, pending, attempts, failed, retries, error = "pending", set(), {}, {}, {}, None
    for e in events:
        e = {"event_type": e} if isinstance(e, str) else e
        kind, step = e["event_type"], e.get("step_id")
        status = fold.SETTERS.get(kind, status)
        if kind == "approval.requested":
            pending.add(e["approval_id"])
        elif kind in fold.DECISIONS:
            pending.discard(e["approval_id"])
            if kind == "approval.granted" and status == "suspended" and not pending:
                status = "running"
        elif kind == "step.started":
            attempts[step] = e["attempt"]
            retries.pop(step, None)
        elif kind == "step.failed" and e["terminal"]:
            failed[step] = e["error"]
            error = f"step '{step}': {e['error']}"
        elif kind == "step.failed":
            retries[step] = e["retry_at"]
        elif kind == "step.retry_requested":
            failed.pop(step, None)
            retries.pop(step, None)
            error = None
    return status, attempts, failed, set(retries), error


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(5)
    runs = {f"r{i}": random_run(r) for i in range(120)}
    return runs, make_log(spark, runs).cache()


def test_fold_equals_a_loop(many):
    runs, log = many
    status = {x["run_id"]: x["status"] for x in fold.status(log).collect()}
    attempts = {(x["run_id"], x["step_id"]): x["attempt"] for x in fold.attempts(log).collect()}
    failed = {(x["run_id"], x["step_id"]) for x in fold.failed_steps(log).collect()}
    retries = {(x["run_id"], x["step_id"]) for x in fold.pending_retries(log).collect()}
    errors = {x["run_id"]: x["error"] for x in fold.endings(log).collect()}
    for run_id, events in runs.items():
        s, a, f, p, e = sequential(events)
        assert status[run_id] == s, events
        assert {k[1]: v for k, v in attempts.items() if k[0] == run_id} == a
        assert {k[1] for k in failed if k[0] == run_id} == set(f)
        assert {k[1] for k in retries if k[0] == run_id} == p
        assert errors[run_id] == e


def test_every_cut_point(many):
    runs, log = many
    every = {(x["run_id"], x["seq"]): x["status"] for x in fold.state_everywhere(log).collect()}
    assert every == {(r, k): sequential(e[:k])[0] for r, e in runs.items() for k in range(1, len(e) + 1)}
    points = log.groupBy("run_id").agg(F.ceil(F.max("seq") / 2).alias("k"))
    for x in fold.state_at(log, points).collect():
        assert x["in_range"] and x["status"] == every[x["run_id"], x["k"]]


@pytest.mark.parametrize("cut", [1, 3, 6])
def test_snapshot_and_tail(many, cut):
    runs, log = many
    got = {x["run_id"]: x["status"] for x in fold.fold_from(fold.accumulators(log.where(F.col("seq") <= cut)), log).collect()}
    assert got == {r: sequential(e)[0] for r, e in runs.items()}


def test_any_edit_breaks_the_chain(spark, many):
    _, log = many
    chain = integrity.stamp(log.where("run_id < 'r3'"), F.struct("step_id", "error")).cache()
    assert integrity.verify(chain).where("bad_seq is not null").count() == 0
    victim = chain.groupBy("run_id").agg(F.max("seq").alias("n")).where("n > 3").first()["run_id"]
    own = F.col("run_id") == victim
    edits = {
        "edit": (chain.withColumn("record", F.when(own & (F.col("seq") == 2), F.replace("record", F.lit("seq"), F.lit("sEq"))).otherwise(F.col("record"))), 2),
        "remove": (chain.where(~(own & (F.col("seq") == 2))), 3),
        "insert": (chain.unionByName(chain.where(own & (F.col("seq") == 2)).withColumn("seq", F.lit(1000).cast("bigint"))), 1000),
    }
    for name, (bad, at) in edits.items():
        found = {x["run_id"]: x["bad_seq"] for x in integrity.verify(bad).where("bad_seq is not null").collect()}
        assert found == {victim: at}, name


def test_chain_and_seals_by_other_means(spark):
    """Every event type in a log of our own, hashed and signed here from the written rule: canonical JSON, SHA-256, HMAC over seal-v1:run:seq:hash."""
    kinds = sorted({e for _, e, _ in STEP_EVENTS} | {e for _, _, e, _ in RUN_EVENTS} | {"step.cancelled", "run.suspended"})
    rows = [("r\u00e9", i + 1, kind, None if i % 3 == 0 else f's{i} "\u20ac"', 0.5 * i) for i, kind in enumerate(kinds)]
    log = spark.createDataFrame(rows, "run_id string, seq bigint, event_type string, step_id string, fraction double").repartition(3)
    want, prev, at = [], None, 0
    for run, _, kind, step, fraction in rows:
        at += 1
        body = {"run_id": run, "seq": at, "event_type": kind, "prev_hash": prev, "fraction": fraction} | ({"step_id": step} if step else {})
        digest = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode("ascii")).hexdigest()
        want.append((at, kind, prev, digest, None, None))
        prev = digest
        if kind in ("run.completed", "run.failed", "run.cancelled", "run.suspended", "run.paused"):
            mac = hmac.new(b"key", f"seal-v1:{run}:{at}:{digest}".encode(), hashlib.sha256).hexdigest()
            at += 1
            body = {"run_id": run, "seq": at, "event_type": "integrity.sealed", "prev_hash": prev, "sealed_seq": at - 1, "sealed_hash": digest, "alg": "hmac-sha256", "key_id": "k", "signature": mac}
            digest = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            want.append((at, "integrity.sealed", prev, digest, at - 1, mac))
            prev = digest
    chain = integrity.stamp(log, F.struct("step_id", "fraction"), "key", "k").cache()
    got = [(x["seq"], x["event_type"], x["prev_hash"], x["hash"], x["sealed_seq"], x["signature"]) for x in chain.orderBy("seq").collect()]
    assert got == want
    assert [tuple(x) for x in integrity.verify(chain).collect()] == [("r\u00e9", None, None, len(want))]
    keys = spark.createDataFrame([("k", "key")], "key_id string, secret string")
    assert {x["verdict"] for x in integrity.judge_seals(chain, keys).collect()} == {"valid"}
    # hashes written out: an event without and with a predecessor, and a seal
    two = integrity.stamp(spark.createDataFrame([("a", 1, "run.started"), ("a", 2, "run.completed")], "run_id string, seq bigint, event_type string"), F.struct(F.lit(1).alias("v")), "s", "k").orderBy("seq").collect()
    assert [x["hash"] for x in two] == HASHES and two[2]["signature"] == SIGNATURE


def test_verified_counts_stop_at_the_first_failure(spark):
    rows = [("a", 1, None, None, "x"), ("a", 2, None, "h2", "x"), ("a", 3, "h2", "h3", "x"), ("a", 4, "zz", "h4", "x"), ("a", 5, "h4", "h5", "x"), ("b", 1, None, "g1", "x"), ("b", 2, "g1", "g2", "x")]
    chain = spark.createDataFrame(rows, "run_id string, seq bigint, prev_hash string, hash string, record string")
    got = sorted(map(tuple, integrity.verify(chain, F.lit(True)).collect()))
    assert got == [("a", 4, "prev_hash does not match", 2), ("b", None, None, 2)]


def test_oldest_run_comes_first_in_the_inbox(spark):
    asked = spark.createDataFrame([("r1", "a1", 4, "pending"), ("r2", "a2", 3, "pending"), ("r2", "a3", 2, "pending"), ("r3", "a4", 2, "pending"), ("r2", "a5", 1, "granted")], "run_id string, approval_id string, requested_seq bigint, approval_status string")
    states = spark.createDataFrame([("r1", "suspended", T0 + datetime.timedelta(hours=1)), ("r2", "suspended", T0), ("r3", "running", T0)], "run_id string, status string, created_at timestamp_ntz")
    assert [x["approval_id"] for x in index.inbox(asked, states).collect()] == ["a3", "a2", "a1"]


def test_human_only_matrix(spark):
    """Workflow allows agents, policy allows them (null: no policy), accepted."""
    rows = [(0, False, None, False), (1, True, None, True), (2, True, False, False), (3, True, True, True), (4, False, True, False), (5, False, False, False)]
    budget = spark.createDataFrame(rows, "id int, allow_agent boolean, agent_allowed boolean, accept boolean").selectExpr(
        "*", "array('read') as allowed", "array('spend') as approval", "cast(null as bigint) as max_step_cost", "cast(null as bigint) as max_run_cost", "cast(null as bigint) as max_wall", "agent_allowed is not null as has_policy",
        "cast(null as array<string>) as ceiling", "cast(array() as array<string>) as always_approve", "1L as p_step_cost", "cast(null as bigint) as p_run_cost", "cast(null as bigint) as p_wall",
    )
    out = governance.effective_budget(budget).collect()
    assert all(x["eff_allow_agent"] == x["accept"] for x in out)
    assert {x["id"]: x["eff_max_step_cost"] for x in out}[2] == 1


def test_cron_fields(spark):
    cases = {"*/20 6,18 * * 0": [[0, 20, 40], [6, 18]], "5-15/5 8-10 1 2 7": [[5, 10, 15], [8, 9, 10]], "50/5 23 31 2 *": [[50, 55], [23]]}
    df = spark.createDataFrame([(k,) for k in cases], "expr string")
    for x in df.select("expr", *[cron.field(F.col("expr"), i).alias(f"f{i}") for i in range(5)]).collect():
        assert [x["f0"], x["f1"]] == cases[x["expr"]]
        assert set(x["f4"]) <= set(range(7))
    either = schedule.slots(schedule.parse(spark.createDataFrame([("x", "0 0 13 * 5")], "name string, expr string")), F.lit("2024-09-01"), F.lit("2024-09-30"))
    assert sorted(x["slot"].day for x in either.collect()) == [6, 13, 20, 27]


def queue_order(deps):
    """First in, first out, children by name: one after another."""
    order, placed = [], set()
    line = sorted(n for n, d in deps.items() if not d)
    while line:
        n, line = line[0], line[1:]
        order.append(n)
        placed.add(n)
        line += sorted(m for m, d in deps.items() if n in d and set(d) <= placed)
    return order


def test_topological_order_ties_and_cycles(spark):
    rows = [("w", "d", ["b", "c"]), ("w", "b", ["a"]), ("w", "c", ["a"]), ("w", "a", []), ("x", "p", ["q"]), ("x", "q", ["p"]), ("x", "o", [])]
    r = random.Random(5)
    graphs = {}
    for g in range(12):
        names = [f"n{i}" for i in range(r.randint(1, 25))]
        r.shuffle(names)
        graphs[f"g{g}"] = {n: r.sample(names[:i], min(i, r.randint(0, 3))) for i, n in enumerate(names)}
    rows += [(g, n, d) for g, deps in graphs.items() for n, d in deps.items()]
    nodes = spark.createDataFrame(rows, "workflow string, node string, depends_on array<string>")
    good = nodes.where("workflow <> 'x'")
    out = dag.topological_order(good).orderBy("workflow", "place").collect()
    assert [x["node"] for x in out if x["workflow"] == "w"] == ["a", "b", "c", "d"]
    for g, deps in graphs.items():
        assert [x["node"] for x in out if x["workflow"] == g] == queue_order(deps)
    assert [tuple(x) for x in dag.cyclic(nodes).collect()] == [("x", "p")] == [tuple(x) for x in dag.cyclic(nodes, in_task=1).collect()]
    assert {x["node"]: x["wave"] for x in dag.waves(nodes.where("workflow = 'w'")).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert sorted(map(tuple, dag.waves(good, in_task=3).collect())) == sorted(map(tuple, dag.waves(good).collect()))
    with pytest.raises(Exception, match="workflow x has a cycle: node p is never ready"):
        dag.topological_order(nodes).collect()
    with pytest.raises(Exception, match="unknown node zz"):
        dag.topological_order(spark.createDataFrame([("w", "a", ["zz"])], nodes.schema)).collect()


def test_long_chains_are_not_cut(spark):
    n = 1000
    rows = [("w", f"n{i}", [f"n{i - 1}"] if i else []) for i in range(n)]
    nodes = spark.createDataFrame(rows, "workflow string, node string, depends_on array<string>").coalesce(1)
    want = {f"n{i}": i for i in range(n)}
    assert {x["node"]: x["wave"] for x in dag.waves(nodes).collect()} == want
    assert {x["node"]: x["place"] - 1 for x in dag.topological_order(nodes).collect()} == want
    assert dag.cyclic(nodes).count() == 0
    loop = spark.createDataFrame([("w", "a", []), ("w", "b", ["a", "c"]), ("w", "c", ["b"])], nodes.schema)
    for some in (10, 1):
        with pytest.raises(Exception, match="has a cycle"):
            dag.waves(loop, in_task=some).collect()
    runs = spark.createDataFrame([(f"r{i}", f"r{i - 1}" if i else "gone") for i in range(n)] + [("s", None)], "run_id string, parent_run_id string").coalesce(1)
    got = {x["run_id"]: (x["root"], x["depth"]) for x in dag.lineage(runs).collect()}
    assert got == {**{f"r{i}": ("r0", i) for i in range(n)}, "s": ("s", 0)}
    with pytest.raises(ValueError, match="ancestor"):
        dag.lineage(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], runs.schema))


def test_rejections_with_earlier_events_only(spark):
    asked = spark.createDataFrame([("r1", "a1", "s1", "effect", "rejected", 5), ("r2", "a2", "s1", "effect", "rejected", 5), ("r3", "a3", "s1", "cost", "rejected", 5), ("r4", "a4", "s1", "effect", "granted", 5)], "run_id string, approval_id string, step_id string, kind string, approval_status string, decided_seq bigint")
    log = spark.createDataFrame([("r1", 3, "step.dead_lettered", "s1"), ("r1", 4, "run.failed", None), ("r2", 6, "step.dead_lettered", "s1"), ("r2", 7, "run.failed", None), ("r3", 6, "run.failed", None)], "run_id string, seq bigint, event_type string, step_id string")
    got = {x["run_id"]: (x["dead_lettered"], x["run_failed"], x["ok"]) for x in governance.rejection_audit(asked, log).collect()}
    assert got == {"r1": (False, False, False), "r2": (True, True, True), "r3": (False, True, True)}


def test_export_round_trip(spark, many, tmp_path):
    _, log = many
    path = str(tmp_path / "export")
    data = spark.createDataFrame([("r0", 1, "aa", b"\x00\xff{}"), ("r1", 1, "bb", None)], "run_id string, seq bigint, sha256 string, data binary")
    states = fold.status(log).join(fold.total_cost(log), "run_id").withColumn("error", F.lit(None).cast("string"))
    ingest.write_export(ingest.export_lines(log, data, states, exported_at="2024-02-02T00:00:00Z"), path)
    back = ingest.read_export(spark, path)
    assert {x["kind"] for x in back.select("kind").distinct().collect()} == {"event", "run-export", "summary", "blob"}
    again = ingest.events_from(back, log.schema)
    assert again.schema.simpleString() == log.schema.simpleString()
    assert sorted(map(repr, again.collect())) == sorted(map(repr, log.collect()))
    assert {(x["sha256"], None if x["data"] is None else bytes(x["data"])) for x in ingest.blobs_from(back).collect()} == {("aa", b"\x00\xff{}"), ("bb", None)}


def test_only_verified_exports_are_purged(spark):
    selection = spark.createDataFrame([("a", None), ("b", "too recent"), ("c", None), ("d", None)], "run_id string, reason string")
    checks = spark.createDataFrame([("a", None), ("b", None), ("c", "summary"), ("d", None)], "run_id string, problem string")
    chain = spark.createDataFrame([("a", True), ("c", True), ("d", False)], "run_id string, verified boolean")
    assert [x["run_id"] for x in ingest.purgeable(selection, checks, chain).collect()] == ["a"]


def test_redaction_prefers_longer_secrets(spark):
    text, names = textjobs.redact(F.col("t"), {"A": "abcdefgh", "B": "abcdefghij", "C": "short"})
    x = spark.createDataFrame([("x abcdefghij abcdefgh short",)], "t string").select(text.alias("t"), names.alias("n")).first()
    assert x["t"] == "x [REDACTED:B] [REDACTED:A] short" and x["n"] == ["A", "B"]


def test_throttle_is_greedy(spark):
    from logweave.streaming.jobs import throttle

    rows = [("r", "s", float(t), 2.0, "n" * 300) for t in (0, 1, 5, 6, 9, 10, 15)]
    out = throttle(spark.createDataFrame(rows, "run_id string, step_id string, at double, fraction double, note string"), 5.0).orderBy("at").collect()
    assert [x["at"] for x in out] == [0, 5, 10, 15] and out[0]["fraction"] == 1.0 and len(out[0]["note"]) == 200
