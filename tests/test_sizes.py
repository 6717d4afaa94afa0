"""What shows at size only, put to small tables."""

import re

import duckdb
from pyspark.sql import functions as F

from logweave.functions.storage import bucketed
from logweave.operators import dag, fold, integrity, spans
from logweave.operators.scan import newest_before
from logweave.plans import registry
from logweave.sources import run_log
from logweave.streaming import jobs

SF = "/root/testdata/sf0.01"


def test_order_twin_counts_waves_without_an_offset_frame():
    """Counting rows by a RANGE frame with an offset gave one of 900,000 workflows a place twice, in some runs."""
    sql = registry.oracle_sql()["f04_topological_order"]
    assert not re.search(r"range between unbounded preceding and 1 preceding", sql)
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    bad = c.execute(f"select count(*) from (select workflow from ({sql}) group by workflow having min(place) <> 1 or max(place) <> count(*) or count(distinct place) <> count(*))").fetchone()[0]
    assert bad == 0


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_log_is_dealt_by_run_once(spark):
    log = run_log.derive(spark, SF)
    per = log.groupBy("run_id", "step_id").agg(F.max("seq")).withColumn("n", F.expr("count(*) over (partition by run_id)"))
    assert _exchanges(per) == _exchanges(log)


def test_partitions_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(run_log, "LINES", 5_000)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    sizes = [r["count"] for r in run_log.steps(spark, SF).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == -(-lines // 5_000) and max(sizes) < 2 * 5_000 and sum(sizes) == lines


def test_many_small_workflows_share_frames(spark):
    """A frame for each workflow took most of the time."""
    nodes = spark.range(20_000).selectExpr("concat('w', id div 2) as workflow", "concat('n', id % 2) as node", "if(id % 2 = 1, array('n0'), cast(array() as array<string>)) as depends_on").coalesce(1)
    rows = dag.rounds(nodes)
    got = rows.groupBy("node", "wave", "place").count().orderBy("node").collect()
    assert [tuple(r) for r in got] == [("n0", 0, 1, 10_000), ("n1", 1, 2, 10_000)]


def test_a_step_of_a_stream_is_many_files(spark):
    """A step was one file, written by one task, even where all rows share the first column's value."""
    rows = spark.range(9_000).selectExpr("case when id = 8999 then 2 when id = 8998 then 1 else 0 end as place", "id")
    got = []

    def batch(df, i):
        got.append(tuple(df.withColumn("f", F.input_file_name()).agg(F.count_distinct("f"), F.count("*"), F.max("place"), F.count_distinct("id")).first()))

    stream = jobs.as_stream(rows, 3, file_rows=1_000)
    stream.writeStream.trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    assert [g[1:] for g in got if g[1]] == [(8_998, 0, 8_998), (2, 2, 2)] and got[0][0] == 3


def test_steps_of_a_stream_keep_the_order_and_nulls(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["b", None, "a", "c", "d", "e", "f"])], "k string, i int")
    got = []
    jobs.as_stream(rows, 3).writeStream.trigger(availableNow=True).foreachBatch(lambda df, i: got.append(sorted(r["k"] or "" for r in df.collect()))).start().awaitTermination()
    assert got == [["", "a", "b"], ["c", "d"], ["e", "f"]]


def test_seals_meet_their_events_without_a_shuffle(spark):
    rows = [("r", i, "integrity.sealed" if i == 3 else "run.completed", f"h{i}", *((2, "h2", "a", "k", "s") if i == 3 else (None,) * 5)) for i in (1, 2, 3)]
    kind = "run_id string, seq bigint, event_type string, hash string, sealed_seq bigint, sealed_hash string, alg string, key_id string, signature string"
    chain = bucketed(spark.createDataFrame(rows, kind), 4)
    judged = integrity.judge_seals(chain, None)
    assert _exchanges(judged) == 0
    assert [tuple(r) for r in judged.collect()] == [("r", 3, 2, "k", "unknown algorithm")]


def test_spans_over_buckets_shuffle_nothing(spark, tmp_path):
    log = bucketed(run_log.derive(spark, "/root/testdata/sf0.001"), 4, path=str(tmp_path / "events"))
    assert _exchanges(spans.step_spans(log)) == 0


def test_next_fire_keeps_no_days(spark):
    """The days of all schedules were sorted by name in one task: a least struct is no hash aggregate."""
    from logweave.operators import schedule

    rows = spark.createDataFrame([("a", "5,50 8 * * *"), ("a", "10 9 * * *"), ("b", "0 0 29 2 *"), ("never", "0 0 31 2 *")], "name string, expr string").coalesce(1)
    found = schedule.next_fire(schedule.parse(rows), F.lit("2024-02-28 08:50:00").cast("timestamp_ntz"))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["name"], str(r["next_slot"])) for r in found.collect()) == [("a", "2024-02-28 09:10:00"), ("b", "2024-02-29 00:00:00")]


def test_seals_are_planned_as_they_are_stamped(spark):
    log = run_log.derive(spark, "/root/testdata/sf0.001")
    plan = integrity.seal_plan(log)
    assert _exchanges(plan) == _exchanges(log)
    stamped = integrity.stamp(log, F.struct("step_id", "error"), "secret", "k", dealt=True).where("event_type = 'integrity.sealed'").select("run_id", "seq", "sealed_seq")
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, stamped.collect())) and plan.count() > 1_000


def test_stamped_records_are_canonical_for_any_body(spark):
    """Records are put together from cached pieces; they are what the encoder gives for the whole."""
    import hashlib

    from logweave.functions.hashing import canonical

    rows = [("ré", 1, "x", "a\"\\é\n", 0.5), ("ré", 2, "y", None, 1e-9), ("s", 5, "x", "a", None)]
    log = spark.createDataFrame(rows, "run_id string, seq bigint, event_type string, zeta string, alpha double")
    got = integrity.stamp(log, F.struct("zeta", "alpha")).orderBy("run_id", "seq").collect()
    prev = {}
    for r, (run_id, _, kind, z, a) in zip(got, rows, strict=True):
        body = {k: v for k, v in (("zeta", z), ("alpha", a)) if v is not None}
        want = canonical({**body, "run_id": run_id, "seq": r["seq"], "event_type": kind, "prev_hash": prev.get(run_id)})
        assert r["record"] == want.decode() and r["hash"] == hashlib.sha256(want).hexdigest() and r["prev_hash"] == prev.get(run_id)
        prev[run_id] = r["hash"]


def test_lines_of_a_dealt_log_shuffle_nothing(spark, tmp_path):
    from logweave.plans import store_queries
    from logweave.sources import ingest

    log = bucketed(run_log.derive(spark, "/root/testdata/sf0.001"), 4, path=str(tmp_path / "log"))
    lines = store_queries._lines(log)
    assert _exchanges(ingest.manifest(lines, dealt=True)) == 0 and _exchanges(ingest.export_check(lines)) == 0


def test_links_by_blocks_deal_no_rows_of_a_dealt_log(spark):
    """Rows met the start of their block in a join, which dealt all of them anew; now only a stored log without buckets is dealt."""
    plan = registry.queries()["d02_chain_links_blocks"](spark, SF)
    assert _exchanges(plan) == 0
    rows = [("a", i, None if i % 5 < 3 or i > 60 else f"h{i}") for i in range(1, 90)] + [("b", i, None) for i in range(1, 9)] + [("c", 5, "x"), ("c", 40, None), ("c", 41, "y")]
    log = spark.createDataFrame(rows, "run_id string, seq bigint, hash string")
    plain = log.withColumn("p", F.expr("last(hash, true) over (partition by run_id order by seq rows between unbounded preceding and 1 preceding)"))
    for block in (1, 3, 100):
        assert sorted(map(tuple, newest_before(log, "p", F.col("hash"), block).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def _line_scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")


def test_states_at_points_derive_the_log_once(spark):
    """The log was derived anew for each part of a state; several points of a run were mixed up."""
    assert _line_scans(registry.queries()["b21_time_travel"](spark, SF)) == 1
    events = ["run.started", "approval.requested", "run.suspended", "approval.granted", "step.completed", "run.completed"]
    log = spark.createDataFrame([("a", i, e, 2) for i, e in enumerate(events, 1)] + [("b", 1, "step.started", 5)], "run_id string, seq bigint, event_type string, cost int")
    log = log.withColumns({"cost": F.col("cost").cast("decimal(18,4)"), "occurred_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    points = spark.createDataFrame([*(("a", k) for k in range(8)), ("b", 1), ("b", 2), ("c", 1), ("a", None)], "run_id string, k bigint")
    got = {(x["run_id"], x["k"]): (x["in_range"], x["status"], None if x["total_cost"] is None else int(x["total_cost"])) for x in fold.state_at(log, points).collect()}
    want = {("a", k): (True, s, c) for k, s, c in [(1, "running", 0), (2, "running", 0), (3, "suspended", 0), (4, "running", 0), (5, "running", 2), (6, "completed", 2)]}
    none = (False, None, None)
    assert got == want | {("b", 1): (True, "pending", 0), ("b", 2): none, ("c", 1): none, ("a", 0): none, ("a", 7): none, ("a", None): none}


def test_inbox_reads_written_prefixes(spark):
    """Each of the inbox's eight parts derived the log."""
    plan = registry.queries()["c08_inbox"](spark, SF)
    assert _line_scans(plan) == 0 and _exchanges(plan) == 0


def test_chains_in_order_move_no_events(spark):
    """Every event of a stamped chain was dealt again to be verified, and twice for its seals; or the chain was stored."""
    log = run_log.derive(spark, SF)
    queries = registry.queries()
    assert _exchanges(queries["d05_stamp_and_verify"](spark, SF)) == _exchanges(queries["d07_seal_verdicts"](spark, SF)) == _exchanges(log)
    for name in ("d08_seal_report", "d09_chain_state"):
        plan = queries[name](spark, SF)
        assert _line_scans(plan) == 1
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") - text.count("BroadcastExchange") == _line_scans(plan) * 2 + 1  # lines, orders, and seals with runs


def test_a_pass_in_order_equals_windows(spark):
    """Seals of earlier and later events, of none, of other hashes and keys; damaged links, contents and unhashed events."""
    kinds = ["run.started", "run.suspended", "step.started", "run.paused", "run.completed"]
    log = spark.createDataFrame([(f"r{i:02}", n, kinds[(i + n) % 5], f"x{n % 3}") for i in range(40) for n in range(1, 9)], "run_id string, seq bigint, event_type string, v string").repartition(3, "run_id")
    chain = integrity.stamp(log, F.struct("v"), "secret", "k", dealt=True)
    h = "conv(substr(sha2(concat(run_id, seq), 256), 1, 4), 16, 10)"
    chain = chain.selectExpr(
        "run_id", "seq", "event_type", f"if({h} % 23 = 1, null, hash) as hash", f"if({h} % 29 = 1, 'x', prev_hash) as prev_hash", f"if({h} % 31 = 1, replace(record, 'seq', 'seq2'), if({h} % 31 = 2, concat(' ', record), record)) as record",
        f"case when {h} % 7 = 1 then sealed_seq - 2 when {h} % 7 = 2 then sealed_seq + 3 when {h} % 7 = 3 then null when {h} % 7 = 4 then seq else sealed_seq end as sealed_seq",
        f"case when {h} % 7 = 4 then hash when {h} % 5 = 1 then null else sealed_hash end as sealed_hash", f"if({h} % 11 = 1, 'none', alg) as alg", f"if({h} % 11 = 2, 'other', key_id) as key_id", f"if({h} % 11 = 3, 'x', signature) as signature",
    )
    keys = spark.createDataFrame([("k", "secret")], "key_id string, secret string")
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)
    assert same(integrity.verify(chain), integrity.verify(chain, ordered=True)) and integrity.verify(chain).where("reason is not null").select("reason").distinct().count() == 3
    assert same(integrity.verify(chain, F.lit(True)), integrity.verify(chain, F.lit(True), ordered=True))
    for ring in (keys, None):
        assert same(integrity.judge_seals(chain, ring), integrity.judge_seals(chain, ring, ordered=True))
        assert same(integrity.seal_report(chain, ring), integrity.seal_report(chain, ring, ordered=True))
        assert same(integrity.chain_state(integrity.verify(chain), integrity.seal_report(chain, ring)), integrity.state_in_order(chain, ring))
    assert integrity.judge_seals(chain, keys).select("verdict").distinct().count() >= 4
    assert integrity.verify(chain.limit(0), ordered=True).count() == 0


def test_what_a_long_run_carries_goes_to_a_file():
    held = integrity._Carried()
    held.HELD = 3
    for i in range(1, 50):
        held.add(2 * i, None if i % 7 == 0 else f"h{i}", i)
    for i in range(1, 50):
        assert held.find(2 * i, f"h{i}") == (i % 7 != 0, i) and held.find(2 * i, "x") == (False, i) and held.find(2 * i + 1, f"h{i}") == (False, None)
    assert held.file is not None and len(held.new) <= 3 and not held.find(14, None)[0] and not held.find(16, None)[0]


def test_record_digests_by_shape():
    """Records that are their own canonical text are not parsed; the digest is that of the parsed record."""
    from logweave.functions.hashing import _slow_record_digest, canonical, record_digest

    base = {"run_id": "r1", "seq": 12, "event_type": "x", "prev_hash": "ab" * 32, "note": 'a"seq":1,"run_id":"b', "inner": {"seq": 3, "hash": "h", "prev_hash": ""}}
    texts = [canonical(base).decode(), canonical(base | {"hash": "h"}).decode(), canonical(base | {"seq": -1}).decode(), canonical(base | {"seq": 1.5, "run_id": "\u00e9"}).decode(), canonical(base | {'a\\"seq': 1}).decode()]
    plain = texts[0]
    texts += [plain.replace('"seq":12', '"seq":012'), plain.replace('"seq":12', '"seq":12,"seq":12'), plain.replace('"seq":12', '"seq":1e1'), plain.replace(":12", ": 12"), " " + plain, plain + "x", "[1]", "{", "", "null", '"seq":1', None]
    for text in texts:
        assert record_digest(text) == _slow_record_digest(text), text
    assert record_digest(plain) is not None and record_digest(plain) != record_digest(plain.replace(":12", ":13"))


def test_export_check_sorts_nothing_and_stands_odd_lines(spark, tmp_path):
    """A greatest text made the check sort all lines; a seq that is no number ended the job."""
    from logweave.sources import ingest

    event = lambda n: f'{{"event_type":"e","seq":{n}}}'
    head, end = '{"kind":"run-export","run_id":"%s"}', '{"events":%d,"kind":"summary"}'
    runs = {
        "good": [head % "good", event(1), event(2), end % 2], "twice": [head % "twice", event(1), event(1), end % 2], "text": [head % "text", event('"x"'), end % 1], "gap": [head % "gap", event(1), event(3), end % 2],
        "less": [head % "less", event(1), end % 2], "cut": [head % "cut", event(1), event(2)[:-1], end % 2], "none": [head % "none", end % 0], "other": [head % "othes", event(1), end % 1], "headless": [event(1), end % 1],
        "two": [head % "two", head % "twp", event(1), end % 1], "older": [head % "older", head % "a", event(1), end % 1], "array": [head % "array", "[1]", "null", "no json", end % 0],
    }
    lines = spark.createDataFrame([(r, x) for r, xs in runs.items() for x in xs], "run_id string, line string")
    found = ingest.export_check(lines)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {x["run_id"]: (x["events"], x["problem"]) for x in found.collect()} == {
        "good": (2, None), "twice": (2, "event lines"), "text": (1, "event lines"), "gap": (2, "event lines"), "less": (1, "summary"), "cut": (1, "summary"), "none": (0, None), "other": (1, "header"),
        "headless": (1, "header"), "two": (1, "header"), "older": (1, None), "array": (0, None),
    }


def test_steps_of_a_stream_are_not_dealt(spark, tmp_path, monkeypatch):
    """The rows of a step were dealt at random to its files, so that each carried its run's id; a stored table was written again."""
    spark.range(0, 9_000, 1, 4).selectExpr("id % 3 as place", "id").write.parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(jobs, "written", lambda df: 1 / 0)
    stream, n = jobs.counted_stream(spark.read.parquet(str(tmp_path / "rows")), 3, file_rows=1_000, stored=True)
    got = []

    def batch(df, i):
        files = {}
        for r in df.withColumn("f", F.input_file_name()).collect():
            files.setdefault(r["f"], []).append(r["id"])
        got.append(files)

    stream.writeStream.trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    assert n == 9_000 and [len(files) for files in got] == [3, 3, 3]
    assert [sorted(sum(files.values(), [])) for files in got] == [list(range(k, 9_000, 3)) for k in range(3)]
    breaks = [sum(b != a + 3 for a, b in zip(ids, ids[1:])) for files in got for ids in files.values()]
    assert max(breaks) <= 4
