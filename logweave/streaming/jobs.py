"""Streams over logs and events: tails, live state, windows, joins, sessions and timers.

Each operator maps a streaming DataFrame to another; most take a batch DataFrame as well and then give the whole answer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.shipping import ship
from ..functions.storage import cut, written
from ..operators.fold import DECISIONS, SETTERS
from ..operators.fold import TERMINAL as ENDED

TERMINAL = ["run.completed", "run.failed", "run.cancelled"]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        cut(spark.range(1))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


#: Rows of a file of as_stream.
FILE_ROWS = 250_000
#: Keys that its ranges are drawn from.
RANGE_KEYS = 20_000


def as_stream(rows: DataFrame, files: int = 3, max_files: int = 1, file_rows: int = FILE_ROWS, stored: bool = False) -> DataFrame:
    """The stream of counted_stream."""
    return counted_stream(rows, files, max_files, file_rows, stored)[0]


def counted_stream(rows: DataFrame, files: int = 3, max_files: int = 1, file_rows: int = FILE_ROWS, stored: bool = False) -> tuple[DataFrame, int]:
    """A file-source stream of a table that is written in `files` steps, by ranges of its first column, one after another: the source takes files by their time of change, so they come in the order of that column. With the number of its rows.

    A step of many rows is as many files as they ask for (at most one for each partition of the table as it is read back), which
    one batch takes together; no task writes a whole step. Rows are not dealt for it, so those of a run stay side by side.
    stored: the table lies in files already, and is read from there, once for each step.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/in"
    held = rows if stored else written(rows)
    n, first = held.count(), F.col(rows.columns[0])
    keys = held.select(first.alias("k")).where("k is not null")
    keys = sorted(r["k"] for r in (keys if n <= RANGE_KEYS else keys.sample(RANGE_KEYS / n, 7)).collect())
    bounds = sorted({keys[-(-(i + 1) * len(keys) // files) - 1] for i in range(files - 1)}) if keys else []
    per = max(1, min(-(-n // (files * file_rows)), held.rdd.getNumPartitions()))
    for i in range(files):
        low = (first > F.lit(bounds[i - 1])) if 0 < i <= len(bounds) else F.lit(i == 0)
        high = (first <= F.lit(bounds[i])) | first.isNull() if i < len(bounds) else F.lit(i == len(bounds))
        step = held.where((low | first.isNull() if i == 0 else low) & high & (F.lit(True) if i == 0 else first.isNotNull()))
        step.coalesce(per).write.option("compression", "zstd").mode("append").parquet(path)
        lacking = (i + 1) * per - len(spark.read.schema(rows.schema).parquet(path).inputFiles()) if per > 1 else 0
        for _ in range(lacking):  # a step of few rows is made up with empty files
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max_files * per).parquet(path), n


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its output back; in update mode with the batch that wrote each row in batch_id."""
    spark = stream.sparkSession
    base = shared_folder(spark)
    out = f"{base}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        query = writer.foreachBatch(lambda df, i: df.withColumn("batch_id", F.lit(i).cast("bigint")).write.mode("overwrite").parquet(f"{out}/batch={i}")).outputMode(mode).start()
    query.awaitTermination()
    kind = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    reader = spark.read.schema(kind)
    return reader.parquet(out) if mode == "append" else reader.option("recursiveFileLookup", "true").parquet(out)


def parse_after(header: Column, query: Column) -> Column:
    """Where to resume: the header beats the query; what is no whole number from zero up counts as absent."""
    ok = lambda c: F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("bigint"))
    return F.coalesce(F.when(header.isNotNull(), ok(header)).otherwise(ok(query)), F.lit(0).cast("bigint"))


def tail(stream: DataFrame, offsets: DataFrame) -> DataFrame:
    """Events after each run's own offset; offsets is a static (run_id, after). Runs that are not named start at the beginning."""
    return stream.join(offsets, "run_id", "left").where(F.col("seq") > F.coalesce("after", F.lit(0))).drop("after")


#: How long the state of a run or approval that has ended stays, in milliseconds of event time: late and repeated events are told apart that long.
KEEP_ENDED = 24 * 3600 * 1000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets that the keys of a stream are dealt into, and rows that a bucket of a stream of known size is for.
BUCKETS, BUCKET_ROWS = 64, 20_000
#: Events of an entry of a list state that holds them as columns.
CHUNK = 5_000


def buckets_for(rows: int) -> int:
    return BUCKETS + rows // BUCKET_ROWS


def _stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, mode: str, timed: bool, buckets: int | None = None) -> DataFrame:
    """Rows through a processor with typed state per key, or per bucket of keys. Sets the session's state store to the one that such processors need."""
    ship(rows.sparkSession)
    rows.sparkSession.conf.set(_STORE, _ROCKS)
    if buckets:
        rows, keys = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))), ["bucket"]
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, mode, "EventTime" if timed else "None")


def _timed(stream: DataFrame, at: str | None, delay: str, columns: list[str]) -> DataFrame:
    rows = stream.select(*columns)
    return rows if at is None else stream.select(*columns, F.col(at).cast("timestamp").alias("at")).withWatermark("at", delay)


def _ms(times: pd.Series) -> list[int]:
    return times.astype("datetime64[ms]").astype("int64").tolist()


def _chunks(columns: list[list]) -> list[tuple]:
    return [tuple(c[lo : lo + CHUNK] for c in columns) for lo in range(0, len(columns[0]), CHUNK)]


class _Buckets(StatefulProcessor):
    """Many keys under one, a bucket of them: a call for each bucket and batch, which reads and writes the bucket's state as lists. One timer, the earliest that any of its keys asks for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")

    def arm(self, due: int) -> None:
        """Set the timer, or none for zero."""
        held = (self.timer.get() or (0,))[0]
        if due == held:
            return
        if held:
            self.handle.deleteTimer(held)
        if due:
            self.handle.registerTimer(due)
            self.timer.update((due,))
        else:
            self.timer.clear()

    def fired(self, timerValues, expiredTimerInfo) -> int:
        """The time up to which keys are due; the timer is gone."""
        self.timer.clear()
        return max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    @staticmethod
    def put(state, entries: list[tuple]) -> None:
        if entries:
            state.put(entries)
        elif state.exists():
            state.clear()

    def close(self) -> None:
        pass


class _InOrder(_Buckets):
    """Events of runs in seq order, whatever order they arrive in.

    A run has an entry: its place, its next seq, its newest event's time, when it goes, and what the subclass keeps. What comes
    early waits in columns, by the run's place. A run that has ended keeps its entry until `keep` milliseconds of event time
    after its newest event.
    """

    state = "place bigint, run_id string, following bigint, latest bigint, due bigint"

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.runs = handle.getListState("run", self.state)
        self.early = handle.getListState("early", "place array<bigint>, seq array<bigint>, event_type array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, names, waiting, touched = {}, {}, {}, set()
        for place, run, *values in self.runs.get():
            held[run], names[place] = values, run
        for chunk in self.early.get():
            for place, seq, kind in zip(*chunk, strict=True):
                waiting.setdefault(names[place], {})[seq] = kind
        for f in rows:
            times = [0] * len(f) if self.keep is None else _ms(f["at"])
            for run, seq, kind, at in zip(f["run_id"].tolist(), f["seq"].tolist(), f["event_type"].tolist(), times, strict=True):
                if run not in held:
                    held[run] = list(self.first)
                if at > held[run][1]:
                    held[run][1] = at
                if seq >= held[run][0]:
                    waiting.setdefault(run, {})[seq] = kind
                touched.add(run)
        out = []
        for run in touched:
            (following, latest, _, *own), got = held[run], waiting.get(run, {})
            before = following
            while not self.closed(own):
                kind = got.pop(following, None)
                if kind is None:
                    break
                own = self.step(own, kind)
                out += self.passed(run, following, kind)
                following += 1
            if following > before:
                out += self.moved(run, following, own)
            if self.closed(own):
                got.clear()
            if not got:
                waiting.pop(run, None)
            held[run] = [following, latest, latest + self.keep if self.keep is not None and self.ended(own) and not got else 0, *own]
        places = {run: i for i, run in enumerate(held)}
        self.put(self.runs, [(places[run], run, *values) for run, values in held.items()])
        events = [(places[run], seq, kind) for run, got in waiting.items() for seq, kind in got.items()]
        self.put(self.early, _chunks([list(c) for c in zip(*events, strict=True)]) if events else [])
        self.arm(min((values[2] for values in held.values() if values[2]), default=0)) if self.keep is not None else None
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.fired(timerValues, expiredTimerInfo)
        kept = [tuple(e) for e in self.runs.get() if not 0 < e[4] <= now]
        self.put(self.runs, kept)
        self.arm(min((e[4] for e in kept if e[4]), default=0))
        yield from ()


class _UntilTerminal(_InOrder):
    state = _InOrder.state + ", over boolean"
    first = (1, 0, 0, False)
    columns = ["run_id", "seq", "event_type"]

    def closed(self, own: list) -> bool:
        return own[0]

    ended = closed

    def step(self, own: list, kind: str) -> list:
        return [kind in TERMINAL]

    def passed(self, run_id: str, seq: int, kind: str) -> list:
        return [(run_id, seq, kind)]

    def moved(self, run_id: str, following: int, own: list) -> list:
        return []


class _LiveState(_InOrder):
    state = _InOrder.state + ", status string, pending bigint, done bigint"
    first = (1, 0, 0, "pending", 0, 0)
    columns = ["run_id", "status", "last_seq", "n_completed"]

    def closed(self, own: list) -> bool:
        return False

    def ended(self, own: list) -> bool:
        return own[0] in ENDED

    def step(self, own: list, kind: str) -> list:
        status, pending, done = own
        if kind == "approval.requested":
            pending += 1
        elif kind in DECISIONS:
            pending -= 1
            if kind == "approval.granted" and status == "suspended" and pending == 0:
                status = "running"
        elif kind == "step.completed":
            done += 1
        return [SETTERS.get(kind, status), pending, done]

    def passed(self, run_id: str, seq: int, kind: str) -> list:
        return []

    def moved(self, run_id: str, following: int, own: list) -> list:
        return [(run_id, own[0], following - 1, own[2])]


def until_terminal(stream: DataFrame, at: str | None = None, delay: str = "1 day", keep_ended: int = KEEP_ENDED, buckets: int = BUCKETS) -> DataFrame:
    """(run_id, seq, event_type) of each run up to its first terminal event, in seq order; later events of the run are dropped.

    Early events wait in the state. An ended run leaves a tombstone. With `at`, an event-time column, the tombstone goes
    `keep_ended` milliseconds after the run's newest event, and events that arrive behind the watermark are dropped by the
    engine; without it, it stays.
    """
    rows = _timed(stream, at, delay, ["run_id", "seq", "event_type"])
    return _stateful(rows, ["run_id"], _UntilTerminal(None if at is None else keep_ended), "run_id string, seq bigint, event_type string", "Append", at is not None, buckets)


def live_state(stream: DataFrame, at: str | None = None, delay: str = "1 day", keep_ended: int = KEEP_ENDED, buckets: int = BUCKETS) -> DataFrame:
    """State of each run as its events arrive, in any order: (run_id, status, last_seq, n_completed). Emits when a run moves on.

    Events that come early wait in the state until the ones before them are there; repeated events are ignored. With `at`, an
    event-time column, the state of a run in a terminal status goes `keep_ended` milliseconds after its newest event, and events
    that arrive behind the watermark are dropped by the engine; a retry before that reopens the run. Without it, states stay.
    """
    rows = _timed(stream, at, delay, ["run_id", "seq", "event_type"])
    return _stateful(rows, ["run_id"], _LiveState(None if at is None else keep_ended), "run_id string, status string, last_seq bigint, n_completed bigint", "Update", at is not None, buckets)


class _Expiry(StatefulProcessor):
    """An approval's expiry and whether it is decided. One timer: at the expiry while it is open, then `keep` after its newest event, when all goes."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("approval", "expiry bigint, latest bigint, timer bigint, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expiry, latest, timer, over = self.value.get() or (0, 0, 0, False)
        for f in rows:
            # a decision after the expiry comes too late
            for kind, at, until in zip(f["event_type"], _ms(f["occurred_at"]), f["expires_at"], strict=True):
                latest = max(latest, at)
                expiry = expiry if pd.isna(until) else max(expiry, int(until.timestamp() * 1000))
                over = over or kind in DECISIONS
        due = expiry if expiry and not over else max(expiry, latest + self.keep)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.value.update((expiry, latest, due, over))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.value.get()
        if not held or held[2] != expiredTimerInfo.getExpiryTimeInMs():
            return
        expiry, latest, timer, over = held
        gone = max(expiry, latest) + self.keep
        expires = not over and timer == expiry
        if expires:  # a tombstone against repeated events
            self.handle.registerTimer(gone)
            self.value.update((expiry, latest, gone, True))
        else:
            self.value.clear()
        if expires:
            yield pd.DataFrame({"approval_id": [key[0]], "expired_at": [pd.Timestamp(expiry, unit="ms")]})

    def close(self) -> None:
        pass


def expire(stream: DataFrame, keep_ended: int = KEEP_ENDED) -> DataFrame:
    """Rejections by the system of approvals that pass their expiry undecided: (approval_id, expired_at).

    stream: approval_id, event_type, occurred_at and expires_at (timestamps), with a watermark on occurred_at; the timer is the
    expiry in event time, so a decision that arrives before the watermark passes it still counts. An approval that is decided or
    expired leaves a tombstone for `keep_ended` milliseconds of event time, then its state goes.
    """
    rows = stream.select("approval_id", "event_type", "occurred_at", "expires_at")
    return _stateful(rows, ["approval_id"], _Expiry(keep_ended), "approval_id string, expired_at timestamp", "Append", True)


class _Leases(_Buckets):
    """Attempts with events that are not judged yet, and whether one before those settled it; the events are columns, by the attempt's place. An attempt is due `ttl` after the oldest of them: once the watermark is there, all events up to it have arrived."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.attempts = handle.getListState("attempt", "place bigint, run_id string, step_id string, attempt bigint, over boolean")
        self.events = handle.getListState("events", "place array<bigint>, seq array<bigint>, at array<bigint>, settled array<boolean>")

    def _load(self) -> tuple[dict, dict]:
        """Whether each attempt is over, and its events by seq."""
        over, names, events = {}, {}, {}
        for place, run, step, attempt, settled in self.attempts.get():
            names[place] = run, step, attempt
            over[names[place]], events[names[place]] = settled, {}
        for chunk in self.events.get():
            for place, seq, at, settled in zip(*chunk, strict=True):
                events[names[place]][seq] = at, settled
        return over, events

    def _save(self, over: dict, events: dict) -> None:
        self.put(self.attempts, [(i, *name, over[name]) for i, name in enumerate(events)])
        rows = [(i, seq, *e) for i, own in enumerate(events.values()) for seq, e in own.items()]
        self.put(self.events, _chunks([list(c) for c in zip(*rows, strict=True)]) if rows else [])
        self.arm(min((at for own in events.values() for at, _ in own.values()), default=-self.ttl) + self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        over, events = self._load()
        for f in rows:
            names = zip(*(f[c].tolist() for c in ("run_id", "step_id", "attempt")), strict=True)
            for name, seq, at, kind in zip(names, f["seq"].tolist(), _ms(f["at"]), f["event_type"].tolist(), strict=True):
                over.setdefault(name, False)
                events.setdefault(name, {})[seq] = at, kind in SETTLED
        self._save(over, events)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = self.fired(timerValues, expiredTimerInfo), []
        over, events = self._load()
        for name in list(events):
            own = sorted((at, seq, settled) for seq, (at, settled) in events[name].items())
            judged = 0
            while judged < len(own) and own[judged][0] + self.ttl <= now:
                at, seq, settled = own[judged]
                judged += 1
                over[name] = over[name] or settled
                heard = judged < len(own) and own[judged][0] <= at + self.ttl
                if not over[name] and not heard:
                    out.append((*name, seq, pd.Timestamp(at + self.ttl, unit="ms")))
            if judged == len(own):
                del events[name]
            else:
                for _, seq, _ in own[:judged]:
                    del events[name][seq]
        self._save(over, events)
        if out:
            yield pd.DataFrame(out, columns=["run_id", "step_id", "attempt", "last_seq", "lapsed_at"])


#: Events that end an attempt. Fixed values.
SETTLED = ("step.completed", "step.failed", "step.dead_lettered", "step.cancelled")


def stalled(stream: DataFrame, at: str, delay: str, ttl_seconds: float, buckets: int = BUCKETS) -> DataFrame:
    """Attempts that fall silent: (run_id, step_id, attempt, last_seq, lapsed_at), for each event of an unsettled attempt that nothing of the attempt follows within the time.

    Order of arrival does not matter within the watermark's delay: a settlement that arrives late but happened in time counts.
    An attempt's state is empty once the watermark has passed its last event by the time.
    """
    rows = stream.select("run_id", "step_id", "attempt", "seq", "event_type", F.col(at).cast("timestamp").alias("at")).withWatermark("at", delay)
    return _stateful(rows, ["run_id", "step_id", "attempt"], _Leases(int(ttl_seconds * 1000)), "run_id string, step_id string, attempt bigint, last_seq bigint, lapsed_at timestamp", "Append", True, buckets)


def deduplicate(stream: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, at: str, delay: str, length: str, slide: str | None, keys: list[str], value: str) -> DataFrame:
    w = F.window(at, length, slide) if slide else F.window(at, length)
    rows = stream.withWatermark(at, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, delay: str, gap: str, keys: list[str]) -> DataFrame:
    """Activity sessions: events of a key less than `gap` apart."""
    rows = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")


def decision_join(requests: DataFrame, decisions: DataFrame, delay: str, within: str) -> DataFrame:
    """Requests with their decision within a time, or nulls once that has passed. Inner columns: approval_id, requested_at / decided_at."""
    left = requests.withWatermark("requested_at", delay)
    right = decisions.withWatermark("decided_at", delay).withColumnRenamed("approval_id", "_id")
    on = F.expr(f"approval_id = _id and decided_at >= requested_at and decided_at <= requested_at + interval {within}")
    return left.join(right, on, "leftOuter").drop("_id").withColumn("wait_seconds", F.timestamp_diff("SECOND", F.col("requested_at"), F.col("decided_at")))


def throttle(reports: DataFrame, interval_seconds: float) -> DataFrame:
    """Progress reports kept greedily: one per step and interval; fraction clamped to 0..1, note cut at 200 characters.

    Which report is kept depends on the one kept before it, so a step's reports pass one by one, streamed in order: by time, then fraction and note.
    """
    ship(reports.sparkSession)

    def run(batches):
        now, last = None, None
        for b in batches:
            keep = []
            for key, at in zip(zip(b["run_id"], b["step_id"], strict=True), b["at"], strict=True):
                if key != now:
                    now, last = key, None
                ok = last is None or (at - last) >= interval_seconds
                last = at if ok else last
                keep.append(ok)
            yield b[keep]

    rows = reports.select("run_id", "step_id", "at", F.least(F.greatest("fraction", F.lit(0.0)), F.lit(1.0)).alias("fraction"), F.left("note", F.lit(200)).alias("note"))
    return rows.repartition("run_id", "step_id").sortWithinPartitions("run_id", "step_id", "at", "fraction", "note").mapInPandas(run, rows.schema)


def notices(stream: DataFrame) -> DataFrame:
    """Texts about approvals asked for and decided."""
    asked = F.format_string("Run %s waits for a human: step %s declares %s.", F.col("run_id"), F.col("step_id"), F.coalesce("effect_class", F.lit("an effect")))
    done = F.format_string("Step %s of run %s was %s by %s.", F.col("step_id"), F.col("run_id"), F.when(F.col("event_type") == "approval.granted", "approved").otherwise("rejected"), F.coalesce("principal_kind", F.lit("an unrecorded principal")))
    return stream.where(F.col("event_type").isin("approval.requested", "approval.granted", "approval.rejected")).select("run_id", "seq", F.when(F.col("event_type") == "approval.requested", asked).otherwise(done).alias("text"))


def new_arrivals(before: DataFrame | None, now: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the second reading that the first did not have; a first reading announces nothing."""
    return now.limit(0) if before is None else now.join(before.select(*key), key, "left_anti")


def backlog(moves: DataFrame, bucket: str = "DAY") -> DataFrame:
    """Depth at the end of each bucket. moves: at, step (+1 or -1); summed per bucket before the running sum."""
    per = moves.groupBy(F.date_trunc(bucket, "at").alias("bucket")).agg(F.sum("step").alias("change"))
    return per.withColumn("depth", F.expr("sum(change) over (order by bucket)"))
