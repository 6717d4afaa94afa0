"""Reading, checking, appending, exporting and archiving logs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KNOWN_VERSION = 1


def read_events(log: DataFrame, after: int = 0, limit: int | None = None) -> DataFrame:
    """Events of each run after a seq, at most `limit` of them, numbered from there."""
    rows = log.where(F.col("seq") > after)
    if limit is None:
        return rows
    return rows.withColumn("_n", F.expr("row_number() over (partition by run_id order by seq)")).where(F.col("_n") <= limit).drop("_n")


def decode(records: DataFrame, schema: T.StructType | str, defaults: dict[str, object] | None = None, column: str = "record") -> DataFrame:
    """Typed columns of JSON records; missing fields take their defaults. A record that is no JSON gives nulls."""
    rows = records.withColumn("_r", F.from_json(column, schema)).select(*[c for c in records.columns if c != column], "_r.*")
    return rows.fillna(defaults) if defaults else rows


def upcast(rows: DataFrame, steps: list[tuple[str, int, Callable[[DataFrame, Column], DataFrame]]]) -> DataFrame:
    """Apply version steps N to N+1 in order; each is (event type, version, function of the rows and the condition)."""
    for kind, version, change in steps:
        here = (F.col("event_type") == kind) & (F.col("schema_version") == version)
        rows = change(rows.withColumn("_up", here), F.col("_up")).withColumn("schema_version", F.when(F.col("_up"), F.col("schema_version") + 1).otherwise(F.col("schema_version"))).drop("_up")
    return rows


def quarantine(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): refused are unknown event types and versions newer than known, with the reason."""
    marked = rows.join(known.select(F.col("event_type"), F.lit(True).alias("_known")), "event_type", "left")
    reason = F.when(F.col("_known").isNull(), "unknown event type").when(F.col("schema_version") > KNOWN_VERSION, "newer version")
    marked = marked.withColumn("reason", reason).drop("_known")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def append(log: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(appended events, conflicts) of a batch: run_id, expected_seq, fence (nullable), place, payload columns.

    All or nothing per run: a stale fence, or an expected seq that is not the log's last, refuses all of the run's events.
    log: run_id, seq, fence.
    """
    heads = log.groupBy("run_id").agg(F.max("seq").alias("_last"), F.max("fence").alias("_fence"))
    rows = batch.join(heads, "run_id", "left")
    reason = F.when(F.col("fence") < F.coalesce("_fence", F.lit(0)), "stale fence").when(F.col("expected_seq") != F.coalesce("_last", F.lit(0)), "expected seq")
    rows = rows.withColumn("reason", reason)
    place = F.expr("cast(row_number() over (partition by run_id order by place) as bigint)")
    good = rows.where("reason is null").withColumn("seq", F.col("expected_seq") + place).drop("reason", "_last", "_fence", "expected_seq", "place")
    return good, rows.where("reason is not null").groupBy("run_id", "reason").agg(F.count("*").alias("events"))


def first_per_request(starts: DataFrame) -> DataFrame:
    """The one run that a request id started: the earliest, then the smallest run id. Null request ids each start their own."""
    key = F.coalesce("request_id", F.concat(F.lit("run:"), F.col("run_id")))
    first = F.min(F.struct("occurred_at", "run_id"))
    return starts.groupBy(key.alias("k")).agg(first.alias("f"), F.count("*").alias("attempts"), F.max("request_id").alias("request_id")).select("request_id", F.col("f.run_id").alias("run_id"), "attempts")


def put_definitions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """insert, noop or conflict for each incoming (name, version, body)."""
    old = stored.select("name", "version", F.sha2("body", 256).alias("_old"))
    rows = incoming.join(old, ["name", "version"], "left")
    result = F.when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.sha2("body", 256), "noop").otherwise("conflict")
    return rows.select("name", "version", result.alias("result"))


def latest_definitions(definitions: DataFrame) -> DataFrame:
    return definitions.groupBy("name").agg(F.max("version").alias("version"), F.max_by("body", "version").alias("body"), F.array_sort(F.collect_set("version")).alias("versions"))


def put_blobs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New content-addressed blobs of a batch (binary data), each once."""
    fresh = incoming.select(F.sha2("data", 256).alias("sha256"), F.length("data").cast("bigint").alias("size"), "data").dropDuplicates(["sha256"])
    return fresh.join(stored.select("sha256"), "sha256", "left_anti")


EXPORT_KIND, EXPORT_VERSION = "run-export", 1


def _json(columns: dict[str, Column]) -> Column:
    """JSON text with sorted keys and without nulls."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))


def _exact(field: T.StructField) -> Column:
    """A column as it can be read back exactly: decimals as text, times with microseconds."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DecimalType):
        return c.cast("string")
    if isinstance(field.dataType, T.TimestampNTZType | T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.base64(c) if isinstance(field.dataType, T.BinaryType) else c


def export_lines(log: DataFrame, blobs: DataFrame | None = None, states: DataFrame | None = None, chain: DataFrame | None = None, exported_at: str | None = None) -> DataFrame:
    """(run_id, section, seq, line): header, events, blobs and a summary of each run, as JSON lines in that order.

    An event line holds every column of the log that is not null. blobs: (run_id, seq, sha256, data), null data marks a missing
    one; states: (run_id, status, total_cost, error) of the fold; chain: what integrity.chain_state gives.
    """
    rows = log.withColumns({"_at": F.expr("row_number() over (partition by run_id order by seq)"), "_n": F.expr("count(*) over (partition by run_id)")})
    own = {"kind": F.lit(EXPORT_KIND), "version": F.lit(EXPORT_VERSION), "run_id": F.col("run_id"), "exported_at": F.lit(exported_at)}
    if chain is not None:
        rows = rows.join(chain.select("run_id", F.struct("verified", "sealed_through", F.col("state").alias("seals"), "error").alias("_chain")), "run_id", "left")
        own |= {"chain": F.col("_chain")}
    end = {"kind": F.lit("summary"), "run_id": F.col("run_id"), "events": F.col("_n")}
    if states is not None:
        rows = rows.join(states.select("run_id", F.col("status").alias("_status"), F.col("total_cost").cast("string").alias("_cost"), F.col("error").alias("_error")), "run_id", "left")
        end |= {"status": F.col("_status"), "cost": F.col("_cost"), "error": F.col("_error")}

    def item(section: int, seq: Column, line: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), seq.alias("seq"), line.alias("line"))

    # one pass: a run's first event brings its header along, its last one the summary
    header = F.when(F.col("_at") == 1, item(0, F.lit(0).cast("bigint"), _json(own)))
    event = item(1, F.col("seq"), _json({f.name: _exact(f) for f in log.schema}))
    summary = F.when(F.col("_at") == F.col("_n"), item(3, F.lit(0).cast("bigint"), _json(end)))
    # what an event does not bring comes out null: an array without its nulls would be made twice, for a filter on its size
    out = rows.select("run_id", F.inline(F.array(header, event, summary))).where("section is not null")
    if blobs is not None:
        line = _json({"kind": F.lit("blob"), "sha256": F.col("sha256"), "bytes_b64": F.base64("data"), "missing": F.when(F.col("data").isNull(), True)})
        out = out.unionByName(blobs.select("run_id", F.lit(2).alias("section"), "seq", line.alias("line")))
    return out


def events_from(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The log that export lines hold, with the given columns."""
    plain = T.StructType([T.StructField(f.name, f.dataType if not isinstance(f.dataType, T.DecimalType | T.TimestampNTZType | T.TimestampType | T.BinaryType) else T.StringType()) for f in schema])
    rows = classify(lines).where("kind = 'event'").select(F.from_json("line", plain).alias("r")).select("r.*")

    def back(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampNTZType | T.TimestampType):
            c = F.to_timestamp_ntz(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        elif isinstance(f.dataType, T.BinaryType):
            c = F.unbase64(c)
        return c.cast(f.dataType).alias(f.name)

    return rows.select(*[back(f) for f in schema])


def blobs_from(lines: DataFrame) -> DataFrame:
    """(sha256, data) of the blob lines, each blob once; data is null where it was missing."""
    rows = classify(lines).where("kind = 'blob'").select(F.from_json("line", "sha256 string, bytes_b64 string").alias("r"))
    return rows.groupBy("r.sha256").agg(F.unbase64(F.max("r.bytes_b64")).alias("data"))


def write_export(lines: DataFrame, path: str) -> None:
    """Text files with whole runs, in order within each."""
    lines.repartition("run_id").sortWithinPartitions("run_id", "section", "seq").select("line").write.mode("overwrite").text(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return classify(spark.read.text(path).withColumnRenamed("value", "line"))


def classify(lines: DataFrame) -> DataFrame:
    """Kind of each export line: event if it has an event type, else its own kind."""
    return _read(lines, {}).drop("_event", "_kind")


def _read(lines: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Lines with their kind and some fields (column: name, type); each line is parsed once, without building its values. A field that is not of its type is null; of a repeated one the last counts."""
    wanted = {"_event": ("event_type", "string"), "_kind": ("kind", "string")} | fields
    rows = lines.select("*", F.json_tuple("line", *[n for n, _ in wanted.values()]).alias(*wanted))
    rows = rows.select(*lines.columns, *[F.col(c).try_cast(t).alias(c) for c, (_, t) in wanted.items()])
    return rows.withColumn("kind", F.when(F.col("_event").isNotNull(), "event").otherwise(F.col("_kind")))


def export_check(lines: DataFrame) -> DataFrame:
    """Per run: its header names it, event lines are seq 1..n, the summary agrees."""
    rows = _read(lines, {"_seq": ("seq", "bigint"), "_run": ("run_id", "string"), "_n": ("events", "bigint")})
    event = F.col("kind") == "event"
    # the greatest id that a header names must be the run's; as counts, since a greatest text is no hash aggregate
    header = F.col("kind") == EXPORT_KIND
    out = rows.groupBy("run_id").agg(
        F.count(F.when(event, 1)).alias("events"), F.count_distinct(F.when(event, F.col("_seq"))).alias("distinct_seqs"), F.min(F.when(event, F.col("_seq"))).alias("low"), F.max(F.when(event, F.col("_seq"))).alias("high"),
        F.count(F.when(header & (F.col("_run") == F.col("run_id")), 1)).alias("named"), F.count(F.when(header & (F.col("_run") > F.col("run_id")), 1)).alias("beyond"),
        F.count(F.when(header & F.col("_run").isNotNull(), 1)).alias("headers"), F.max(F.when(F.col("kind") == "summary", F.col("_n"))).alias("said"),
    )
    nameless = F.col("run_id").isNull() & (F.col("headers") == 0)
    problem = (
        F.when(~(((F.col("named") > 0) & (F.col("beyond") == 0)) | nameless), "header")
        .when((F.col("events") > 0) & ((F.col("low") != 1) | (F.col("high") != F.col("events")) | (F.col("distinct_seqs") != F.col("events"))), "event lines")
        .when(~F.col("said").eqNullSafe(F.col("events")), "summary")
    )
    return out.select("run_id", "events", problem.alias("problem"))


def archive_selection(folded: DataFrame, index: DataFrame, cutoff: Column, selected: list[str]) -> DataFrame:
    """Each run with the reason the archive skips it, or null. folded: run_id, status; index: run_id, status, updated_at."""
    from ..operators.fold import TERMINAL

    rows = folded.select("run_id", F.col("status").alias("fold_status")).join(index.select("run_id", F.col("status").alias("index_status"), "updated_at"), "run_id", "left")
    reason = (
        F.when(F.col("index_status").isNull(), "unindexed")
        .when(~F.col("index_status").isin(TERMINAL), "non-terminal")
        .when(~F.col("index_status").isin(selected), "status not selected")
        .when(F.col("updated_at").isNull() | (F.col("updated_at") >= cutoff), "too recent")
        .when(F.col("fold_status") != F.col("index_status"), "index drift")
    )
    return rows.select("run_id", reason.alias("reason"))


def purgeable(selection: DataFrame, checks: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """(run_id) of the runs that may leave the log: selected, their export read back without a problem, their chain verified where it is given."""
    runs = selection.where("reason is null").select("run_id").join(checks.where("problem is null").select("run_id"), "run_id", "left_semi")
    return runs if chain is None else runs.join(chain.where("verified").select("run_id"), "run_id", "left_semi")


def retained(log: DataFrame, purged: DataFrame) -> DataFrame:
    """The live log after archiving: a new table without the runs of purgeable()."""
    return log.join(purged.select("run_id"), "run_id", "left_anti")


def manifest(lines: DataFrame, dealt: bool = False) -> DataFrame:
    """Per archived run: lines, events, bytes with line ends and the digest of its file.

    A run's lines pass in their order, one batch after the other; none is held. dealt: each run lies in one partition already.
    """
    names = ["run_id", "lines", "events", "bytes", "sha256"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        now, digest, counts = None, None, [0, 0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            done = []
            runs = batch.column(0).dictionary_encode(null_encoding="encode")
            code, of = runs.indices.to_numpy(zero_copy_only=False), runs.dictionary.to_pylist()
            is_event = batch.column(1).to_numpy(zero_copy_only=False) == 1
            text = batch.column(2).cast(pa.large_binary())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = memoryview(text.buffers()[2])
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            for i, j in zip(cuts, cuts[1:]):
                run_id = of[code[i]]
                if run_id != now or digest is None:
                    if digest is not None:
                        done.append((now, *counts, digest.hexdigest()))
                    now, digest, counts = run_id, hashlib.sha256(), [0, 0, 0]
                digest.update(data[ends[i] : ends[j]])
                counts = [counts[0] + j - i, counts[1] + int(is_event[i:j].sum()), counts[2] + int(ends[j] - ends[i])]
            yield rows_of(done)
        if digest is not None:
            yield rows_of([(now, *counts, digest.hexdigest())])

    def rows_of(done):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)

    rows = lines if dealt else lines.repartition("run_id")
    rows = rows.sortWithinPartitions("run_id", "section", "seq").select("run_id", "section", F.concat("line", F.lit("\n")).alias("line"))
    return rows.mapInArrow(run, "run_id string, lines bigint, events bigint, bytes bigint, sha256 string")


def unreferenced(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Blobs that no remaining run names."""
    return candidates.join(references.select("sha256").distinct(), "sha256", "left_anti")
