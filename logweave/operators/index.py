"""Run index, listings, inbox and pages over the folded log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fold

#: Order in which statuses are shown. Fixed values.
SHOWN = ["suspended", "running", "paused", "pending", "failed", "cancelled", "completed"]


def index_rows(log: DataFrame) -> DataFrame:
    """Status, sorted pending approval ids, indexed seq and time of each run. Unknown events count only for seq and time."""
    pending = fold.approvals(log).where("approval_status = 'pending'").groupBy("run_id").agg(F.array_sort(F.collect_set("approval_id")).alias("pending"))
    rows = fold.status(log).join(pending, "run_id", "left")
    return rows.select("run_id", "status", F.coalesce("pending", F.array().cast("array<string>")).alias("pending"), F.col("last_seq").alias("indexed_seq"), F.col("last_at").alias("updated_at"))


def list_runs(rows: DataFrame, limit: int, statuses: list[str] | None = None, workflow: str | None = None, cursor: tuple | None = None) -> DataFrame:
    """Newest first by (created_at, run_id), after the cursor's key. Plans as a top-k, not a sort."""
    if statuses is not None:
        rows = rows.where(F.col("status").isin(statuses))
    if workflow is not None:
        rows = rows.where(F.col("workflow") == workflow)
    if cursor is not None:
        at, run_id = (F.lit(x) for x in cursor)
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("run_id") < run_id)))
    return rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def page(rows: DataFrame, limit: int, **options) -> DataFrame:
    """A page and whether it is the last: one row more than the limit is read and marked."""
    found = list_runs(rows, limit + 1, **options)
    place = F.expr("row_number() over (order by created_at desc, run_id desc)")  # at most limit + 1 rows
    return found.withColumn("place", place.cast("bigint")).withColumn("more", F.expr(f"max(place) over () > {limit}")).where(F.col("place") <= limit)


def status_counts(rows: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in SHOWN]), F.col("status"))
    return rows.where("status is not null").groupBy("status").agg(F.count("*").alias("runs")).withColumn("place", order)


def list_rows(folded: DataFrame, index: DataFrame, pending: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows whose index status is asked for and whose fold agrees, with their number of pending approvals."""
    chosen = index.where(F.col("status").isin(statuses)).select("run_id", F.col("status").alias("indexed_status"))
    n = pending.where("approval_status = 'pending'").groupBy("run_id").agg(F.count("*").alias("n_pending"))
    out = folded.join(chosen, "run_id").where("status = indexed_status").join(n, "run_id", "left")
    return out.select("run_id", "status", F.coalesce("n_pending", F.lit(0)).alias("n_pending"))


def needs_advance(rows: DataFrame, limit: int) -> DataFrame:
    return rows.where(F.col("status").isin("pending", "running")).orderBy("created_at", "run_id").limit(limit)


def inbox(approvals: DataFrame, states: DataFrame) -> DataFrame:
    """Pending approvals of suspended runs: oldest run first, then in the order of the requests."""
    waiting = states.where("status = 'suspended'").select("run_id", "created_at")
    return approvals.where("approval_status = 'pending'").join(waiting, "run_id").orderBy("created_at", "run_id", "requested_seq")


def drift(stored: DataFrame, folded: DataFrame) -> DataFrame:
    """Runs whose stored status differs from the fold; a missing row counts as different."""
    pair = folded.select("run_id", "status").join(stored.select("run_id", F.col("status").alias("stored_status")), "run_id", "left")
    return pair.where(~F.col("status").eqNullSafe(F.col("stored_status")))


def behind(stored: DataFrame, log: DataFrame) -> DataFrame:
    """Runs whose index row ends before their log, and how many events are to be read."""
    last = log.groupBy("run_id").agg(F.max("seq").alias("last_seq"))
    rows = last.join(stored, "run_id", "left")
    seen = F.coalesce("indexed_seq", F.lit(0))
    return rows.where(seen < F.col("last_seq")).select("run_id", seen.alias("indexed_seq"), "last_seq", (F.col("last_seq") - seen).alias("tail"))


def text_match(query: str, run_id: str = "run_id", workflow: str = "workflow") -> Column:
    q = query.strip().lower()
    return F.lower(run_id).startswith(q) | F.lower(workflow).contains(q)


def event_page(log: DataFrame, after: int, limit: int) -> DataFrame:
    """Per run: the events after a seq, at most `limit`, with the page's last seq and whether more follow."""
    rows = log.where(F.col("seq") > after).withColumn("_n", F.expr("row_number() over (partition by run_id order by seq)")).where(F.col("_n") <= limit + 1)
    rows = rows.withColumn("has_more", F.expr(f"max(_n) over (partition by run_id) > {limit}")).where(F.col("_n") <= limit)
    return rows.withColumn("page_last_seq", F.expr("max(seq) over (partition by run_id)")).drop("_n")


def merge_pages(held: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Each (run, seq) once; the later page wins."""
    both = held.withColumn("_p", F.lit(0)).unionByName(page_rows.withColumn("_p", F.lit(1)))
    cols = [c for c in held.columns if c not in ("run_id", "seq")]
    return both.groupBy("run_id", "seq").agg(F.max_by(F.struct(*cols), "_p").alias("r")).select("run_id", "seq", *[F.col(f"r.{c}").alias(c) for c in cols])


def approval_context(approvals: DataFrame, completed: DataFrame, attempts: DataFrame) -> DataFrame:
    """Of each approval: cost and completed steps before it was requested, and its step's attempts.

    Completions and requests of a run pass together, in seq order, under one running sum.
    """
    done = completed.select("run_id", "seq", "cost")
    own = ["approval_id", "step_id", "kind", "approval_status"]
    asked = approvals.select("run_id", F.col("requested_seq").alias("seq"), *own)
    before = "over (partition by run_id order by seq range between unbounded preceding and 1 preceding)"
    marks = done.unionByName(asked, allowMissingColumns=True).select(
        "run_id", *own, F.expr(f"coalesce(sum(cost) {before}, 0)").alias("cost_so_far"), F.expr(f"count(cost) {before}").alias("steps_done")
    )
    whole = marks.where("approval_id is not null").join(attempts.select("run_id", "step_id", "starts"), ["run_id", "step_id"], "left")
    return whole.select("run_id", *own, "cost_so_far", "steps_done", F.coalesce("starts", F.lit(0)).alias("starts"))
