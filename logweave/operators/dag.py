"""Workflow graphs and what runs made of them.

nodes: workflow, node, agent, depends_on (array). There may be very many workflows, so graph rules run workflow by workflow over
rows that are dealt by workflow and sorted: one shuffle, one workflow's nodes in memory. A workflow of more than IN_TASK nodes
is worked out by frontier joins instead, level by level.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.storage import cut

#: Nodes of a workflow that one task may hold.
IN_TASK = 200_000


def edges(nodes: DataFrame) -> DataFrame:
    """(workflow, dep, node): one row per declared dependency."""
    return nodes.select("workflow", F.explode("depends_on").alias("dep"), "node")


def dangling(nodes: DataFrame) -> DataFrame:
    """Dependencies on nodes that the workflow does not have."""
    known = nodes.select("workflow", F.col("node").alias("dep"))
    return edges(nodes).join(known, ["workflow", "dep"], "left_anti")


def _frontiers(nodes: DataFrame) -> DataFrame:
    """(workflow, node, level): every length of a path from a source to the node, with unknown and self dependencies left out. A path longer than its workflow has nodes is an error."""
    known = nodes.select("workflow", F.col("node").alias("dep"))
    links = cut(edges(nodes).where("dep <> node").join(known, ["workflow", "dep"], "left_semi").distinct())
    sources = nodes.select("workflow", "node").join(links.select("workflow", "node"), ["workflow", "node"], "left_anti")
    now = cut(sources.withColumn("level", F.lit(0).cast("bigint")))
    out = now
    level, most = 0, nodes.groupBy("workflow").count().agg(F.max("count")).first()[0] or 0
    while True:
        level += 1
        now = cut(now.withColumnRenamed("node", "dep").join(links, ["workflow", "dep"]).select("workflow", "node").distinct().withColumn("level", F.lit(level).cast("bigint")))
        if now.isEmpty():
            break
        if level >= most:
            raise ValueError("a workflow has a cycle behind a source")
        out = out.unionByName(now)
        if level % 32 == 0:
            out = cut(out)
    return out


def _in_rounds(deps: dict[str, set[str]]) -> dict[str, tuple[int, int]]:
    """Wave and place of each node that is ever ready. deps: each node with the known nodes it waits for.

    A round takes all nodes whose dependencies were placed in rounds before. Within it a node stands by its latest dependency's
    place, then by name; that is the order in which a first-in-first-out queue would have let them out.
    """
    users: dict[str, list[str]] = {}
    for n, wants in deps.items():
        for d in wants:
            users.setdefault(d, []).append(n)
    found: dict[str, tuple[int, int]] = {}
    wave, now = 0, [(0, n) for n, wants in deps.items() if not wants]
    while now:
        for _, n in sorted(now):
            found[n] = (wave, len(found) + 1)
        touched = {u for _, n in now for u in users.get(n, [])}
        now = [(max(found[d][1] for d in deps[u]), u) for u in touched if u not in found and all(d in found for d in deps[u])]
        wave += 1
    return found


def rounds(nodes: DataFrame, ignore_self: bool = False, strict: bool = False, unknown: bool = True) -> DataFrame:
    """(workflow, node, wave, place). Nodes on a cycle or behind one have neither; with `strict` they raise an error that names the first.

    Dependencies on unknown nodes are left out, or raise an error if `unknown` is not allowed.
    """
    ship(nodes.sparkSession)

    def flush(name, deps):
        lost = sorted((d, n) for n, wants in deps.items() for d in wants if d not in deps)
        if lost and not unknown:
            raise ValueError(f"workflow {name}: node {lost[0][1]} depends on unknown node {lost[0][0]}")
        known = {n: {d for d in wants if d in deps and not (ignore_self and d == n)} for n, wants in deps.items()}
        found = _in_rounds(known)
        stuck = sorted(n for n in known if n not in found)
        if stuck and strict:
            raise ValueError(f"workflow {name} has a cycle: node {stuck[0]} is never ready")
        return [*((name, n, *at) for n, at in found.items()), *((name, n, None, None) for n in stuck)]

    def frame(rows):
        # one for many workflows: a frame takes longer to make than a small workflow to order
        names, own, wave, place = zip(*rows, strict=True)
        return pd.DataFrame({"workflow": names, "node": own, "wave": pd.array(wave, dtype="Int64"), "place": pd.array(place, dtype="Int64")})

    def run(batches):
        name, deps, begun = None, {}, False
        for batch in batches:
            done = []
            for workflow, node, depends_on in zip(batch["workflow"], batch["node"], batch["depends_on"], strict=True):
                if begun and workflow != name:
                    done += flush(name, deps)
                    deps = {}
                name, begun = workflow, True
                deps.setdefault(node, set()).update(depends_on if depends_on is not None else ())
            if done:
                yield frame(done)
        if begun:
            yield frame(flush(name, deps))

    rows = nodes.select("workflow", "node", "depends_on").repartition("workflow").sortWithinPartitions("workflow")
    return rows.mapInPandas(run, f"workflow {nodes.schema['workflow'].dataType.simpleString()}, node string, wave bigint, place bigint")


def _by_size(nodes: DataFrame, in_task: int) -> tuple[DataFrame, DataFrame | None]:
    """Nodes of workflows that fit a task, and of those that do not (None if there are none)."""
    big = nodes.groupBy("workflow").agg(F.count("*").alias("_n")).where(F.col("_n") > in_task).select("workflow")
    big = cut(big)
    if big.isEmpty():
        return nodes, None
    return nodes.join(big, "workflow", "left_anti"), nodes.join(big, "workflow", "left_semi")


def waves(nodes: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """Longest path from a source to each node. Unknown and self dependencies are left out; a cycle raises an error."""
    small, large = _by_size(nodes, in_task)
    out = rounds(small, ignore_self=True, strict=True).select("workflow", "node", "wave")
    if large is None:
        return out
    return out.unionByName(_frontiers(large).groupBy("workflow", "node").agg(F.max("level").alias("wave")))


def cyclic(nodes: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(workflow, stuck): workflows with a cycle, and the first node that is never ready. Dangling dependencies are left out."""
    small, large = _by_size(nodes, in_task)
    left = rounds(small).where("place is null").select("workflow", "node")
    if large is not None:
        left = left.unionByName(_peeled(large))
    return left.groupBy("workflow").agg(F.min("node").alias("stuck"))


def _peeled(nodes: DataFrame) -> DataFrame:
    """What is left when nodes without open dependencies are peeled off until none goes."""
    known = nodes.select("workflow", F.col("node").alias("dep"))
    links = cut(edges(nodes).join(known, ["workflow", "dep"], "left_semi").distinct())
    left = cut(nodes.select("workflow", "node").distinct())
    size = left.count()
    while size:
        open_links = links.join(left.withColumnRenamed("node", "dep"), ["workflow", "dep"], "left_semi")
        left = cut(left.join(open_links.select("workflow", "node"), ["workflow", "node"], "left_semi"))
        n = left.count()
        if n == size:
            break
        size = n
    return left


def topological_order(nodes: DataFrame) -> DataFrame:
    """(workflow, place, node): first-in-first-out order, ties by name. A cycle or an unknown dependency raises an error with the node's name."""
    return rounds(nodes, strict=True, unknown=False).select("workflow", "place", "node")


def ready(nodes: DataFrame, done: DataFrame, retries: DataFrame, now: Column) -> DataFrame:
    """Nodes not done whose dependencies are all done and whose backoff is over. done: (workflow, node); retries: with retry_at."""
    finished = done.select("workflow", "node").distinct()
    unmet = edges(nodes).join(finished.withColumnRenamed("node", "dep"), ["workflow", "dep"], "left_anti").select("workflow", "node")
    waiting = retries.where(F.col("retry_at") > now).select("workflow", "node")
    rows = nodes.select("workflow", "node")
    for other in (finished, unmet, waiting):
        rows = rows.join(other, ["workflow", "node"], "left_anti")
    return rows


def node_states(nodes: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One of eight states per node. parts: completed, dead_lettered, failed, cancelled, awaiting_approval, retry_backoff and running, each (workflow, node); the first that holds decides."""
    out = nodes.select("workflow", "node")
    state = F.lit("pending")
    for name in reversed(["completed", "dead_lettered", "failed", "cancelled", "awaiting_approval", "retry_backoff", "running"]):
        out = out.join(parts[name].select("workflow", "node").distinct().withColumn(f"_{name}", F.lit(True)), ["workflow", "node"], "left")
        state = F.when(F.col(f"_{name}"), name).otherwise(state)
    return out.select("workflow", "node", state.alias("state"))


def parallelism(spans: DataFrame) -> DataFrame:
    """Most attempts of a run open at once: +1 at each start, -1 at each end, ends first at equal instants."""
    moves = spans.select("run_id", F.inline(F.array(F.struct(F.col("started_at").alias("t"), F.lit(1).alias("d")), F.struct(F.col("ended_at").alias("t"), F.lit(-1).alias("d")))))
    running = F.expr("sum(d) over (partition by run_id order by t, d rows between unbounded preceding and current row)")
    return moves.withColumn("n", running).groupBy("run_id").agg(F.max("n").cast("bigint").alias("peak"))


def observed_waves(spans: DataFrame) -> DataFrame:
    """Each attempt with the wave (from 1) that it ran in: attempts of a run whose times overlap, in a chain, are one wave. An attempt that starts as all before it end begins the next; one without an end is open."""
    order = "over (partition by run_id order by started_at, step_id, attempt"
    rows = spans.select("run_id", "step_id", "attempt", "started_at", F.coalesce("ended_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("_end"))
    rows = rows.withColumn("_before", F.expr(f"max(_end) {order} rows between unbounded preceding and 1 preceding)"))
    fresh = F.when(F.col("_before").isNull() | (F.col("_before") <= F.col("started_at")), 1).otherwise(0)
    rows = rows.withColumn("_fresh", fresh).withColumn("wave", F.expr(f"cast(sum(_fresh) {order}) as bigint)"))
    return rows.select("run_id", "step_id", "attempt", "wave")


def over_parallelism(spans: DataFrame, limits: DataFrame) -> DataFrame:
    """Runs in which more attempts were open at once than their definition allows. limits: run_id, max_parallelism; null: no limit."""
    return parallelism(spans).join(limits, "run_id").where("peak > max_parallelism")


def order_audit(links: DataFrame, log: DataFrame) -> DataFrame:
    """Starts that come before a dependency's completion, or without one. links: (run_id, dep, node)."""
    starts = log.where("event_type = 'step.started'").groupBy("run_id", F.col("step_id").alias("node")).agg(F.min("seq").alias("start_seq"))
    done = log.where("event_type = 'step.completed'").groupBy("run_id", F.col("step_id").alias("dep")).agg(F.min("seq").alias("done_seq"))
    rows = links.join(starts, ["run_id", "node"]).join(done, ["run_id", "dep"], "left")
    return rows.where("done_seq is null or done_seq > start_seq")


def version_mismatch(pinned: DataFrame, definitions: DataFrame) -> DataFrame:
    return pinned.join(definitions, "workflow").where("pinned_version <> version")


def resolve_pins(pins: DataFrame, versions: DataFrame) -> DataFrame:
    """Version each pin means: the pinned one if above zero, else the latest; null if there is no such version."""
    latest = versions.groupBy("agent").agg(F.max("version").alias("_latest"))
    rows = pins.join(latest, "agent", "left").withColumn("_want", F.when(F.col("pinned") > 0, F.col("pinned")).otherwise(F.col("_latest")))
    have = versions.select("agent", F.col("version").alias("_want"), F.col("version").alias("resolved")).distinct()
    return rows.join(have, ["agent", "_want"], "left").select(*pins.columns, "resolved")


def detected_substitutions(completed: DataFrame) -> DataFrame:
    """Completions on another model than the agent's completion before, within the run."""
    before = F.expr("lag(model_id) over (partition by run_id, agent order by seq)")
    return completed.withColumn("from_model", before).where("from_model <> model_id")


def backoff_seconds(attempt: Column, first: float, factor: float, most: float) -> Column:
    """Wait before an attempt: none before the first, then growing up to `most`."""
    return F.when(attempt <= 1, F.lit(0.0)).otherwise(F.least(F.lit(most), F.lit(first) * F.pow(F.lit(factor), attempt - 2)))


def retry_storms(log: DataFrame, limit: int) -> DataFrame:
    """Steps with the most starts."""
    counts = log.where("event_type = 'step.started'").groupBy("run_id", "step_id").agg(F.count("*").alias("starts"), F.max("attempt").alias("attempt"))
    return counts.orderBy(F.desc("starts"), "run_id", "step_id").limit(limit)


def completed_twice(log: DataFrame) -> DataFrame:
    return log.where("event_type = 'step.completed'").groupBy("run_id", "step_id").agg(F.count("*").alias("n")).where("n > 1")


def idempotency_keys(inputs: DataFrame) -> DataFrame:
    """run:step:sha256 of the canonical inputs; inputs is a map of name to JSON text, written with sorted keys and no blanks."""

    @F.pandas_udf("string")
    def digest(names: pd.Series, values: pd.Series) -> pd.Series:
        def one(ks, vs):
            return hashlib.sha256(("{" + ",".join(f'"{k}":{v}' for k, v in sorted(zip(ks, vs, strict=True))) + "}").encode()).hexdigest()

        return pd.Series([one(k, v) for k, v in zip(names, values, strict=True)])

    return inputs.select("run_id", "step_id", F.concat_ws(":", "run_id", "step_id", digest(F.map_keys("inputs"), F.map_values("inputs"))).alias("idempotency_key"))


def lineage(runs: DataFrame) -> DataFrame:
    """(run_id, root, depth) by pointer doubling over parent_run_id, until no run moves; a parent that is not in the table makes a root. A cycle of parents raises an error."""
    known = runs.select(F.col("run_id").alias("parent"), F.lit(True).alias("_in"))
    base = runs.select("run_id", F.col("parent_run_id").alias("parent")).join(known, "parent", "left")
    now = cut(base.select("run_id", F.when(F.col("_in"), F.col("parent")).otherwise(F.col("run_id")).alias("up"), F.when(F.col("_in"), 1).otherwise(0).cast("bigint").alias("depth")))
    reach, most = 1, now.count()
    while True:
        nxt = now.select(F.col("run_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        step = cut(now.join(nxt, "up").select("run_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("_d") > 0).alias("_moved")))
        now = step.drop("_moved")
        moved = step.where("_moved")
        if moved.isEmpty():
            return now.select("run_id", F.col("up").alias("root"), "depth")
        reach *= 2
        if reach > 2 * most:
            raise ValueError(f"run {moved.agg(F.min('run_id')).first()[0]} is its own ancestor, or descends from one")


def subtree_totals(runs: DataFrame, values: list[str]) -> DataFrame:
    """(run_id, n_runs, and the sum of each value) of each run and all runs below it. runs: run_id (unique), parent_run_id, values.

    Partial sums jump with the pointers: after k rounds a run holds the sums of everything less than 2^k below it, and points to
    its ancestor exactly 2^k above; each round adds a run's sums to the one it points to. A tree of depth d takes log2(d) rounds of
    aggregates that are as large as the table, whatever its number of ancestor pairs. A parent that is not in the table makes a
    root, a null value counts as none, a cycle of parents raises an error.
    """
    known = runs.select(F.col("run_id").alias("up"))
    base = runs.select("run_id", F.col("parent_run_id").alias("up"), F.lit(1).cast("bigint").alias("n_runs"), *values)
    roots = base.join(known, "up", "left_anti").withColumn("up", F.lit(None).cast("string")).select("run_id", "up", "n_runs", *values)
    now = cut(base.join(known, "up", "left_semi").select("run_id", "up", "n_runs", *values).unionByName(roots))
    sums = ["n_runs", *values]
    kinds = dict(now.dtypes)
    reach, most = 1, now.count()
    while not now.where("up is not null").isEmpty():
        if reach > 2 * most:
            raise ValueError(f"run {now.where('up is not null').agg(F.min('run_id')).first()[0]} is its own ancestor, or descends from one")
        below = now.where("up is not null").groupBy(F.col("up").alias("run_id")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        above = now.where("up is not null").select(F.col("run_id").alias("up"), F.col("up").alias("_up"))
        total = [F.coalesce(F.col(c) + F.col(f"_{c}"), F.col(c), F.col(f"_{c}")).cast(kinds[c]).alias(c) for c in sums]
        now = cut(now.join(below, "run_id", "left").join(above, "up", "left").select("run_id", F.col("_up").alias("up"), *total))
        reach *= 2
    return now.drop("up")


def step_inputs(links: DataFrame, outputs: DataFrame, run_inputs: DataFrame) -> DataFrame:
    """Inputs of a step: outputs of its dependencies by name, and the run's own under run. Output and input are JSON text."""
    own = links.join(outputs.withColumnRenamed("step_id", "dep"), ["run_id", "dep"]).select("run_id", F.col("node").alias("step_id"), F.col("dep").alias("name"), "output")
    whole = links.select("run_id", F.col("node").alias("step_id")).distinct().join(run_inputs, "run_id").select("run_id", "step_id", F.lit("run").alias("name"), "output")
    return own.unionByName(whole).groupBy("run_id", "step_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "output")))).alias("inputs"))


def failing_wave(log: DataFrame) -> DataFrame:
    """First dead letter of each failed run, and how many siblings completed between it and the failure."""
    dead = log.where("event_type = 'step.dead_lettered'").groupBy("run_id").agg(F.min_by(F.struct("seq", "step_id"), "seq").alias("d"))
    failed = log.where("event_type = 'run.failed'").groupBy("run_id").agg(F.min("seq").alias("failed_seq"))
    rows = dead.join(failed, "run_id").select("run_id", F.col("d.step_id").alias("step_id"), F.col("d.seq").alias("dead_seq"), "failed_seq")
    done = log.where("event_type = 'step.completed'").select("run_id", F.col("seq").alias("_s"))
    return rows.join(done, "run_id", "left").groupBy("run_id", "step_id", "dead_seq", "failed_seq").agg(F.count(F.when(F.col("_s").between(F.col("dead_seq"), F.col("failed_seq")), 1)).alias("survivors"))
