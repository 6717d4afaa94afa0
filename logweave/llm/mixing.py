"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source's mean repetition rate is its share of the token budget over its own size. Each document draws its count by
inverting the Poisson distribution of that rate at a uniform number hashed from its id and the seed; documents are then
exploded by their counts and dealt to partitions by a hash of (id, copy, seed), sorted by a second hash within each: a global
shuffle that samples nothing and whose keys are uniform whatever the sizes of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, masked

#: Steps of all sources together that may be broadcast: 4 million doubles, 32 MB.
MAX_STEPS = 4_000_000
SPAN = float(1 << 52)


def hashed_uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from 52 bits of an MD5 digest; nulls count as empty strings."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(SPAN)


def source_rates(docs: DataFrame, source_col: str, size: Column, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate). weights: target share of each named source, others zero; without weights, shares go as size to the power alpha.

    The budget is `epochs` times the size of the whole table. Sources that hold only empty texts count as one unit long.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.greatest(F.sum(size), F.lit(1)).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        sizes = sizes.withColumn("weight", F.coalesce(given[F.col("source")].cast("double"), F.lit(0.0)))
    sizes = cut(sizes)
    all_size, all_weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(max(all_weight or 0.0, 1e-300))
    return sizes.select("source", (share * F.lit(float(epochs)) * F.lit(float(all_size or 0.0)) / F.col("size")).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(_source, _steps) of (source, rate): cumulative Poisson probabilities of 0, 1, 2, ... as far as doubles tell them from 1.

    Logarithms and probabilities are running sums over exploded steps, so the work is linear in the rate.
    """
    last = F.when(F.col("rate") > 0, F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")).otherwise(0)
    so_far = Window.partitionBy("source").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("j"))
    log_p = -F.col("rate") + F.sum(F.when(F.col("j") == 0, 0.0).otherwise(F.ln(F.col("rate") / F.col("j")))).over(so_far)
    c = F.when(F.col("rate") > 0, F.sum(F.exp("log_p")).over(so_far)).otherwise(1.0)
    steps = each.withColumn("log_p", log_p).select("source", F.struct("j", c.alias("c")).alias("step"))
    return steps.groupBy(F.col("source").alias("_source")).agg(F.array_sort(F.collect_list("step"))["c"].alias("_steps"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, each as often as its Poisson count says, in a shuffled order; adds copy (0, 1, ...) and n_copies.

    Size is counted in characters of whole texts; null text counts as empty. A null source is a source of its own, and a null
    id hashes as an empty one. Repeated rows draw the same count. An empty table gives no rows. Columns come back as they are,
    whatever their names; if the input has a copy or n_copies itself, the added one gets an underscore more.
    """
    rows, names, of = masked(docs)
    drawn = drawn_copies(rows, of[id_col], of[source_col], of[text_col], weights, alpha, epochs, seed)
    added = ["n_copies", "copy"]
    for i in range(2):
        while added[i] in docs.columns:
            added[i] += "_"
    return drawn.toDF(*docs.columns, *added)


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """mix() without the added columns; its rules on nulls, repeated rows and empty tables hold."""
    mixed = mix(docs, **options)
    names = [f"_col{i}" for i in range(len(mixed.columns))]
    return mixed.toDF(*names).select(*names[: len(docs.columns)]).toDF(*docs.columns)


def drawn_copies(rows: DataFrame, id_col: str, source_col: str, text_col: str, weights: dict[str, float] | None, alpha: float, epochs: float, seed: int) -> DataFrame:
    """mix() over rows whose names are free of those used here."""
    columns = rows.columns
    rates = cut(source_rates(rows, source_col, F.coalesce(F.length(text_col), F.lit(0)), weights, alpha, epochs))
    steps = poisson_steps(rates)
    bound = rates.agg(F.sum(F.col("rate") + 12 * F.sqrt("rate") + 26)).first()[0] or 0
    if bound <= MAX_STEPS:  # beyond it, a shuffled join that adaptive execution may split
        steps = F.broadcast(steps)
    u = hashed_uniform(F.lit(f"count:{seed}"), F.col(id_col))
    drawn = rows.withColumn("_u", u).join(steps, F.col(source_col).eqNullSafe(F.col("_source")))
    n = F.size(F.filter("_steps", lambda s: s <= F.col("_u"))).cast("bigint")
    drawn = drawn.withColumn("n_copies", n).where("n_copies > 0")
    each = drawn.select(*columns, "n_copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_copies") - 1)).alias("copy"))
    return shuffled(each, F.lit(f"order:{seed}"), F.col(id_col), F.col("copy"))


def shuffled(df: DataFrame, *key: Column) -> DataFrame:
    """Rows dealt to partitions and sorted within them by two hashes of the key."""
    columns = df.columns
    keyed = df.withColumn("_k", F.xxhash64(F.lit("deal"), *key)).withColumn("_o", F.xxhash64(F.lit("sort"), *key))
    return keyed.repartition("_k").sortWithinPartitions("_o").select(*[F.col(f"`{c}`") for c in columns])
