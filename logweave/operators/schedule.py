"""Schedules expanded over calendars, missed slots and delivery logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cron
from ..functions.hashing import hmac_hex

SCHEME = "v1"
#: Schedules of a task, where each is expanded to its days.
SCHEDULES = 10_000


def parse(schedules: DataFrame) -> DataFrame:
    """Schedules (name, expr) with a sorted array of values per field."""
    names = ["minutes", "hours", "doms", "months", "dows"]
    rows = schedules.select("*", *[cron.field(F.col("expr"), i).alias(n) for i, n in enumerate(names)])
    return rows.withColumn("dom_star", cron.star(F.col("expr"), 2)).withColumn("dow_star", cron.star(F.col("expr"), 4))


def firing_days(parsed: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row per schedule and day on which it fires; days are a sequence, filtered before any minute is made."""
    days = parsed.withColumn("day", F.explode(F.sequence(first.cast("date"), last.cast("date"))))
    ok = F.array_contains("months", F.month("day")) & cron.day_matches(F.col("day"), F.col("doms"), F.col("dows"), F.col("dom_star"), F.col("dow_star"))
    return days.where(ok)


def slots(parsed: DataFrame, first: Column, last: Column) -> DataFrame:
    """(name, slot): local wall-clock minutes of every firing in the days from first to last."""
    times = firing_days(parsed, first, last).select("name", "day", F.explode("hours").alias("h"), "minutes").select("name", "day", "h", F.explode("minutes").alias("m"))
    return times.select("name", F.expr("cast(day as timestamp_ntz) + make_dt_interval(0, h, m, 0)").alias("slot"))


def next_fire(parsed: DataFrame, after: Column, days: int = 366 * 8 + 2) -> DataFrame:
    """First slot strictly after an instant. Each firing day gives one time: the first day the earliest still to come, any later one its earliest.

    Schedules are dealt by name, some SCHEDULES to a task, before their days are rows; these pass one hash aggregate and none is held.
    """
    start = after.cast("date")
    n = max(-(-parsed.count() // SCHEDULES), parsed.sparkSession.sparkContext.defaultParallelism)
    times = F.flatten(F.transform("hours", lambda h: F.transform("minutes", lambda m: h * 60 + m)))
    todays = F.transform(times, lambda t: start.cast("timestamp_ntz") + F.make_dt_interval(mins=t))
    own = parsed.repartition(n, "name").withColumn("_least", F.array_min(times)).withColumn("_left", F.array_min(F.filter(todays, lambda t: t > after)))
    table = firing_days(own, start, F.date_add(start, days))
    slot = F.when(F.col("day") > start, F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("_least"))).otherwise(F.col("_left"))
    return table.groupBy("name").agg(F.min(slot).alias("next_slot")).where("next_slot is not null")


def next_fire_zones(parsed: DataFrame, after: Column, days: int = 366 * 8 + 2) -> DataFrame:
    """(name, zone, slot, next_utc, key) of each schedule's first slot after an instant, in the schedule's own zone (column `zone`).

    after: the instant in UTC, without a zone. A schedule reads the wall clock of its zone: the slot is the first that is later
    than the wall time of the instant, to the minute. A wall time that a change of clocks skips fires at the instant it would
    have had before the change; one that comes twice fires once, the first time. The key carries the slot's offset from UTC.
    """
    own = parsed.withColumn("_after", F.date_trunc("minute", F.convert_timezone(F.lit("UTC"), F.col("zone"), after.cast("timestamp_ntz"))).cast("timestamp_ntz"))
    start = F.col("_after").cast("date")
    table = firing_days(own, start, F.date_add(start, days))
    # of the days after the first only the first firing one counts
    near = table.groupBy("name", "zone", "_after", "hours", "minutes").agg(F.min(F.when(F.col("day") > start, F.col("day"))).alias("later"), F.max(F.col("day") == start).alias("today"))
    day = F.explode(F.array_compact(F.array(F.when(F.col("today"), start), F.col("later"))))
    times = near.select("name", "zone", "_after", "hours", "minutes", day.alias("day")).select("name", "zone", "_after", "day", "minutes", F.explode("hours").alias("h")).select("name", "zone", "_after", "day", "h", F.explode("minutes").alias("m"))
    slot = times.withColumn("slot", F.expr("cast(day as timestamp_ntz) + make_dt_interval(0, h, m, 0)")).where(F.col("slot") > F.col("_after"))
    first = slot.groupBy("name", "zone").agg(F.min("slot").alias("slot"))
    utc = F.convert_timezone(F.col("zone"), F.lit("UTC"), F.col("slot"))
    out = first.withColumn("next_utc", utc)
    minutes = F.timestamp_diff("MINUTE", F.col("next_utc"), F.col("slot"))
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60))
    return out.withColumn("key", F.concat(F.lit("cron:"), F.col("name"), F.lit(":"), F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss"), offset))


def slot_key(name: Column, slot: Column, offset: str) -> Column:
    return F.concat(F.lit("cron:"), name, F.lit(":"), F.date_format(slot, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def missed(slot_rows: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Slots without a run whose successor is already past. runs: slot keys started; slot_rows: (name, slot, key)."""
    rows = slot_rows.withColumn("next_slot", F.expr("lead(slot) over (partition by name order by slot)"))
    return rows.where(F.col("next_slot") <= now).join(runs.select("key"), "key", "left_anti").select("name", "slot", "key")


def never_firing(parsed: DataFrame, first: Column, days: int = 366 * 8 + 2) -> DataFrame:
    """Schedules without a firing day in eight years."""
    fires = firing_days(parsed, first, F.date_add(first.cast("date"), days)).select("name").distinct()
    return parsed.select("name", "expr").join(fires, "name", "left_anti")


def verify_deliveries(deliveries: DataFrame, secrets: DataFrame, tolerance: int = 300) -> DataFrame:
    """ok per delivery: timestamp readable and near `received`, scheme known, HMAC over the length-prefixed message.

    deliveries: name, delivery (nullable), stamp (text), body, signature, received (epoch seconds); secrets: name, secret.
    """
    rows = deliveries.join(secrets, "name", "left")
    stamp = F.expr("try_cast(stamp as bigint)")
    d = F.coalesce("delivery", F.lit(""))
    message = F.concat(stamp.cast("string"), F.lit("."), F.octet_length(d).cast("string"), F.lit("."), d, F.lit("."), F.col("body"))
    scheme, digest = F.substring_index("signature", "=", 1), F.expr("substr(signature, instr(signature, '=') + 1)")
    ok = stamp.isNotNull() & (F.abs(F.col("received") - stamp) <= tolerance) & (scheme == SCHEME) & F.contains(F.col("signature"), F.lit("=")) & (digest == hmac_hex("secret", message))
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("secret")


def delivery_key(name: Column, delivery: Column, body: Column) -> Column:
    given = F.nullif(delivery, F.lit(""))
    return F.concat(F.lit("webhook:"), name, F.lit(":"), F.coalesce(given, F.concat(F.lit("sha256:"), F.sha2(body, 256))))
