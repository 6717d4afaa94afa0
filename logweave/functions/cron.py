"""Five-field schedules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest value of minute, hour, day of month, month, day of week. Fixed values.
BOUNDS = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]


def field(expr: Column, place: int) -> Column:
    """Sorted values of one field of a schedule: lists, ranges and steps; a number with a step runs to the end; day of week 7 is 0."""
    low, high = BOUNDS[place]
    part = F.element_at(F.split(F.trim(expr), r"\s+"), place + 1)

    def values(item: Column) -> Column:
        head = F.substring_index(item, "/", 1)
        has_step = F.contains(item, F.lit("/"))
        step = F.when(has_step, F.substring_index(item, "/", -1).cast("int")).otherwise(1)
        ranged = F.contains(head, F.lit("-"))
        first = F.when(head == "*", F.lit(low)).otherwise(F.substring_index(head, "-", 1).try_cast("int"))
        last = F.when(head == "*", F.lit(high)).when(ranged, F.substring_index(head, "-", -1).try_cast("int")).when(has_step, F.lit(high)).otherwise(first)
        return F.sequence(first, last, step)

    out = F.flatten(F.transform(F.split(part, ","), values))
    if place == 4:
        out = F.transform(out, lambda v: v % 7)
    return F.array_sort(F.array_distinct(out))


def star(expr: Column, place: int) -> Column:
    return F.element_at(F.split(F.trim(expr), r"\s+"), place + 1) == "*"


def day_matches(day: Column, doms: Column, dows: Column, dom_star: Column, dow_star: Column) -> Column:
    """Both day fields restricted: either may match; one restricted: that one; none: every day."""
    dom = F.array_contains(doms, F.dayofmonth(day))
    dow = F.array_contains(dows, F.dayofweek(day) - 1)
    return F.when(dom_star & dow_star, True).when(dom_star, dow).when(dow_star, dom).otherwise(dom | dow)
