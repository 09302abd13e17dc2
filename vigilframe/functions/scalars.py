"""Scalar expressions over event columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def is_weekend(ts: Column) -> Column:
    return flag(F.weekday(ts).isin(5, 6))


def is_working_hour(ts: Column) -> Column:
    """9:00 to 17:59."""
    return flag(F.hour(ts).between(9, 17))


def cyclic(hour: Column) -> tuple[Column, Column]:
    angle = F.coalesce(hour, F.lit(0)) * (2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def day_part(ts: Column, low: int, high: int) -> Column:
    return flag((F.hour(ts) >= low) & (F.hour(ts) < high))


def within_hours(ts: Column, start_s: int, end_s: int) -> Column:
    """Time of day within both bounds, in seconds; the end itself counts, a microsecond later doesn't."""
    of_day = F.timestamp_diff("MICROSECOND", F.date_trunc("day", ts), ts.cast("timestamp"))
    return of_day.between(start_s * 1_000_000, end_s * 1_000_000)


def first_of(text: Column, options: dict[str, str], other: str) -> Column:
    """The name of the first option whose text occurs, case counting."""
    out = None
    for part, name in options.items():
        out = F.when(text.contains(part), name) if out is None else out.when(text.contains(part), name)
    return out.otherwise(other)


def operating_system(agent: Column) -> Column:
    return first_of(agent, {"Windows": "Windows", "Macintosh": "Mac", "Linux": "Linux"}, "OtherOS")


def browser(agent: Column) -> Column:
    return first_of(agent, {"Chrome": "Chrome", "Firefox": "Firefox", "Safari": "Safari"}, "OtherBrowser")


def last_token(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def ratio(part: Column, whole: Column, otherwise: float) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(float(otherwise)))


def finite(x: Column) -> Column:
    """Infinite and NaN become null."""
    return F.when((F.abs(x) < float("inf")) & ~F.isnan(x), x)


def numeric(x: Column) -> Column:
    """As a double; what is no number is 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def steady_id(row_id: Column) -> Column:
    """A made-up id that is the same whenever the row is read."""
    return F.substring(F.sha2(F.coalesce(row_id.cast("string"), F.lit("")), 256), 1, 32)
