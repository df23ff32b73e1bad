"""Calendar fields and time bins (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_SECONDS = {"H": 3600, "D": 86400, "W": 604800}


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def time_bin(ts: Column, interval: str) -> Column:
    """Label of the bin holding ``ts``.

    ``H`` and ``D`` bins are labelled by their start. A ``W`` bin runs from Monday
    to Sunday and is labelled by its Sunday.
    """
    if interval == "H":
        return F.date_trunc("hour", ts)
    if interval == "D":
        return F.date_trunc("day", ts)
    if interval == "W":
        return F.date_trunc("week", ts) + F.expr("INTERVAL 6 DAYS")
    raise ValueError(f"interval must be H, D or W, not {interval!r}")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * F.lit(1_000_000))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0))
