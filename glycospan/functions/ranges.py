"""Clinical classifications as CASE expressions built from the range table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glycospan.config import REFERENCE_RANGES


def ranges_of(metric: str) -> list[tuple[str, float, float]]:
    found = [(s, lo, hi) for m, s, lo, hi in REFERENCE_RANGES if m == metric]
    return found or ranges_of("Random Glucose")


def _first_range(value: Column, metric: str, continuous: bool, otherwise: Column) -> Column:
    ranges = ranges_of(metric)
    arms = []
    for i, (status, low, high) in enumerate(ranges):
        if continuous and i + 1 < len(ranges):
            inside = (value >= low) & (value < ranges[i + 1][1])
        else:
            inside = value.between(low, high)
        arms.append((inside, status))
    case = reduce(
        lambda acc, arm: acc.when(arm[0], F.lit(arm[1])),
        arms[1:],
        F.when(arms[0][0], F.lit(arms[0][1])),
    )
    return F.when(value.isNotNull(), case.otherwise(otherwise))


def range_status(value: Column, metric: str = "Random Glucose", continuous: bool = False) -> Column:
    """First matching range; ``Low`` below the first one, else ``Critical High``.

    The range bounds leave holes between integers (120.5 falls in one) which land
    in ``Critical High``; ``continuous=True`` closes them.
    """
    lowest = ranges_of(metric)[0][1]
    beyond = F.when(value < lowest, F.lit("Low")).otherwise(F.lit("Critical High"))
    return _first_range(value, metric, continuous, beyond)


def light_status(value: Column, metric: str = "Random Glucose") -> Column:
    return _first_range(value, metric, False, F.lit("Critical"))


def light_colour(value: Column, metric: str = "Random Glucose") -> Column:
    status = light_status(value, metric)
    return (
        F.when(status.rlike("Normal|Excellent"), "green")
        .when(status.rlike("Good|Fair"), "orange")
        .when(status.isNotNull(), "red")
    )


def severity(status: Column) -> Column:
    return (
        F.when(status.rlike("Good|Normal|Excellent"), "normal")
        .when(status.rlike("Fair|Prediabetes"), "warning")
        .when(status.isNotNull(), "high")
    )


def range_text(metric: str) -> str:
    return ", ".join(f"{s}: {lo:g}-{hi:g}" for s, lo, hi in ranges_of(metric))


def period_label(n_rows: Column) -> Column:
    return F.when(n_rows < 168, F.concat(n_rows.cast("string"), F.lit(" hours"))).otherwise(
        F.concat(F.floor(n_rows / F.lit(24)).cast("string"), F.lit(" days"))
    )
