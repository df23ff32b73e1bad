"""Null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(col: Column) -> Column:
    """NaN sorts above every number in Spark; missing readings are plain nulls here."""
    return F.when(~F.isnan(col), col)


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def percent(top: Column, bottom: Column) -> Column:
    return F.try_divide(top * F.lit(100.0), bottom)


def clip(col: Column, low, high) -> Column:
    """Null stays null (least/greatest skip nulls)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(col.isNotNull(), F.least(F.greatest(col, low), high))


def correlation(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate that is null, not an error, on a constant column."""
    return F.try_divide(
        F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)
    )


def uniform(*keys, seed: int, stream: int, salt: int = 1) -> Column:
    """A draw between 0 and 1 that depends only on ``keys``, ``seed``, ``stream`` and ``salt``.

    It is a part of an MD5 digest: the same row gets the same draw however the data is
    partitioned, however often a task is retried, and in any engine. Timestamps count in
    microseconds.
    """
    parts = [*keys, *(F.lit(x) for x in (seed, stream, salt))]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    # 52 bits, shifted off zero so that its logarithm is finite
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def gaussian(*keys, seed: int, stream: int) -> Column:
    """A standard normal draw: Box-Muller over two draws of ``uniform``."""
    first, second = (uniform(*keys, seed=seed, stream=stream, salt=salt) for salt in (1, 2))
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2.0) * F.pi() * second)
