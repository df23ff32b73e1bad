"""Exact quantiles per patient without holding a patient's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycospan.config import DEFAULTS, Settings
from glycospan.session import durable


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    low: float,
    high: float,
    settings: Settings = DEFAULTS,
) -> tuple[DataFrame, int]:
    """Linear-interpolated quantiles of ``value``, all in ``[low, high]``, per patient.

    Returns the table, with the number of values in ``total``, and an upper bound of
    its row count. Each pass counts equal-width bins (combined before the shuffle, at most
    ``quantile_bins`` rows per patient or parent bin) and keeps only the bins that
    hold a wanted rank; bins that are still too full are cut again. Only the
    distinct values of the last bins are ranked, so the result is exact whatever
    share of the rows one patient, or one value, has.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull()).select("patient_id", v.alias("v"))

    def bins(resolution: int) -> Column:
        # resolutions are powers of two, so that finer bins nest in coarser ones
        at = F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * F.lit(float(resolution)))
        return F.least(at, F.lit(resolution - 1))

    resolution = settings.quantile_bins
    whole = Window.partitionBy("patient_id")
    counts = rows.groupBy("patient_id", bins(resolution).alias("bin")).agg(
        F.count("*").alias("n"), (F.min("v") < F.max("v")).alias("varies")
    )
    targets = durable(
        _holding_ranks(
            counts.withColumn("total", F.sum("n").over(whole)).withColumn(
                "start", F.sum("n").over(whole.orderBy("bin")) - F.col("n")
            ),
            probs,
        )
    )
    n_targets, fullest = _extent(targets)
    while fullest > settings.max_slice_rows and resolution < 2**48:
        inside = _narrow(rows.withColumn("bin", bins(resolution)), targets, n_targets, settings)
        resolution *= settings.quantile_bins
        finer = inside.groupBy(
            "patient_id", "bin", "start", "total", bins(resolution).alias("finer")
        ).agg(F.sum("n").alias("n"), (F.min("v") < F.max("v")).alias("varies"))
        upto = F.sum("n").over(Window.partitionBy("patient_id", "bin").orderBy("finer"))
        targets = durable(
            _holding_ranks(
                finer.withColumn("start", F.col("start") + upto - F.col("n"))
                .drop("bin")
                .withColumnRenamed("finer", "bin"),
                probs,
            )
        )
        n_targets, fullest = _extent(targets)

    inside = _narrow(rows.withColumn("bin", bins(resolution)), targets, n_targets, settings)
    upto = F.sum("n").over(Window.partitionBy("patient_id", "bin").orderBy("v"))
    placed = (
        inside.groupBy("patient_id", "bin", "start", "total", "v")
        .agg(F.sum("n").alias("n"))
        .withColumn("start", F.col("start") + upto - F.col("n"))
    )
    edges = placed.groupBy("patient_id").agg(
        F.max("total").alias("total"),
        *[
            F.max(F.when(_holds(rank), F.col("v"))).alias(f"{name}_{side}")
            for name, p in probs.items()
            for side, rank in _ranks(p).items()
        ],
    )
    quantiles = edges.select(
        "patient_id",
        "total",
        *[
            (
                F.col(f"{name}_lower")
                + (F.col(f"{name}_upper") - F.col(f"{name}_lower"))
                * (_position(p) - F.floor(_position(p)))
            ).alias(name)
            for name, p in probs.items()
        ],
    )
    return quantiles, n_targets


def _position(p: float) -> Column:
    return F.lit(float(p)) * (F.col("total") - F.lit(1))


def _ranks(p: float) -> dict[str, Column]:
    return {"lower": F.floor(_position(p)), "upper": F.ceil(_position(p))}


def _holds(rank: Column) -> Column:
    return (F.col("start") <= rank) & (rank < F.col("start") + F.col("n"))


def _holding_ranks(placed: DataFrame, probs: dict[str, float]) -> DataFrame:
    wanted = F.lit(False)
    for p in probs.values():
        for rank in _ranks(p).values():
            wanted = wanted | _holds(rank)
    return placed.where(wanted).select("patient_id", "bin", "n", "start", "total", "varies")


def _extent(targets: DataFrame) -> tuple[int, int]:
    """Number of bins, and the rows of the fullest one that cutting can still divide."""
    n_targets, fullest = targets.agg(F.count("*"), F.max(F.when(F.col("varies"), F.col("n")))).first()
    return n_targets, fullest or 0


def _narrow(
    rows: DataFrame, targets: DataFrame, n_targets: int, settings: Settings
) -> DataFrame:
    """Rows (with a weight ``n``) that fall in a target bin.

    There are at most two target bins per patient and probability. A small list is
    broadcast and filters the readings where they are scanned; a long one is joined
    by shuffle, after equal values of a patient have been merged.
    """
    context = targets.select("patient_id", "bin", "start", "total")
    if n_targets <= settings.broadcast_rows:
        rows, context = rows.withColumn("n", F.lit(1).cast("long")), F.broadcast(context)
    else:
        rows = rows.groupBy("patient_id", "bin", "v").agg(F.count("*").alias("n"))
    return rows.join(context, ["patient_id", "bin"])
