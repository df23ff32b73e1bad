"""Join a table with one row per patient onto the readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glycospan.config import DEFAULTS, Settings
from glycospan.session import durable


def attach(
    rows: DataFrame,
    per_patient: DataFrame,
    at_most: int,
    spread: Column,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """``rows`` left-joined with ``per_patient``, which has ``at_most`` so many rows.

    ``per_patient`` counts the rows of each patient in ``total``, which is dropped. A
    short table is broadcast. Otherwise both sides are shuffled, and a patient with
    many rows is spread over as many tasks as they need, by a hash of ``spread``:
    only such patients are repeated in the patient table, and their list is short
    enough to tell every reading how many ways its patient is spread.
    """
    if at_most <= settings.broadcast_rows:
        return rows.join(F.broadcast(per_patient.drop("total")), "patient_id", "left")

    per_patient = durable(per_patient)
    limit = settings.crowded_above(per_patient.agg(F.sum("total")).first()[0] or 0)
    ways = F.ceil(F.col("total") / F.lit(limit))
    crowded = per_patient.where(F.col("total") > limit).select("patient_id", ways.alias("ways"))
    salt = F.pmod(F.xxhash64(spread), F.coalesce("ways", F.lit(1)))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(ways, F.lit(1)) - 1))
    return (
        rows.join(F.broadcast(crowded), "patient_id", "left")
        .withColumn("salt", salt)
        .drop("ways")
        .join(
            per_patient.withColumn("salt", copies).drop("total").hint("merge"),
            ["patient_id", "salt"],
            "left",
        )
        .drop("salt")
    )
