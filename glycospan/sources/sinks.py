"""File sinks for any result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "errorifexists",
    by_patient: bool = True,
    order: tuple[str, ...] | None = None,
) -> None:
    """Write with a header, one folder per patient.

    Give ``by_patient=False`` for a large number of patients: folders by the million
    burden a file system.

    Rows are range-shuffled by patient and ``order`` (by default the time and id
    columns there are, or else all columns), so a task writes few patients and a
    patient with many rows is written by several tasks.
    """
    if order is None:
        known = [c for c in ("timestamp", "hour_ts", "id") if c in df.columns]
        order = tuple(known or [c for c in df.columns if c != "patient_id"])
    writer_input = df
    by_patient = by_patient and "patient_id" in df.columns
    if by_patient:
        writer_input = df.repartitionByRange("patient_id", *order).sortWithinPartitions(
            "patient_id", *order
        )
    writer = writer_input.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by_patient:
        writer = writer.partitionBy("patient_id")
    writer.save(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, order: tuple[str, ...] = ("hour_ts",), mode: str = "errorifexists") -> None:
    """A table of the catalog in ``buckets`` by patient, sorted inside by ``order``.

    Reading it by name, windows and aggregates by patient need no exchange: deltas, features,
    patterns and fits of the grid start where the rows lie. Rows are shuffled once here, one
    file for each bucket. Choose ``buckets`` so that one holds 100 to 200 MB.
    """
    laid_out = df.repartition(buckets, "patient_id").sortWithinPartitions("patient_id", *order)
    laid_out.write.mode(mode).format("parquet").bucketBy(buckets, "patient_id").sortBy("patient_id", *order).saveAsTable(table)


def replace_days(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Parquet with a folder for each day, of which only the days in ``df`` are replaced.

    A run that is repeated for some days leaves the others as they are.
    """
    days = df.withColumn("day", F.to_date(ts)).repartitionByRange("day", "patient_id", ts).sortWithinPartitions("day", "patient_id", ts)
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
