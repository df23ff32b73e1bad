"""The readings table: schema, readers and the patient scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glycospan.functions.numeric import nan_to_null

READINGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("patient_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("actual_time", T.TimestampType()),
    ]
)


def as_readings(df: DataFrame) -> DataFrame:
    """Cast any frame with the readings columns to the readings schema.

    ``actual_time`` may be missing; NaN values become null.
    """
    columns = [
        F.col(f.name).cast(f.dataType).alias(f.name)
        if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in READINGS.fields
    ]
    cast = df.select(columns)
    return cast.withColumn("value", nan_to_null(F.col("value")))


def read_readings(spark: SparkSession, path, fmt: str = "parquet", **options) -> DataFrame:
    """Readings from parquet, ORC, CSV or JSON files, or a table (``fmt="table"``)."""
    if fmt == "table":
        return as_readings(spark.read.table(path))
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        reader = reader.schema(READINGS)
    return as_readings(reader.load(path))


def read_readings_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 64,
    **options,
) -> DataFrame:
    """Readings from a relational database.

    Connection details come from the caller only. Patient filters and the column
    list are pushed into the remote query; give ``partition_column`` with bounds
    so that the scan is split over executors.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=partitions,
        )
    return as_readings(reader.load())


def scan(
    readings: DataFrame, patients: int | Iterable[int] | None = None, ordered: bool = False
) -> DataFrame:
    """Readings of one, several or all patients.

    The filter reaches the file or database scan. ``ordered`` sorts by patient and
    time with a range shuffle, so that a busy patient spans several tasks.
    """
    rows = readings
    if patients is not None:
        ids = [patients] if isinstance(patients, int) else list(patients)
        rows = rows.where(F.col("patient_id").isin(ids))
    rows = rows.select("id", "patient_id", "timestamp", "value", "actual_time")
    return rows.orderBy("patient_id", "timestamp", "id") if ordered else rows
