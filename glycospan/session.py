"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(name: str = "glycospan", master: str | None = None, **options) -> SparkSession:
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # pools of concurrent fits share the cores
        .config("spark.scheduler.mode", "FAIR")
        # drop the files of durable tables once nothing refers to them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Hour bins and calendar fields are UTC: sets the session's zone, and leaves it set."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif re.fullmatch(r"local(\[.*\])?", context.master):  # one process: its warehouse folder will do
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    else:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that all executors share"
        )
    return context.getCheckpointDir()


def durable_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, for what has its own writer."""
    return f"{_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    Used for small per-patient tables that are both tested on the driver and read
    again by the main pass; a lost executor does not lose them.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
