"""Fit, hold out, score and rank the algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glycospan.config import DEFAULTS, Settings
from glycospan.operators.cleaning import clean
from glycospan.operators.evaluation import band_counts, compare_algorithms
from glycospan.operators.features import build_features
from glycospan.operators.models import ALGORITHMS
from glycospan.session import durable


def compare(
    readings: DataFrame,
    names=ALGORITHMS,
    params: dict[str, dict] | None = None,
    leak_free: bool = True,
    settings: Settings = DEFAULTS,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """``(leaderboard, band counts)`` per patient."""
    hourly = durable(clean(readings, settings))
    table = durable(build_features(hourly, leak_free))
    board = durable(compare_algorithms(hourly, table, names, params, **options))
    return board, band_counts(board.where("failure is null"))
