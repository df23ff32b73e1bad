"""The full analysis of all patients as a set of lazy tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from glycospan.config import DEFAULTS, Settings
from glycospan.operators import anomalies, cleaning, features, forecasting, patterns, report
from glycospan.operators.models import SEASONAL_FITS, fit_model
from glycospan.session import durable


@dataclass
class Analysis:
    """Tables of a study; those that nobody asks for are never made."""

    readings: DataFrame
    hourly: DataFrame
    settings: Settings
    leak_free: bool = True
    keep: bool = True

    @cached_property
    def flagged(self) -> DataFrame:
        return anomalies.flag_anomalies(self.readings, self.settings)

    @cached_property
    def features(self) -> DataFrame:
        table = features.build_features(self.hourly, self.leak_free)
        return durable(table) if self.keep else table

    def patterns(self) -> dict[str, DataFrame]:
        hours = patterns.hour_profile(self.hourly)
        days = patterns.weekday_profile(self.hourly)
        return {
            "hour_profile": hours,
            "weekday_profile": days,
            "peak_hours": patterns.peak_and_trough(hours, "hour"),
            "peak_days": patterns.peak_and_trough(days, "day_of_week"),
            "trend": patterns.linear_trend(self.hourly),
            "variability": patterns.variability(self.hourly),
            "distribution": patterns.distribution_summary(self.hourly),
            "time_in_range": patterns.time_in_range(self.hourly, settings=self.settings),
        }

    def forecast(
        self,
        periods: int = 168,
        algorithm: str = "prophet",
        freq: str = "H",
        mode: str = "frozen",
        noise: float | None = None,
        seed: int = 0,
        fourier: bool = False,
        method: str = "index",
        scope: str = "pooled",
        **params,
    ) -> DataFrame:
        """History and forecast with bounds for all patients.

        ``method`` is that of ``prophet``: ``index``, ``fourier``, or ``map``, whose bounds widen.
        """
        if algorithm == "prophet":
            grid = forecasting.future_grid(self.hourly, periods, freq, whole_step=True)
            model = SEASONAL_FITS["fourier" if fourier else method](self.hourly)
            table = forecasting.seasonal_forecast(model, self.hourly, grid, self.settings)
            if noise:
                table = forecasting.add_seasonal_noise(table, self.hourly, noise, seed)
                table = forecasting.clip_forecast(table, self.settings)
            return table
        start = self.hourly if mode == "recursive" else self.features
        grid = forecasting.future_grid(start, periods, freq)
        model = fit_model(algorithm, self.features, scope, **params)
        return forecasting.regressor_forecast(
            model, self.features, grid, mode, noise, seed, self.settings, self.hourly
        )

    def report(self, forecast: DataFrame) -> DataFrame:
        metrics = report.report_metrics(report.report_input(forecast), self.settings)
        return report.report_rows(metrics)


def analyse(
    readings: DataFrame, settings: Settings = DEFAULTS, leak_free: bool = True, keep: bool = True
) -> Analysis:
    """Flag, clean and featurise the readings of all patients.

    ``keep`` writes the hourly grid, and the feature table once it is asked for, to the
    checkpoint folder, as several consumers read them and neither should start at the
    readings again.
    """
    hourly = cleaning.clean(readings, settings)
    if keep:
        hourly = durable(hourly)
    return Analysis(readings, hourly, settings, leak_free, keep)
