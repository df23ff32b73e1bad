"""Thresholds, clinical reference ranges and scale limits."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Scalars shared by the operators.

    The first block is clinical; the second bounds what one task or one
    broadcast may hold on a cluster.
    """

    min_valid: float = 40.0
    max_valid: float = 400.0
    z_limit: float = 3.0
    rate_limit: float = 5.0
    gap_minutes: float = 15.0
    interval: str = "H"
    fill_limit: int = 24
    range_low: float = 70.0
    range_high: float = 180.0
    confidence: float = 0.95

    #: rows a per-patient table may have and still be broadcast (about 40 bytes each)
    broadcast_rows: int = 500_000
    #: width of the time slices in which the readings of a patient are ordered
    slice_hours: int = 24
    #: readings one slice, or one task of a join, may hold before it is split further
    max_slice_rows: int = 5_000_000
    #: equal-width bins per refinement step of the exact quantiles
    quantile_bins: int = 4096

    def crowded_above(self, n_rows: int) -> int:
        """Size from which a group counts as crowded.

        Of ``n_rows`` rows, fewer than ``broadcast_rows`` groups can be larger than
        this, so a list of the crowded groups can always be broadcast.
        """
        return max(self.max_slice_rows, -(-n_rows // max(self.broadcast_rows, 1)))


DEFAULTS = Settings()

# Clinical reference ranges, (metric, status, low, high), in the
# order in which they are tried.
REFERENCE_RANGES = [
    ("Fasting Glucose", "Normal", 70.0, 99.0),
    ("Fasting Glucose", "Prediabetes", 100.0, 125.0),
    ("Fasting Glucose", "Diabetes", 126.0, 400.0),
    ("Post-Meal Glucose (2hr)", "Normal", 70.0, 139.0),
    ("Post-Meal Glucose (2hr)", "Prediabetes", 140.0, 199.0),
    ("Post-Meal Glucose (2hr)", "Diabetes", 200.0, 400.0),
    ("Random Glucose", "Normal", 70.0, 140.0),
    ("Random Glucose", "Elevated", 141.0, 199.0),
    ("Random Glucose", "High", 200.0, 400.0),
    ("Average Glucose", "Excellent", 70.0, 120.0),
    ("Average Glucose", "Good", 121.0, 154.0),
    ("Average Glucose", "Fair", 155.0, 180.0),
    ("Average Glucose", "Poor", 181.0, 400.0),
    ("HbA1c Equivalent", "Normal", 0.0, 5.6),
    ("HbA1c Equivalent", "Prediabetes", 5.7, 6.4),
    ("HbA1c Equivalent", "Diabetes", 6.5, 15.0),
]

# Named forecast horizons in hours.
NAMED_HORIZONS = {
    "Next 24 Hours": 24,
    "Next 3 Days": 72,
    "Next Week": 168,
    "Next 2 Weeks": 336,
    "Next Month": 720,
}
COMPARED_HORIZONS = {
    "1 Week": 168,
    "1 Month": 720,
    "3 Months": 2160,
    "6 Months": 4320,
    "1 Year": 8760,
}

# Look-backs of the feature table, in rows of the hourly grid.
LAGS = (1, 2, 3, 6, 12, 24)
WINDOWS = (6, 12, 24, 72)
DIFFS = (1, 3)
