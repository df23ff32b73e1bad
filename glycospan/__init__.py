"""Continuous-glucose analytics as composable Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by ``patient_id`` and works on
all patients at once.
"""

__version__ = "0.1.0"
