"""Rename operations counted over a stream of rename events.

The batch operators take any DataFrame; this is the incremental form of the commit-window counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def operation_windows(renames: DataFrame, days: int = 2, late: str = "7 days") -> DataFrame:
    """(window, op_key, n): renames of each operation in sliding windows of so many days, one a day; events later than the watermark are left out."""
    return renames.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day"), "op_key").agg(F.count("*").alias("n"))
