"""The event queue as a stream: first arrivals in event time, late events dropped, snapshots by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("rz", "r", "c"), late: str = "10 minutes") -> DataFrame:
    """A stream's first event of each key; duplicates within the watermark and later ones are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def burned_by_window(events: DataFrame, time: str = "ts", every: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """New burned events and their realizations for each snapshot interval, emitted once the watermark has passed it."""
    w = F.window(time, every)
    return events.withWatermark(time, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("rz").alias("realizations")).select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n", "realizations")
