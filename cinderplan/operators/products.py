"""Maps and statistics over realizations: every product is an aggregate of the event relation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def probability(burned: DataFrame, n: int, keys: list[str] = ()) -> DataFrame:
    """(keys, r, c, value): share of n realizations in which a cell has burned; burned has a row for each."""
    return burned.groupBy(*keys, "r", "c").agg((F.count("*") / F.lit(float(n))).alias("value"))


def largest(rows: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, "r", "c").agg(F.max(F.nanvl(value, F.lit(None).cast("double"))).alias("value"))


def mean_positive(rows: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Mean over realizations in which the value is positive, else 0."""
    return rows.groupBy(*keys, "r", "c").agg(F.coalesce(F.avg(F.when(F.nanvl(value, F.lit(0.0)) > 0, F.col(value))), F.lit(0.0)).alias("value"))


def area_stats(prob: DataFrame, step_x: float = 20.0, step_y: float = 20.0, keys: list[str] = ()) -> DataFrame:
    """Hectares: mean, and burned with probability of at least one half, three quarters and nine tenths."""
    ha = step_x * step_y / 10_000
    return prob.groupBy(*keys).agg((F.sum("value") * ha).alias("area_mean"), *((F.count_if(F.col("value") >= p) * ha).alias(f"area_{round(p * 100)}") for p in (0.5, 0.75, 0.9)))


def active(pending: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Realizations with an event still to come."""
    return pending.groupBy(*keys).agg(F.countDistinct("rz").alias("active"))


def last_write(attempts: DataFrame, order: list[Column], values: list[str], keys: list[str]) -> DataFrame:
    """Per key the values of the last attempt in ``order`` (a total order)."""
    return attempts.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def snapshots(spark, limit10: int, every10: int) -> DataFrame:
    """(s10): 0, every, ... up to the limit."""
    return spark.range(limit10 // every10 + 1).select((F.col("id") * every10).alias("s10"))


def first_snapshot(time: str, every10: int) -> Column:
    """The first snapshot (s10) at or after a time."""
    return (F.ceil(F.greatest(F.col(time), F.lit(0)) / every10) * every10).cast("long")


def running(rows: DataFrame, time: str, every10: int, limit10: int, keys: list[str], partial: dict[str, Column], merge: dict[str, Callable[[str], Column]]) -> DataFrame:
    """(keys, s10, values): aggregates of all rows up to each snapshot, from a key's first on.

    Rows are aggregated by key and first snapshot (partial); a key's snapshots are then run through (merge of the values so far), and
    each result is repeated only until the next, so that what is made is what is returned.
    """
    last = F.lit(limit10 // every10 * every10).cast("long")
    d = rows.withColumn("s10", first_snapshot(time, every10)).where(F.col("s10") <= last)
    d = d.groupBy(*keys, "s10").agg(*(v.alias(k) for k, v in partial.items()))
    order = Window.partitionBy(*keys).orderBy("s10")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce(F.lead("s10").over(order) - every10, last)
    d = d.select(*keys, "s10", until.alias("_until"), *(merge[k](k).over(so_far).alias(k) for k in partial))
    return d.withColumn("s10", F.explode(F.sequence("s10", "_until", F.lit(every10).cast("long")))).drop("_until")
