"""The event queue as a relation: push is union, pop is the earliest bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def push(queue: DataFrame, events: DataFrame) -> DataFrame:
    """A multiset union: nothing is dropped."""
    return queue.unionByName(events)


def pop(queue: DataFrame, time: str = "t10") -> tuple[DataFrame, DataFrame]:
    """(earliest bucket, the rest)."""
    first = queue.agg(F.min(time).alias("_t")).first()["_t"]
    if first is None:
        return queue, queue
    return queue.where(F.col(time) == first), queue.where(F.col(time) > first)


def earliest(queue: DataFrame, time: str = "t10") -> DataFrame:
    """The earliest bucket without a round trip to the driver."""
    return queue.join(F.broadcast(queue.agg(F.min(time).alias(time))), time, "left_semi")  # one row


def times(queue: DataFrame, time: str = "t10") -> DataFrame:
    return queue.select(time).distinct().orderBy(time)


def sizes(queue: DataFrame, time: str = "t10") -> DataFrame:
    return queue.groupBy(time).agg(F.count("*").alias("n"))
