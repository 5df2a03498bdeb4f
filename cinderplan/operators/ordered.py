"""Order over a whole table without a task that holds it.

Rows are dealt by ranges of the order, sorted and stored; what crosses the border of two partitions is one row a partition.
Ties should be broken by the order's last columns: rows that agree in all of them can't be dealt to two partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cinderplan.store import stored

#: monotonically_increasing_id has the partition above this bit and the row's place in it below.
BIT = 33


def placed(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in order, with _part, the number of its range, and _row, its place there from 0."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    d = stored(d, "ordered")
    return d.withColumns({"_part": F.shiftright("_at", BIT), "_row": F.col("_at").bitwiseAND((1 << BIT) - 1)}).drop("_at")


def _per_part(d: DataFrame, **aggregates: Column) -> DataFrame:
    """One row a partition, in a window's order."""
    return stored(d.groupBy("_part").agg(*(v.alias(k) for k, v in aggregates.items())), "parts")


def _by_part() -> WindowSpec:
    return Window.orderBy("_part")  # over one row a partition


def numbered(df: DataFrame, *order: str | Column, name: str) -> DataFrame:
    """df with the number of each row in the order, from 0."""
    d = placed(df, *order)
    before = F.coalesce(F.sum("n").over(_by_part().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = _per_part(d, n=F.count("*")).select("_part", before.alias("_before"))
    return d.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def followed(df: DataFrame, *order: str | Column, value: str, name: str) -> DataFrame:
    """df with the value of the next row in the order, null for the last."""
    d = placed(df, *order)
    parts = _per_part(d, v=F.min_by(value, "_row")).select("_part", F.lead("v").over(_by_part()).alias("_next"))
    own = Window.partitionBy("_part").orderBy("_row")
    d = d.withColumns({"_v": F.lead(value).over(own), "_last": F.lead("_row").over(own).isNull()})
    return d.join(F.broadcast(parts), "_part").withColumn(name, F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_v"))).drop("_part", "_row", "_v", "_last", "_next")


def carried(df: DataFrame, *order: str | Column, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the last non-null value at or before each row among the rows of equal keys. The order begins with the keys."""
    d = placed(df, *order)
    key = F.struct(F.lit(0).alias("_"), *(F.col(k) for k in keys))
    d = d.withColumn("_key", key)
    tail = F.max_by("_key", "_row")
    parts = _per_part(d, head=F.min_by("_key", "_row"), tail=tail)
    # the last value that a partition has for the key it ends with
    ends = d.join(F.broadcast(parts.select("_part", "tail")), "_part").where(F.col("_key").eqNullSafe(F.col("tail")) & F.col(value).isNotNull())
    ends = ends.groupBy("_part").agg(F.max_by(value, "_row").alias("v"))
    both = parts.join(ends, "_part", "left").select(F.explode(F.array(
        F.struct(F.col("head").alias("k"), (2 * F.col("_part")).alias("o"), F.lit(None).cast(d.schema[value].dataType).alias("v")),
        F.struct(F.col("tail").alias("k"), (2 * F.col("_part") + 1).alias("o"), F.col("v")),
    )).alias("x")).select("x.*")
    before = both.withColumn("_before", F.last("v", ignorenulls=True).over(Window.partitionBy("k").orderBy("o"))).where("o % 2 = 0")
    before = stored(before.select(F.shiftright("o", 1).alias("_part"), F.col("k").alias("_head"), "_before"), "before")
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_part", "_key").orderBy("_row"))
    d = d.withColumn("_own", own).join(F.broadcast(before), "_part", "left")
    from_before = F.when(F.col("_key").eqNullSafe(F.col("_head")), F.col("_before"))
    return d.withColumn(name, F.coalesce("_own", from_before)).drop("_part", "_row", "_key", "_own", "_head", "_before")
