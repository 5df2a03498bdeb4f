"""Boundary conditions as intervals, and as-of lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderplan.operators.ordered import carried, followed


def intervals(bc: DataFrame, time: str = "time", few: bool = False) -> DataFrame:
    """bc with from_t and to_t (null: open): each condition holds until the next; of equal times the last counts.

    few: bc is a job's own list of conditions, which one task may sort; otherwise it is any table.
    """
    order = [time, *(["bc_id"] if "bc_id" in bc.columns else [])]
    d = bc.withColumn("from_t", F.col(time))
    d = d.withColumn("to_t", F.lead(time).over(Window.orderBy(*order))) if few else followed(d, *order, value=time, name="to_t")
    return d.where("to_t is null or to_t > from_t")


def as_of(events: DataFrame, states: DataFrame, time: str, state_time: str, columns: list[str], by: list[str] = ()) -> DataFrame:
    """events with the columns of the latest state at or before their time, null before the first.

    One sort instead of a range join: states and events are put in one stream by (keys, time) and the last state is
    carried forward, so that neither side needs to fit anywhere, nor all rows of a key. Of states with one time the
    greatest by their columns counts.
    """
    held = F.struct(*(F.col(c).alias(c) for c in columns))
    e = events.withColumns({"_at": F.col(time), "_state": F.lit(None).cast(states.select(held.alias("s")).schema["s"].dataType), "_event": F.struct(*(F.col(c) for c in events.columns)), "_is": F.lit(1)})
    s = states.select(*by, F.col(state_time).alias("_at"), held.alias("_state"), F.lit(0).alias("_is"))
    d = e.select(*by, "_at", "_state", "_event", "_is").unionByName(s.withColumn("_event", F.lit(None).cast(e.schema["_event"].dataType)))
    d = carried(d.withColumn("_tie", F.xxhash64("_event")), *by, "_at", "_is", "_state", "_tie", keys=list(by), value="_state", name="_last")
    return d.where("_is = 1").select("_event.*", *(F.col(f"_last.{c}").alias(c) for c in columns))


def as_of_few(events: DataFrame, states: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """As ``as_of`` for a bounded table of states, broadcast as intervals: events aren't sorted."""
    i = F.broadcast(states.select("from_t", "to_t", *columns))
    return events.join(i, (F.col(time) >= F.col("from_t")) & (F.col("to_t").isNull() | (F.col(time) < F.col("to_t"))), "left").drop("from_t", "to_t")
