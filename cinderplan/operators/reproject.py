"""Nearest-cell reprojection from a UTM grid to longitude and latitude."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderplan.functions import geodesy
from cinderplan.sources.grids import GridMeta


@dataclass(frozen=True)
class LonLatGrid:
    """Cells of step_lon x step_lat degrees, from the top-left corner (west, north)."""

    west: float
    north: float
    step_lon: float
    step_lat: float
    rows: int
    cols: int


def lon_lat_grid(spark: SparkSession, meta: GridMeta) -> LonLatGrid:
    """The box around the grid's outline, with as many rows and columns as the grid has."""
    n = 16
    along = [(meta.west + (meta.east - meta.west) * k / n, y) for k in range(n + 1) for y in (meta.north, meta.south)]
    along += [(x, meta.south + (meta.north - meta.south) * k / n) for k in range(n + 1) for x in (meta.west, meta.east)]
    d = spark.createDataFrame(along, "e double, n double")
    lat, lon = geodesy.inverse(F.col("e"), F.col("n"), F.lit(meta.zone), not meta.south_half)
    b = d.select(lat.alias("lat"), lon.alias("lon")).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    return LonLatGrid(b[2], b[1], (b[3] - b[2]) / meta.cols, (b[1] - b[0]) / meta.rows, meta.rows, meta.cols)


def reprojected(values: DataFrame, meta: GridMeta, to: LonLatGrid, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, r, c, value) on ``to``: each of its cells takes the value of the source cell that its middle falls in.

    The target grid is generated and projected back, then joined on the cell; source values are only shuffled by cell.
    """
    grid = values.sparkSession.range(to.rows * to.cols).select((F.col("id") / to.cols).cast("int").alias("r"), (F.col("id") % to.cols).cast("int").alias("c"))
    lat, lon = to.north - (F.col("r") + 0.5) * to.step_lat, to.west + (F.col("c") + 0.5) * to.step_lon
    r, c = geodesy.cell_of(*geodesy.forward(lat, lon, F.lit(meta.zone)), meta.west, meta.north, meta.step_x, meta.step_y)
    back = grid.select("r", "c", r.alias("_r"), c.alias("_c"))
    source = values.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), "value")
    return back.join(source, ["_r", "_c"]).select(*keys, "r", "c", "value")
