"""Grids as ``cells(r, c, veg, dem)``: synthetic, from two rasters, from tiles; clean-up and consistency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SpreadError(Exception):
    """A job that cannot run."""


class NoTilesError(SpreadError):
    """A place that no tileset covers."""


@dataclass(frozen=True)
class GridMeta:
    """Where a grid lies: top-left corner, steps, size, UTM zone and hemisphere, and its file's EPSG code (0: none)."""

    west: float
    north: float
    step_x: float
    step_y: float
    rows: int
    cols: int
    zone: int
    south_half: bool = False
    crs: int = 0

    @property
    def east(self) -> float:
        return self.west + self.cols * self.step_x

    @property
    def south(self) -> float:
        return self.north - self.rows * self.step_y


def synthetic(spark: SparkSession, rows: int, cols: int, veg: int = 4, slope: float = -5.0, border: int = 1) -> DataFrame:
    """A uniform fuel on a plane that falls by ``slope`` metres a column, with an unburnable border."""
    d = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    return d.select("r", "c", zero_border(F.lit(veg), F.col("r"), F.col("c"), rows, cols, border).alias("veg"), (F.col("c") * F.lit(float(slope))).alias("dem"))


def zero_border(veg: Column, r: Column, c: Column, rows: int, cols: int, width: int = 3) -> Column:
    return F.when((r < width) | (r >= rows - width) | (c < width) | (c >= cols - width), 0).otherwise(veg).cast("int")


def clean_class(veg: Column, most: int = 6) -> Column:
    """Classes outside 0..most are not burnable; null neither."""
    return F.when((veg < 0) | (veg > most) | veg.isNull(), 0).otherwise(veg).cast("int")


def from_rasters(veg: DataFrame, dem: DataFrame, rows: int, cols: int) -> DataFrame:
    """cells from veg(r, c, value) and dem(r, c, value)."""
    v = veg.select("r", "c", zero_border(clean_class(F.col("value").cast("int")), F.col("r"), F.col("c"), rows, cols).alias("veg"))
    return v.join(dem.select("r", "c", F.col("value").cast("double").alias("dem")), ["r", "c"])


def consistent(a: GridMeta, b: GridMeta) -> bool:
    """Same reference system, step within 1 percent, bounds within two steps in all (sum of the four differences)."""
    off = sum(abs(x - y) for x, y in ((a.west, b.west), (a.south, b.south), (a.east, b.east), (a.north, b.north)))
    return (a.crs, a.zone, a.south_half) == (b.crs, b.zone, b.south_half) and abs(a.step_x - b.step_x) / a.step_x <= 0.01 and off <= 2 * a.step_x


def window(tiles: DataFrame, zone: int, var: str, top: int, left: int, side: int, tile_side: int, tileset: str = "default") -> DataFrame:
    """(r, c, value) of a window given in whole-zone cell coordinates, from tiles(tileset, zone, var, i, j, r, c, value).

    i and j are partition columns of the tile table, so that only tiles that the window meets are opened; stitching
    one, two or four tiles is the same filter and shift.
    """
    i0, i1, j0, j1 = top // tile_side, (top + side - 1) // tile_side, left // tile_side, (left + side - 1) // tile_side
    d = tiles.where((F.col("tileset") == tileset) & (F.col("zone") == zone) & (F.col("var") == var) & F.col("i").between(i0, i1) & F.col("j").between(j0, j1))
    d = d.select((F.col("i") * tile_side + F.col("r") - top).alias("r"), (F.col("j") * tile_side + F.col("c") - left).alias("c"), "value")
    return d.where(F.col("r").between(0, side - 1) & F.col("c").between(0, side - 1))


def tile_cells(tiles: DataFrame, zone: int, top: int, left: int, side: int, tile_side: int, tileset: str = "default") -> DataFrame:
    """cells of a window; each variable falls back to the default tileset, missing vegetation is 0, missing height 0."""

    def one(var: str) -> DataFrame:
        for name in dict.fromkeys((tileset, "default")):
            if not (d := window(tiles, zone, var, top, left, side, tile_side, name)).isEmpty():
                return d
        raise NoTilesError(f"no {var} tiles in zone {zone}")

    spark = tiles.sparkSession
    full = spark.range(side * side).select((F.col("id") / side).cast("int").alias("r"), (F.col("id") % side).cast("int").alias("c"))
    v = full.join(one("veg").select("r", "c", F.col("value").cast("int").alias("veg")), ["r", "c"], "left")
    d = v.join(one("dem").select("r", "c", F.col("value").alias("dem")), ["r", "c"], "left")
    veg = zero_border(clean_class(F.col("veg"), 7), F.col("r"), F.col("c"), side, side)
    return d.select("r", "c", veg.alias("veg"), F.coalesce("dem", F.lit(0.0)).cast("double").alias("dem"))
