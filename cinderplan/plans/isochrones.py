"""Isochrones: perimeters of the cells burned with at least a given probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderplan.operators import raster

THRESHOLDS = [0.0, 0.5, 0.75, 0.9]
SIGMA, MIN_LENGTH, FRAME = 0.8, 1e-4, 9


def masks(prob: DataFrame, thresholds: list[float] = THRESHOLDS, key: str = "threshold", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, threshold, r, c) where the value reaches the threshold; level 0 means any positive value."""
    d = prob.select(*by, "r", "c", "value", F.explode(F.array(*map(F.lit, thresholds))).alias(key))
    return d.where((F.col("value") >= F.col(key)) & (F.col("value") > 0)).select(*by, key, "r", "c")


def ring_length(path: Column, scale: float = 1.0) -> Column:
    pairs = F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: F.hypot(b["r"] - a["r"], b["c"] - a["c"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) * scale


def isochrones(prob: DataFrame, rows: int, cols: int, thresholds: list[float] = THRESHOLDS, sigma: float = SIGMA, frame: int = FRAME, min_length: float = MIN_LENGTH, smooth: bool = True) -> DataFrame:
    """(threshold, lines array<array<struct<r, c>>>) in cell units: median filter, threshold, opening, rings, smoothing.

    Rings of the burned mask itself, all of them; not only the inner rings of the last polygon.
    """
    v = raster.median(prob, rows, cols, frame) if smooth and raster.smoothing_needed(prob) else prob
    mask = raster.opened(masks(v, thresholds), rows, cols, ("threshold",))
    found = raster.rings(raster.boundary(mask, ("threshold",)), "threshold").where(ring_length(F.col("path")) > min_length)
    path = raster.smooth_ring(F.col("path"), sigma) if smooth else F.col("path")
    return found.groupBy("threshold").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", path.alias("path")))), lambda x: x["path"]).alias("lines"))


def features(lines: DataFrame, time: Column, to_lon_lat) -> DataFrame:
    """lines with f, a MultiLineString feature with time and threshold. to_lon_lat(r, c) gives two Columns."""

    def point(p: Column) -> Column:
        lon, lat = to_lon_lat(p["r"], p["c"])
        return F.array(lon, lat)

    coordinates = F.transform("lines", lambda line: F.transform(line, point))
    return lines.withColumn("f", F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiLineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(time.alias("time"), F.col("threshold").alias("value")).alias("properties")))


def collection(found: DataFrame, order: list[str]) -> DataFrame:
    """One row (value): the features of found in an order, as a FeatureCollection."""
    d = found.agg(F.sort_array(F.collect_list(F.struct(*order, "f"))).alias("fs"))
    return d.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x["f"]).alias("features"))).alias("value"))


def geojson(lines: DataFrame, time: Column, to_lon_lat) -> DataFrame:
    """One row (value): the isochrones of one time."""
    return collection(features(lines, time, to_lon_lat), ["threshold"])


def wkt(path: Column, to_lon_lat) -> Column:
    """A ring as text that other tools read as a line string."""

    def point(p: Column) -> Column:
        lon, lat = to_lon_lat(p["r"], p["c"])
        return F.concat_ws(" ", lon.cast("string"), lat.cast("string"))

    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(path, point), ", "), F.lit(")"))
