"""Outputs: maps as Parquet by product and time and as GeoTIFF files, statistics as JSON, isochrones as GeoJSON."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scaled(product: str, value: Column) -> Column:
    """As written: probability in 255ths (cut), spread in metres an hour, intensity as it is."""
    if product == "probability":
        return (value * 255).cast("int")
    return value * 60 if product.startswith("ros") else value


def write_maps(maps: DataFrame, path: str) -> None:
    """maps(product, t10, r, c, value): a directory a product and time."""
    maps.write.mode("overwrite").partitionBy("product", "t10").parquet(path)


def described() -> Column:
    """A row of statistics as a JSON object."""
    return F.to_json(F.struct("time", "timeref", "active", "area_mean", "area_50", "area_75", "area_90"))


def metadata(stats: DataFrame) -> DataFrame:
    """stats as JSON objects, one a row."""
    return stats.select(described().alias("value"))


def write_metadata(stats: DataFrame, path: str) -> None:
    metadata(stats).write.mode("overwrite").text(path)


def write_geojson(collection: DataFrame, path: str) -> None:
    collection.write.mode("overwrite").text(path)


TYPES = {"uint8": (8, 1), "int16": (16, 2), "float32": (32, 3), "float64": (64, 3)}
LON_LAT = 4326


def geotiff(values: np.ndarray, west: float, north: float, step_x: float, step_y: float, nodata: str = "0", crs: int = LON_LAT) -> bytes:
    """A one-band, one-strip GeoTIFF (little-endian, not compressed) with pixel scale, tie point, EPSG code and no-data value."""
    bits, kind = TYPES[values.dtype.name]
    data = np.ascontiguousarray(values).tobytes()
    geographic = crs == LON_LAT
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, crs)
    longer = {33550: (12, struct.pack("<3d", step_x, step_y, 0.0)), 33922: (12, struct.pack("<6d", 0.0, 0.0, 0.0, west, north, 0.0)), 34735: (3, struct.pack(f"<{len(keys)}H", *keys))}
    text = nodata.encode() + b"\0"
    tags = [(256, 4, 1, values.shape[1]), (257, 4, 1, values.shape[0]), (258, 3, 1, bits), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, values.shape[0]), (279, 4, 1, len(data)), (339, 3, 1, kind)]
    at = 8 + len(data) + len(data) % 2
    extra = b""
    for tag, (form, body) in longer.items():
        tags.append((tag, form, len(body) // {12: 8, 3: 2}[form], at + len(extra)))
        extra += body
    if len(text) <= 4:
        tags.append((42113, 2, len(text), int.from_bytes(text.ljust(4, b"\0"), "little")))
    else:
        tags.append((42113, 2, len(text), at + len(extra)))
        extra += text + b"\0" * (len(text) % 2)
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, at + len(extra)) + data + b"\0" * (len(data) % 2) + extra + ifd


#: How a product's files begin.
PREFIX = {"probability": "", "ros_max": "RoS_max_", "ros_mean": "RoS_mean_", "fli_max": "fireline_intensity_max_", "fli_mean": "fireline_intensity_mean_"}


def time_name(t10: int) -> str:
    """A time in tenths of minutes as files bear it: the first is 0, later ones are decimal."""
    return "0" if t10 == 0 else repr(t10 / 10)


def geotiffs(maps: DataFrame, west: float, north: float, step_x: float, step_y: float, crs: int = LON_LAT) -> DataFrame:
    """(product, t10, content binary): a GeoTIFF of each map(product, t10, r, c, value), cut to the cells it has; a map bounds the group."""
    import pandas as pd

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        product, r, c = pdf["product"].iloc[0], pdf.r.to_numpy(), pdf.c.to_numpy()
        top, left = int(r.min()), int(c.min())
        a = np.zeros((int(r.max()) - top + 1, int(c.max()) - left + 1), np.uint8 if product == "probability" else np.float64)
        a[r - top, c - left] = pdf.value.to_numpy()
        content = geotiff(a, west + left * step_x, north - top * step_y, step_x, step_y, crs=crs)
        return pd.DataFrame({"product": [product], "t10": [pdf.t10.iloc[0]], "content": [content]})

    return maps.groupBy("product", "t10").applyInPandas(image, "product string, t10 long, content binary")


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one file through Spark's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(content)
    finally:
        out.close()
