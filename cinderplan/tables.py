"""Lookup tables of the fire model, as plain values and as small DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fuel classes 1 broadleaves, 2 shrubs, 3 bare, 4 grass, 5 conifers, 6 crops, 7 beech.
NOMINAL_SPEED = [140.0, 140.0, 20.0, 120.0, 200.0, 120.0, 60.0]
# d0, d1, hhv, moisture of the canopy in percent (-9999: no canopy)
FUEL = [
    [1.5, 3.0, 20000.0, 60.0],
    [1.0, 3.0, 21000.0, 45.0],
    [0.1, 0.0, 100.0, -9999.0],
    [0.5, 0.0, 17000.0, -9999.0],
    [1.0, 4.0, 21000.0, 55.0],
    [0.5, 2.0, 19000.0, 60.0],
    [1.0, 2.0, 18000.0, 65.0],
]
# nominal probability of spread: row is the class of the destination, column that of the source
SPREAD = [
    [0.3, 0.375, 0.005, 0.25, 0.275, 0.25, 0.25],
    [0.375, 0.375, 0.005, 0.35, 0.4, 0.3, 0.375],
    [0.005, 0.005, 0.005, 0.005, 0.005, 0.005, 0.005],
    [0.45, 0.475, 0.005, 0.475, 0.475, 0.375, 0.475],
    [0.225, 0.325, 0.005, 0.10, 0.35, 0.2, 0.35],
    [0.25, 0.25, 0.005, 0.3, 0.475, 0.35, 0.25],
    [0.075, 0.1, 0.005, 0.075, 0.275, 0.075, 0.075],
]
CELL = 20.0
DIAGONAL = 1.414


def neighbour_rows() -> list[tuple[int, int, int, float, float]]:
    """(k, dr, dc, dist, angle) of the eight neighbours, row by row; angle 0 is east, pi / 2 is north (row - 1)."""
    around = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
    eighth = {(0, 1): 0, (-1, 1): 1, (-1, 0): 2, (-1, -1): 3, (0, -1): 4, (1, -1): -3, (1, 0): -2, (1, 1): -1}
    return [(k, dr, dc, DIAGONAL if dr and dc else 1.0, math.pi * eighth[dr, dc] / 4) for k, (dr, dc) in enumerate(around)]


def veg_rows(speed: list[float] = NOMINAL_SPEED, fuel: list[list[float]] = FUEL) -> list[tuple]:
    return [(k + 1, v, *f) for k, (v, f) in enumerate(zip(speed, fuel, strict=True))]


def spread_rows(table: list[list[float]] = SPREAD) -> list[tuple[int, int, float]]:
    return [(to + 1, src + 1, p) for to, row in enumerate(table) for src, p in enumerate(row)]


def neighbours(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(neighbour_rows(), "k int, dr int, dc int, dist double, angle double")


def veg_params(spark: SparkSession, speed: list[float] = NOMINAL_SPEED, fuel: list[list[float]] = FUEL) -> DataFrame:
    """(veg, v0, d0, d1, hhv, hum): a row a fuel class."""
    return spark.createDataFrame(veg_rows(speed, fuel), "veg int, v0 double, d0 double, d1 double, hhv double, hum double")


def spread_table(spark: SparkSession, table: list[list[float]] = SPREAD) -> DataFrame:
    """(veg_to, veg_from, p): 49 rows."""
    return spark.createDataFrame(spread_rows(table), "veg_to int, veg_from int, p double")


def read_table(spark: SparkSession, path: str) -> list[list[float]]:
    """A white-space separated table of numbers with # comments, for overriding one of the above."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v"), F.monotonically_increasing_id().alias("i")).where("v <> ''").orderBy("i")
    return [[float(x) for x in r["v"].split()] for r in lines.collect()]  # a lookup table of at most 7 x 7 numbers


def poisson_cdf(mean: float = 2.0, most: int = 20) -> list[float]:
    """P(N <= n) for n = 0..most."""
    total, term, out = 0.0, math.exp(-mean), []
    for n in range(most + 1):
        total += term
        out.append(total)
        term *= mean / (n + 1)
    return out
