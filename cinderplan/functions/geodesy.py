"""Universal transverse Mercator on WGS84, forward and inverse, by the series in the third flattening."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the grid's scale and false easting.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0

N = FLATTENING / (2 - FLATTENING)
RADIUS = MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
ECCENTRICITY = 2 * math.sqrt(N) / (1 + N)


def zone(lat: Column, lon: Column) -> Column:
    """Zone number with the exceptions for Norway and Svalbard."""
    plain = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42), svalbard).otherwise(plain).cast("int")


def forward(lat: Column, lon: Column, zone_number: Column) -> tuple[Column, Column]:
    """(easting, northing)."""
    phi, lam = F.radians(lat), F.radians(lon - (zone_number * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(_atanh(s) - ECCENTRICITY * _atanh(ECCENTRICITY * s))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    north = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return FALSE_EAST + SCALE * RADIUS * east, SCALE * RADIUS * north + F.when(lat < 0, FALSE_NORTH).otherwise(0.0)


def inverse(easting: Column, northing: Column, zone_number: Column, north: bool = True) -> tuple[Column, Column]:
    """(lat, lon)."""
    xi = (northing - (0.0 if north else FALSE_NORTH)) / (SCALE * RADIUS)
    eta = (easting - FALSE_EAST) / (SCALE * RADIUS)
    x = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
    e = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
    chi = F.asin(F.sin(x) / F.cosh(e))
    phi = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
    return F.degrees(phi), zone_number * 6 - 183 + F.degrees(F.atan2(F.sinh(e), F.cos(x)))


def _atanh(x: Column) -> Column:
    return 0.5 * F.log((1 + x) / (1 - x))


def cell_of(easting: Column, northing: Column, west: float, top: float, step_x: float = 20.0, step_y: float = 20.0) -> tuple[Column, Column]:
    """(r, c) of the cell that a point lies in."""
    return F.floor((top - northing) / step_y).cast("int"), F.floor((easting - west) / step_x).cast("int")
