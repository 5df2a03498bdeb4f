"""Random draws as pure functions of keys: the same key gives the same draw on any engine, partitioning or retry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderplan import tables


def uniform(*key: Column | str | int) -> Column:
    """U[0, 1) from the first 32 bits of md5 of the key's parts joined by |."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(u: Column, v: Column, mean: float = 0.0, std: float = 1.0) -> Column:
    """Box and Muller's transform of two uniforms."""
    return mean + std * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def poisson(u: Column, mean: float = 2.0) -> Column:
    """Inverse distribution function."""
    return sum(((u >= p).cast("int") for p in tables.poisson_cdf(mean)), F.lit(0))


def jitter(u: Column) -> Column:
    """-1, 0 or 1 with probabilities 1/4, 1/2, 1/4."""
    return (F.rint(2 * u) - 1).cast("int")


def bernoulli(p: Column, u: Column) -> Column:
    return p > u
