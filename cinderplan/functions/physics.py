"""The fire model's formulas as Column expressions. Angles in radians, counter-clockwise from east; speeds in km/h;
moisture as a fraction; times in minutes. Everything stays inside whole-stage code generation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderplan.tables import CELL

# Coefficients of the published formulas.
D1, D2, D3, D4, D5 = 0.5, 1.4, 8.2, 2.0, 50.0
A = 1 - D1 * D2 * math.tanh(-D4)
PM1 = (-11.507, 22.963, -17.331, 6.598, -1.7211, 1.0003)
PM2 = (-3.5995, 5.2389, -2.6355, 1.019)
MOISTURE_DAMPING = -0.014
SLOPE_R, WIND_R = 0.0693, 0.0576
WIND_W, SLOPE_W, POWER_W = 0.1783, 3.533, 1.2
LATENT = 2442.0
EMBER_WIND, EMBER_MEAN, EMBER_STD, EMBER_P, EMBER_CONIFER = 0.191, 100.0, 25.0, 0.6, 0.4
CONIFER = 5


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def normalize_angle(x: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def wind_angle(degrees: Column) -> Column:
    """Meteorological direction (from, degrees) to the direction of spread."""
    return normalize_angle((180 - degrees + 90) * math.pi / 180)


def wind_module(speed: Column) -> Column:
    return A + D1 * D2 * F.tanh(speed / D3 - D4) + speed / D5


def wind_effect(speed: Column, w_dir: Column, angle: Column) -> Column:
    a = (wind_module(speed) - 1) / 4
    return (a + 1) * (1 - a * a) / (1 - a * F.cos(normalize_angle(w_dir - angle)))


def slope_effect(dh: Column, dist: Column) -> Column:
    s = dh / (CELL * dist)
    return F.pow(F.lit(2.0), F.tanh(F.pow(s * 3, F.lit(2.0)) * F.signum(s)))


def w_h_effect(angle: Column, speed: Column, w_dir: Column, dh: Column, dist: Column) -> Column:
    return slope_effect(dh, dist) * wind_effect(speed, w_dir, angle)


def w_h_effect_on_p(angle: Column, speed: Column, w_dir: Column, dh: Column, dist: Column) -> Column:
    x = w_h_effect(angle, clip(speed, 0, 60), w_dir, dh, dist) - 1
    return F.when(x > 0, x / 2.13).when(x < 0, x / 1.12).otherwise(F.lit(0.0)) + 1


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def moisture_probability_1(m: Column) -> Column:
    return clip(_horner(clip(m, 0, 1) / 0.3, PM1), 0, 1)


def moisture_probability_2(m: Column) -> Column:
    return _horner(m, PM2)


MOISTURE_MODELS: dict[str, Callable[[Column], Column]] = {"default": moisture_probability_1, "new_formula": moisture_probability_1, "rothermel": moisture_probability_2}


def moisture_model(code: str | None) -> Callable[[Column], Column]:
    return MOISTURE_MODELS.get(code or "default", moisture_probability_1)


def spread_probability(p: Column, angle: Column, dist: Column, dh: Column, moisture: Column, w_dir: Column, speed: Column, model: str | None = "new_formula") -> Column:
    """p: nominal probability for the two classes."""
    alpha = w_h_effect_on_p(angle, speed, w_dir, dh, dist)
    return clip((1 - F.pow(1 - p, alpha)) * clip(moisture_model(model)(moisture), 0, 1), 0, 1)


def damping(moisture: Column) -> Column:
    return F.exp(MOISTURE_DAMPING * moisture)


def ros_default(v0: Column, angle: Column, dist: Column, dh: Column, moisture: Column, w_dir: Column, speed: Column) -> Column:
    """Rate of spread in m/min."""
    return clip(v0 / 60 * w_h_effect(angle, speed, w_dir, dh, dist) * damping(moisture), 0.01, 100)


def ros_wang(v0: Column, angle: Column, dist: Column, dh: Column, moisture: Column, w_dir: Column, speed: Column) -> Column:
    slope = F.atan(dh / CELL * dist)  # not dh / (CELL * dist): kept as published by the model
    sf = clip(F.exp(F.signum(dh) * SLOPE_W * F.pow(F.tan(F.abs(slope)), F.lit(POWER_W))), 0.01, 10)
    wf = clip(F.exp(WIND_W * speed * F.cos(w_dir - angle) / 3.6), 0.01, 10)
    return clip(v0 / 60 * wf * sf * damping(moisture), 0.01, 100)


def ros_rothermel(v0: Column, angle: Column, dist: Column, dh: Column, moisture: Column, w_dir: Column, speed: Column) -> Column:
    sf = clip(F.exp(SLOPE_R * F.degrees(F.atan(dh / CELL * dist))), 0.01, 10)
    wf = clip(F.exp(WIND_R * F.degrees(F.atan(0.4226 * speed * F.cos(w_dir - angle) / 3.6))) / 13, 1, 20)
    return clip(v0 / 60 * wf * sf * damping(moisture), 0.01, 100)


ROS_MODELS: dict[str, Callable[..., Column]] = {"default": ros_default, "wang": ros_wang, "rothermel": ros_rothermel}


def ros_model(code: str | None) -> Callable[..., Column]:
    return ROS_MODELS.get(code or "wang", ros_wang)


def travel_time(ros: Column, dist: Column, dh: Column) -> Column:
    """Minutes to cross; whole minutes (half to even) from one minute on, at least 0.1."""
    t = F.sqrt(F.pow(CELL * dist, F.lit(2.0)) + F.pow(dh, F.lit(2.0))) / ros
    return F.greatest(F.when(t >= 1, F.rint(t)).otherwise(t), F.lit(0.1))


def arrival(t: Column, dt: Column) -> Column:
    """t + dt in steps of a tenth of a minute."""
    return F.rint((t + dt) * 10) / 10


def tenths(t: Column) -> Column:
    return F.rint(t * 10).cast("long")


def lhv_dead(hhv: Column, moisture: Column) -> Column:
    return hhv * (1 - moisture / 100) - LATENT * (moisture / 100)


def lhv_canopy(hhv: Column, humidity: Column) -> Column:
    x = hhv * (1 - humidity / 100) - LATENT * (humidity / 100)
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def fireline_intensity(d0: Column, d1: Column, ros: Column, dead: Column, canopy: Column) -> Column:
    return ros * (dead * d0 + canopy * d1) / 60


def fireline_intensity_regrown(d0: Column, d1: Column, ros: Column, dead: Column, canopy: Column, rg: Column) -> Column:
    """With a share rg of regrowth; NaN: unknown."""
    unknown = ros * (dead * d0 + canopy * d1) / 2 / 60
    bare = ros * dead * d0 * (1 - rg) / 2 / 60
    return F.when(F.isnan(rg) | rg.isNull(), unknown).when(d1 == 0, bare).otherwise(ros * (dead * d0 + canopy * d1 * (1 - rg)) / 2 / 60)


def ember_distance(base: Column, angle: Column, w_dir: Column, speed: Column) -> Column:
    """base: a draw from N(EMBER_MEAN, EMBER_STD)."""
    return base * F.exp(speed / 3.6 * EMBER_WIND * (F.cos(w_dir - angle) - 1))


def ember_shift(distance: Column, angle: Column) -> tuple[Column, Column]:
    """Cells (rows, columns) an ember flies, cut towards zero; rows by the cosine."""
    return (distance * F.cos(angle) / CELL).cast("int"), (distance * F.sin(angle) / CELL).cast("int")


def ember_success(veg: Column) -> Column:
    return EMBER_P * (1 + EMBER_CONIFER * (veg == CONIFER).cast("double"))


def noisy_wind(w_dir: Column, speed: Column, u_dir: Column, u_speed: Column) -> tuple[Column, Column]:
    """One draw of each per source, shared by its edges."""
    return w_dir + math.pi / 16 * (0.5 - u_dir), speed * (1.2 - 0.4 * u_speed)


def grid_side(km: float) -> int:
    """Cells a side of a square of km kilometres."""
    return max(300, min(1500, math.floor(km / CELL * 1000)))
