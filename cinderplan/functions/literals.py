"""Geometry literals ``POINT:lat;lon``, ``LINE:[lats];[lons]`` and ``POLYGON:[lats];[lons]`` as structs; times and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbers(text: Column) -> Column:
    """White-space separated numbers, brackets aside, as array<double>."""
    parts = F.split(F.trim(F.translate(text, "[]", "  ")), r"\s+")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("double"))


def parse(literal: Column) -> Column:
    """struct(kind, lats, lons); null kind where the literal has not exactly one colon."""
    parts = F.split(literal, ":", -1)
    values = F.split(F.element_at(parts, 2), ";", -1)
    ok = (F.size(parts) == 2) & (F.size(values) == 2)
    return F.when(ok, F.struct(F.upper(F.trim(F.element_at(parts, 1))).alias("kind"), numbers(F.element_at(values, 1)).alias("lats"), numbers(F.element_at(values, 2)).alias("lons")))


def actions(literals: DataFrame, id_column: str = "id", text: str = "literal") -> DataFrame:
    """(id, kind, lats, lons) for each literal; one that doesn't parse ends the query with an error that names it. Nulls are left out."""
    found = F.when(F.col(text).rlike("^[^:]*:[^:;]*;[^:;]*$"), parse(F.col(text)))
    wrong = F.raise_error(F.concat(F.lit("not a geometry: "), F.col(text)))
    d = literals.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), found.alias("_g"), F.col(text))
    d = d.select("id", F.coalesce("_g", wrong.cast(d.schema["_g"].dataType)).alias("g"))
    return d.select("id", "g.kind", "g.lats", "g.lons")


def points(acts: DataFrame) -> DataFrame:
    """Vertices (id, kind, pos, lat, lon) in order."""
    return acts.select("id", "kind", F.posexplode(F.arrays_zip("lats", "lons")).alias("pos", "p")).select("id", "kind", "pos", F.col("p.lats").alias("lat"), F.col("p.lons").alias("lon"))


def bounding_box(acts: DataFrame) -> DataFrame:
    """One row: extremes of all vertices and the middle."""
    d = acts.agg(*(f(g(c)).alias(f"{n}_{c[:3]}") for c in ("lats", "lons") for f, g, n in ((F.min, F.array_min, "min"), (F.max, F.array_max, "max"))))
    return d.select("*", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("mid_lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("mid_lon"))


def init_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmm"))


def time_reference(start: Column, minutes: Column) -> Column:
    return F.timestamp_add("SECOND", F.rint(minutes * 60).cast("int"), start)


def log_line(minutes: Column, active: Column, area: Column) -> Column:
    """days, hours, minutes - active realizations - hectares."""
    d, h, m = F.floor(minutes / 1440), F.floor(F.pmod(minutes, F.lit(1440)) / 60), F.pmod(minutes, F.lit(60))
    return F.format_string("%dd %dh %dm - %d - %.2f ha", d, h, m.cast("long"), active, area)
