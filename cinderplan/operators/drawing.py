"""Points, segments, polylines and polygons drawn into cells, and fire-fighting actions as overlays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderplan.functions import geodesy, keyed, literals
from cinderplan.operators import raster
from cinderplan.sources.grids import GridMeta

CELLS = "array<struct<r:int,c:int>>"
# Moisture that each action leaves, in overlay order.
WATERLINE, CANADAIR_BUFFER, CANADAIR, HELICOPTER_BUFFER, HELICOPTER = 0.27, 0.22, 0.25, 0.20, 0.22


def segment(c0: Column, r0: Column, c1: Column, r1: Column) -> Column:
    """Cells of a segment, 8-connected, both ends included: the error term decides each step (twice it against both spans)."""
    dc, dr = F.abs(c1 - c0), F.abs(r1 - r0)
    sc, sr = F.when(c0 < c1, 1).otherwise(-1), F.when(r0 < r1, 1).otherwise(-1)
    cell = lambda r, c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"))
    start = F.struct(r0.cast("int").alias("r"), c0.cast("int").alias("c"), (dc - dr).cast("int").alias("e"), F.array(cell(r0, c0)).cast(CELLS).alias("p"))

    def step(s: Column, _: Column) -> Column:
        go_c, go_r = 2 * s["e"] > -dr, 2 * s["e"] < dc
        r = s["r"] + F.when(go_r, sr).otherwise(0)
        c = s["c"] + F.when(go_c, sc).otherwise(0)
        e = s["e"] - F.when(go_c, dr).otherwise(0) + F.when(go_r, dc).otherwise(0)
        return F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), e.cast("int").alias("e"), F.concat(s["p"], F.array(cell(r, c))).alias("p"))

    steps = F.greatest(dc, dr).cast("int")
    return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, step)["p"]


def polyline(path: Column) -> Column:
    """Cells along array<struct<r, c>>; a shared vertex once."""
    pairs = F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    drawn = F.transform(pairs, lambda p, i: F.transform(F.array(segment(p["a"]["c"], p["a"]["r"], p["b"]["c"], p["b"]["r"])), lambda s: F.when(i > 0, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s))[0])
    return F.flatten(drawn)


def outline(path: Column) -> Column:
    """The contour of a polygon: its polyline and the closing segment, whose end repeats the first vertex."""
    first, last = F.element_at(path, 1), F.element_at(path, -1)
    closing = F.transform(F.array(segment(last["c"], last["r"], first["c"], first["r"])), lambda s: F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))))[0]
    return F.concat(polyline(path), closing)


def cells_of(shapes: DataFrame, keys: list[str], cells: Column, rows: int, cols: int) -> DataFrame:
    """(keys, pos, r, c) of drawn cells within the grid."""
    d = shapes.select(*keys, F.posexplode(cells).alias("pos", "p")).select(*keys, "pos", F.col("p.r").alias("r"), F.col("p.c").alias("c"))
    return raster.inside(d, rows, cols)


def filled(contours: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, c): each polygon's contour and what a 4-connected flood from outside its box doesn't reach.

    One polygon is flooded in one place, within its own box; its size is bounded by the grid.
    """

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        wall = set(zip(pdf.r, pdf.c, strict=True))
        r0, r1, c0, c1 = pdf.r.min() - 1, pdf.r.max() + 1, pdf.c.min() - 1, pdf.c.max() + 1
        seen, todo = {(r0, c0)}, [(r0, c0)]
        while todo:
            r, c = todo.pop()
            for x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if r0 <= x[0] <= r1 and c0 <= x[1] <= c1 and x not in seen and x not in wall:
                    seen.add(x)
                    todo.append(x)
        rest = [(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if (r, c) not in seen]
        out = pd.DataFrame(rest, columns=["r", "c"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "r", "c"]]

    kinds = dict(contours.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", r int, c int"
    return contours.groupBy(*keys).applyInPandas(flood, schema)


def on_grid(acts: DataFrame, meta: GridMeta, keys: list[str]) -> DataFrame:
    """(keys, kind, path array<struct<r, c>>) of parsed actions (keys, kind, lats, lons), in the grid's own zone."""

    def cell(p: Column) -> Column:
        e, n = geodesy.forward(p["lats"], p["lons"], F.lit(meta.zone))
        r, c = geodesy.cell_of(e, n, meta.west, meta.north, meta.step_x, meta.step_y)
        return F.struct(r.alias("r"), c.alias("c"))

    return acts.select(*keys, "kind", F.transform(F.arrays_zip("lats", "lons"), cell).alias("path"))


def rasterized(acts: DataFrame, meta: GridMeta, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(contours, covered): cells (keys, r, c) that actions draw; polygons are filled in ``covered``. Points off the grid drop out."""
    shapes = on_grid(acts, meta, keys)
    path = F.col("path")
    line = cells_of(shapes.where("kind = 'LINE'"), keys, polyline(path), meta.rows, meta.cols)
    point = cells_of(shapes.where("kind = 'POINT'"), keys, F.slice(path, 1, 1).cast(CELLS), meta.rows, meta.cols)
    around = cells_of(shapes.where("kind = 'POLYGON'").withColumn("_id", F.monotonically_increasing_id()), [*keys, "_id"], outline(path), meta.rows, meta.cols)
    open_ones = line.unionByName(point).select(*keys, "r", "c")
    contours = open_ones.unionByName(around.select(*keys, "r", "c")).distinct()
    covered = open_ones.unionByName(filled(around, [*keys, "_id"]).select(*keys, "r", "c")).distinct()
    return contours, covered


def _literals(bc: DataFrame, name: str) -> DataFrame:
    return literals.actions(bc.select("bc_id", F.explode(name).alias("literal")), "bc_id").withColumnRenamed("id", "bc_id")


def moisture_overlays(bc: DataFrame, meta: GridMeta, seed: int = 0) -> DataFrame:
    """(bc_id, r, c, moist): what waterlines, Canadair drops and helicopters leave; where they overlap the later kind holds."""
    keys, size = ["bc_id"], (meta.rows, meta.cols)
    canadair = _literals(bc, "canadair").select("bc_id", "kind", F.when(F.col("kind") == "LINE", F.col("lats")).otherwise(F.raise_error(F.lit("a Canadair drop must be a LINE"))).alias("lats"), "lons")
    _, water = rasterized(_literals(bc, "waterline_action"), meta, keys)
    _, drops = rasterized(canadair, meta, keys)
    _, at = rasterized(_literals(bc, "helicopter"), meta, keys)
    shift = lambda axis: keyed.jitter(keyed.uniform(seed, F.col("bc_id"), F.col("r"), F.col("c"), f"heli_{axis}"))
    heli = raster.inside(at.select("bc_id", (F.col("r") + shift("r")).alias("r"), (F.col("c") + shift("c")).alias("c")), *size).distinct()
    layers = [(raster.dilated(water, *size, ("bc_id",)), WATERLINE), (raster.dilated(drops, *size, ("bc_id",)), CANADAIR_BUFFER), (drops, CANADAIR), (raster.dilated(heli, *size, ("bc_id",)), HELICOPTER_BUFFER), (heli, HELICOPTER)]
    every = None
    for k, (d, v) in enumerate(layers):
        d = d.select("bc_id", "r", "c", F.lit(k).alias("priority"), F.lit(v).alias("moist"))
        every = d if every is None else every.unionByName(d)
    return resolved(every, ["bc_id"])


def resolved(layers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, c, moist): the layer of highest priority wins."""
    return layers.groupBy(*keys, "r", "c").agg(F.max_by("moist", "priority").alias("moist"))


def heavy_cells(bc: DataFrame, meta: GridMeta) -> DataFrame:
    """(r, c, heavy_t10): from when on a cell cannot burn."""
    _, drawn = rasterized(_literals(bc, "heavy_action"), meta, ["bc_id"])
    d = raster.dilated(drawn, meta.rows, meta.cols, ("bc_id",)).join(F.broadcast(bc.select("bc_id", F.rint(F.col("time") * 10).cast("long").alias("t10"))), "bc_id")  # a job's conditions
    return d.groupBy("r", "c").agg(F.min("t10").alias("heavy_t10"))
