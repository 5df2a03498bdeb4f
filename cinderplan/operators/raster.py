"""Raster operators on sparse cells: stencils, morphology, median, trimming, tracing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in pairs)))


def spread_to(cells: DataFrame, pairs: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """Each row once for every offset, moved by it."""
    d = cells.select(*keep, "r", "c", offsets(pairs).alias("_o"))
    return d.select(*keep, (F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c"))


def inside(d: DataFrame, rows: int, cols: int) -> DataFrame:
    return d.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))


def dilated(mask: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of mask(keys, r, c) and their four neighbours, within the grid."""
    return inside(spread_to(mask, CROSS, list(keys)), rows, cols).distinct()


def eroded(mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells whose four neighbours are in mask too; beyond the grid counts as out."""
    votes = spread_to(mask.select(*keys, "r", "c").distinct(), CROSS, list(keys)).groupBy(*keys, "r", "c").count()
    return votes.where("count = 5").select(*keys, "r", "c")


def opened(mask: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return dilated(eroded(mask, keys), rows, cols, keys)


def median(values: DataFrame, rows: int, cols: int, size: int = 9) -> DataFrame:
    """(r, c, value): median of the size x size frame around each cell of the grid that a non-zero value reaches; zeros pad."""
    half, n = size // 2, size * size
    frame = [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1)]
    d = inside(spread_to(values.where("value <> 0"), frame, ["value"]), rows, cols).groupBy("r", "c").agg(F.collect_list("value").alias("v"))
    padded = F.sort_array(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(n) - F.size("v"))))
    return d.select("r", "c", F.element_at(padded, n // 2 + 1).alias("value"))


def smoothing_needed(values: DataFrame, least: int = 100) -> bool:
    return values.where("value > 0").limit(least + 1).count() > least


def bounds(values: DataFrame, margin: int = 1) -> DataFrame:
    """One row (r0, r1, c0, c1, shift...): the box of positive cells and a margin around it, last row and column excluded."""
    d = values.where("value > 0").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return d.select((F.col("r0") - margin).alias("r0"), (F.col("r1") + margin + 1).alias("r1"), (F.col("c0") - margin).alias("c0"), (F.col("c1") + margin + 1).alias("c1"))


def trimmed(values: DataFrame, rows: int, cols: int) -> DataFrame:
    """values within ``bounds``, shifted to start at (0, 0); without positive cells the middle 2 x 2 of the grid."""
    b = F.broadcast(bounds(values))  # one row
    mid_r, mid_c = rows // 2 - 1, cols // 2 - 1
    r0, c0 = F.greatest(F.coalesce("r0", F.lit(mid_r)), F.lit(0)), F.greatest(F.coalesce("c0", F.lit(mid_c)), F.lit(0))
    r1, c1 = F.least(F.coalesce("r1", F.lit(mid_r + 2)), F.lit(rows)), F.least(F.coalesce("c1", F.lit(mid_c + 2)), F.lit(cols))
    d = values.join(b, F.lit(True)).where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    return d.select((F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), "value")


def boundary(mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sides of mask cells that face a cell outside it, as directed unit edges (r0, c0) -> (r1, c1) between cell corners, mask on the right."""
    sides = {(-1, 0): (0, 0, 0, 1), (0, 1): (0, 1, 1, 1), (1, 0): (1, 1, 1, 0), (0, -1): (1, 0, 0, 0)}
    rows = [F.struct(*(F.lit(v).alias(n) for v, n in zip((*o, *e), ("dr", "dc", "a", "b", "x", "y"), strict=True))) for o, e in sides.items()]
    m = mask.select(*keys, "r", "c").distinct()
    d = m.select(*keys, "r", "c", F.explode(F.array(*rows)).alias("s")).select(*keys, "r", "c", (F.col("r") + F.col("s.dr")).alias("_r"), (F.col("c") + F.col("s.dc")).alias("_c"), "s")
    other = m.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"))
    d = d.join(other, [*keys, "_r", "_c"], "left_anti")
    at = lambda a, b: (F.col(a) + F.col(f"s.{b}"))
    return d.select(*keys, at("r", "a").alias("r0"), at("c", "b").alias("c0"), at("r", "x").alias("r1"), at("c", "y").alias("c1"))


def rings(edges: DataFrame, key: str) -> DataFrame:
    """(key, ring, outer, path array<struct<r, c>>): boundary edges stitched to closed rings, one key a group.

    A ring is sequential by nature; a group is the boundary of one map, which a grid's perimeter bounds.
    """

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b, x, y in sorted(zip(pdf.r0, pdf.c0, pdf.r1, pdf.c1, strict=True)):
            out.setdefault((a, b), []).append((x, y))
        rows, k = [], 0
        while out:
            start = at = min(out)
            path, way = [start], None
            while True:
                ends = out[at]
                if way and len(ends) > 1:  # where two rings touch, turn right: each cell keeps to its own ring
                    turns = [((way[1] * (x - at[0]) - way[0] * (y - at[1])), (x, y)) for x, y in ends]
                    end = max(turns)[1]
                else:
                    end = ends[0]
                ends.remove(end)
                if not ends:
                    del out[at]
                way, at = (end[0] - at[0], end[1] - at[1]), end
                path.append(at)
                if at == start:
                    break
            area = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(path, path[1:]))
            rows.append((pdf[key].iloc[0], k, area > 0, [{"r": float(a), "c": float(b)} for a, b in path]))
            k += 1
        return pd.DataFrame(rows, columns=[key, "ring", "outer", "path"])

    kind = dict(edges.dtypes)[key]
    return edges.groupBy(key).applyInPandas(stitch, f"{key} {kind}, ring int, outer boolean, path array<struct<r:double,c:double>>")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def smooth(values: Column, sigma: float) -> Column:
    """An array convolved with a Gaussian, mirrored at its ends (edge values twice)."""
    w = gaussian_weights(sigma)
    half = len(w) // 2
    n = F.size(values)

    def at(i: Column) -> Column:
        j = F.pmod(i, 2 * n)
        return F.element_at(values, F.when(j < n, j + 1).otherwise(2 * n - j))

    return F.transform(values, lambda _, i: sum((F.lit(x) * at(i + (k - half)) for k, x in enumerate(w)), F.lit(0.0)))


def smooth_ring(path: Column, sigma: float, x: str = "c", y: str = "r") -> Column:
    """A closed ring with smoothed coordinates; the last point is the first again."""
    xs, ys = smooth(F.transform(path, lambda p: p[x]), sigma), smooth(F.transform(path, lambda p: p[y]), sigma)
    z = F.zip_with(xs, ys, lambda a, b: F.struct(a.alias(x), b.alias(y)))
    return F.transform(F.array(z), lambda a: F.concat(F.slice(a, 1, F.size(a) - 1), F.slice(a, 1, 1)))[0]

