"""A whole run: parameters, grids and ignitions in, event relation and snapshot products out."""

from __future__ import annotations

import functools
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderplan import sinks
from cinderplan.functions import geodesy, literals
from cinderplan.operators import drawing, products, reproject
from cinderplan.plans import isochrones, spread
from cinderplan.sources import grids, gridtiff, params
from cinderplan.sources.grids import GridMeta
from cinderplan.store import folder, stored

log = logging.getLogger(__name__)


@dataclass
class Settings:
    n: int
    every10: int
    limit10: int
    tileset: str
    rules: spread.Rules
    init_date: str | None


class Simulation:
    """Simulation(spark, params).load_files(...) or .load_tiles(...), then .run() and the products."""

    def __init__(self, spark: SparkSession, p: DataFrame, seed: int = 42, time_limit_hours: float | None = None, spotting: bool = False):
        self.spark = spark
        self.p = stored(p, "params")
        row = self.p.first()
        limit = params.time_limit(row["time_limit"], time_limit_hours)
        self.bc = stored(params.conditions(self.p), "conditions")
        limit10 = round(limit * 10) if limit else spread.NEVER
        rules = spread.Rules(seed=seed, ros_model=row["ros_model"], moisture_model=row["prob_moist_model"], limit10=limit10, spotting=params.spotting(row["do_spotting"], spotting))
        for name, at in (("prob_file", "spread"), ("v0_file", "speed"), ("p_vegetation", "fuel")):
            if row[name]:
                from cinderplan.tables import read_table

                found = read_table(spark, row[name])
                setattr(rules, at, [x for line in found for x in line] if at == "speed" else found)
        self.settings = Settings(row["n_threads"], round(row["time_resolution"] * 10), limit10, row["tileset"], rules, row["init_date"])
        self.ignitions = literals.actions(params.ignitions(self.p, self.bc), "time").withColumnRenamed("id", "time")
        if self.ignitions.isEmpty():
            raise grids.SpreadError("no ignitions")
        self.meta: GridMeta | None = None
        self.cells: DataFrame | None = None

    def load_files(self, veg: str, dem: str, zone: int = 0) -> Simulation:
        """zone: the UTM zone of files that don't say theirs."""
        a, b = gridtiff.read_meta(self.spark, veg, zone), gridtiff.read_meta(self.spark, dem, zone)
        if not grids.consistent(a, b):
            raise grids.SpreadError("the rasters don't match")
        if not a.zone:
            raise grids.SpreadError("the rasters name no UTM zone")
        self.meta = a
        self.cells = grids.from_rasters(gridtiff.read(self.spark, veg), gridtiff.read(self.spark, dem), a.rows, a.cols)
        return self

    def load_tiles(self, tiles: DataFrame, tile_side: int, side: int | None = None, top_left: tuple[float, float] = (0.0, 0.0), step: float = 20.0) -> Simulation:
        """The window around the middle of all ignitions; tiles are numbered from top_left (easting, northing) of the zone."""
        box = literals.bounding_box(self.ignitions).first()
        row = self.spark.createDataFrame([(box["mid_lat"], box["mid_lon"])], "lat double, lon double")
        zone = geodesy.zone(F.col("lat"), F.col("lon"))
        e, n, z = row.select(*geodesy.forward(F.col("lat"), F.col("lon"), zone), zone).first()
        from cinderplan.functions.physics import grid_side

        side = side or grid_side(self.p.first()["grid_dim_km"])
        left, top = int((e - top_left[0]) // step) - side // 2, int((top_left[1] - n) // step) - side // 2
        self.cells = grids.tile_cells(tiles, z, top, left, side, tile_side, self.settings.tileset)
        self.meta = GridMeta(top_left[0] + left * step, top_left[1] - top * step, step, step, side, side, z, box["mid_lat"] < 0)
        return self

    def load_cells(self, cells: DataFrame, meta: GridMeta) -> Simulation:
        self.cells, self.meta = cells, meta
        return self

    def run(self, plan: str = "block") -> Simulation:
        m, s = self.meta, self.settings
        self.__dict__.pop("_maps", None)  # of an earlier run
        contour, covered = drawing.rasterized(self.ignitions, m, ["time"])
        start = spread.seeds(contour, s.n, F.rint(F.col("time") * 10))
        interior = covered.where("time = 0").select("r", "c").join(contour.where("time = 0").select("r", "c"), ["r", "c"], "left_anti")
        self.interior = stored(interior.distinct(), "interior")
        moist = stored(drawing.moisture_overlays(self.bc, m, s.rules.seed), "moist")
        heavy = stored(drawing.heavy_cells(self.bc, m), "heavy")
        field = spread.prepare(self.cells, self.bc, s.rules, m.rows, m.cols, self.interior, moist, heavy)
        if plan == "tick":
            burned, tried = spread.by_tick(field, start)
            self.burned, self.tried = stored(burned, "burned"), tried
        else:
            self.burned = stored({"block": spread.by_blocks, "epoch": spread.by_epoch, "group": spread.by_group}[plan](field, start), "burned")
            self.tried = stored(spread.attempts_of(field, self.burned), "attempts")
        return self

    def last10(self) -> int:
        if self.settings.limit10 < spread.NEVER:
            return self.settings.limit10
        return (self.burned.agg(F.max("t_burn")).first()[0] or 0) // self.settings.every10 * self.settings.every10

    @functools.cached_property
    def _maps(self) -> DataFrame:
        s, last = self.settings, self.last10()
        whole = self.interior.select(F.explode(F.sequence(F.lit(0), F.lit(s.n - 1))).alias("rz"), "r", "c", F.lit(0).cast("long").alias("t_burn"))
        burned = self.burned.select("rz", "r", "c", "t_burn").unionByName(whole)
        out = products.running(burned, "t_burn", s.every10, last, ["r", "c"], {"n": F.count("*")}, {"n": F.sum})
        out = out.select("s10", "r", "c", (F.col("n") / F.lit(float(s.n))).alias("value"), F.lit("probability").alias("product"))
        tried = self.tried.where("ros is not null").select("rz", F.col("nr").alias("r"), F.col("nc").alias("c"), "ros", "fli", "t_src", F.col("r").alias("fr"), F.col("c").alias("fc"), "k", "dup")
        latest = F.max(F.struct("t_src", "fr", "fc", "k", "dup", "ros", "fli"))
        now = products.running(tried, "t_src", s.every10, last, ["rz", "r", "c"], {"v": latest}, {"v": F.max}).select("s10", "r", "c", "v.ros", "v.fli")
        for name, f, v in (("ros_max", products.largest, "ros"), ("ros_mean", products.mean_positive, "ros"), ("fli_max", products.largest, "fli"), ("fli_mean", products.mean_positive, "fli")):
            out = out.unionByName(f(now, v, ["s10"]).withColumn("product", F.lit(name)))
        return stored(out.select("product", F.col("s10").alias("t10"), "r", "c", "value"), "maps")

    def maps(self) -> DataFrame:
        """(product, t10, r, c, value) at every snapshot: probability, ros_max, ros_mean, fli_max, fli_mean; computed once a run."""
        return self._maps

    def stats(self) -> DataFrame:
        """A row a snapshot: time (minutes), timeref, active, area_mean, area_50, area_75, area_90."""
        s, last = self.settings, self.last10()
        area = products.area_stats(self.maps().where("product = 'probability'"), self.meta.step_x, self.meta.step_y, ["t10"])
        # an event is pending at the snapshots from its source's time until before its own
        ends = F.least(F.lit(last // s.every10 * s.every10), (F.ceil(F.col("t_arr") / s.every10) - 1) * s.every10).cast("long")
        pending = self.tried.withColumns({"_from": products.first_snapshot("t_src", s.every10), "_to": ends}).where("_from <= _to")
        pending = pending.select("rz", F.explode(F.sequence("_from", "_to", F.lit(s.every10).cast("long"))).alias("s10"))
        act = products.active(pending, ["s10"]).withColumnRenamed("s10", "t10")
        d = products.snapshots(self.spark, last, s.every10).withColumnRenamed("s10", "t10").join(area, "t10", "left").join(act, "t10", "left")
        start = literals.init_date(F.lit(s.init_date)) if s.init_date else F.current_timestamp()
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("active", "area_mean", "area_50", "area_75", "area_90")}
        return d.withColumns(zero).withColumn("time", F.col("t10") / 10).withColumn("timeref", literals.time_reference(start, F.col("t10") / 10))

    def isochrones(self, t10: int) -> DataFrame:
        prob = self.maps().where((F.col("product") == "probability") & (F.col("t10") == t10)).select("r", "c", "value")
        return isochrones.isochrones(prob, self.meta.rows, self.meta.cols)

    def lon_lat(self, r, c):
        m = self.meta
        lat, lon = geodesy.inverse(F.lit(m.west) + c * m.step_x, F.lit(m.north) - r * m.step_y, F.lit(m.zone), not m.south_half)
        return lon, lat

    def write(self, path: str) -> None:
        """Per snapshot and product a GeoTIFF in degrees and its statistics as JSON; isochrones up to each snapshot as GeoJSON; all
        maps, in grid cells, as Parquet. Writes a line of progress a snapshot to the log."""
        value = F.col("value")
        for p in ("probability", "ros_max", "ros_mean"):
            value = F.when(F.col("product") == p, sinks.scaled(p, F.col("value")).cast("double")).otherwise(value)
        maps = self.maps().withColumn("value", value)
        sinks.write_maps(maps, f"{path}/maps")
        stats = stored(self.stats(), "stats")
        sinks.write_metadata(stats, f"{path}/stats")
        about = {r["t10"]: r["value"] for r in stats.select("t10", sinks.described().alias("value")).collect()}  # a row a snapshot
        to = reproject.lon_lat_grid(self.spark, self.meta)
        images = stored(sinks.geotiffs(reproject.reprojected(maps, self.meta, to, ("product", "t10")), to.west, to.north, to.step_lon, to.step_lat), "images")
        for row in images.toLocalIterator():  # a map at a time
            name = f"{path}/{sinks.PREFIX[row['product']]}{sinks.time_name(row['t10'])}"
            sinks.put(self.spark, f"{name}.tiff", bytes(row["content"]))
            sinks.put(self.spark, f"{name}.json", about[row["t10"]].encode())
        lines = folder(self.spark, "isochrones")
        for row in stats.select("t10", "active", "area_mean", literals.log_line(F.col("time"), F.col("active"), F.col("area_mean")).alias("line")).orderBy("t10").collect():  # a row a snapshot
            t = row["t10"]
            self.isochrones(t).withColumn("t10", F.lit(t).cast("long")).write.mode("append").parquet(lines)
            found = isochrones.features(self.spark.read.parquet(lines), F.col("t10") / 10, self.lon_lat)
            text = isochrones.collection(found, ["t10", "threshold"]).first()["value"]
            sinks.put(self.spark, f"{path}/isochrones_{sinks.time_name(t)}.geojson", text.encode())
            log.info(row["line"])
