"""Spread plans agree row for row; deterministic runs are shortest paths; a whole job runs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderplan import cli, sinks
from cinderplan.functions import literals
from cinderplan.operators import products
from cinderplan.plans import spread
from cinderplan.plans.simulation import Simulation
from cinderplan.sources import grids, gridtiff, params
from cinderplan.sources.grids import GridMeta

BC = "bc_id int, time double, w_dir double, w_speed double, moisture double"


def field(spark, rules, side=15, veg=4, slope=-5.0, **more):
    bc = spark.createDataFrame([(0, 0.0, 335.0, 9.0, 0.0), (1, 12.0, 0.0, 40.0, 5.0)], BC)
    return spread.prepare(grids.synthetic(spark, side, side, veg, slope), bc, rules, side, side, **more)


def start(spark, n=3, side=15):
    return spread.seeds(spark.createDataFrame([(side // 2, side // 2)], "r int, c int"), n)


def table(df):
    return sorted(tuple(r) for r in df.select("rz", "r", "c", "t_burn").collect())


@pytest.mark.parametrize(("veg", "straight", "diagonal"), [(4, 100, 140), (5, 60, 80)])
def test_certain_spread_is_shortest_path(spark, veg, straight, diagonal):
    bc = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0)], BC)
    f = spread.prepare(grids.synthetic(spark, 17, 17, veg, 0.0), bc, spread.Rules(certain=True, noise=False, limit10=300), 17, 17)
    got = spread.by_epoch(f, start(spark, 1, 17)).collect()
    for r in got:
        a, b = sorted((abs(r.r - 8), abs(r.c - 8)))
        assert r.t_burn == diagonal * a + straight * (b - a)
    assert len(got) == {4: 29, 5: 81}[veg]


def test_plans_agree(spark):
    heavy = spark.createDataFrame([(5, c, 100) for c in range(15)], "r int, c int, heavy_t10 long")
    moist = spark.createDataFrame([(0, 9, c, 0.27) for c in range(15)], "bc_id int, r int, c int, moist double")
    f = field(spark, spread.Rules(limit10=250), heavy=heavy, moist=moist)
    epoch = spread.by_epoch(f, start(spark))
    tick, tried = spread.by_tick(f, start(spark))
    group = spread.by_group(f, start(spark))
    assert table(epoch) == table(tick) == table(group) and len(table(epoch)) > 10
    assert table(spread.by_blocks(f, start(spark), 6)) == table(epoch)
    key = ("rz", "r", "c", "nr", "nc", "k", "t_src", "t_arr")
    assert sorted(tuple(r) for r in tried.select(*key).collect()) == sorted(tuple(r) for r in spread.attempts_of(f, epoch).select(*key).collect())
    for r in epoch.collect():
        assert r.r != 5 or r.t_burn < 100


def test_spotting_agrees(spark):
    f = field(spark, spread.Rules(limit10=200, spotting=True), veg=5)
    epoch = table(spread.by_epoch(f, start(spark, 2)))
    assert epoch == table(spread.by_group(f, start(spark, 2))) == table(spread.by_blocks(f, start(spark, 2), 5))
    plain = table(spread.by_epoch(field(spark, spread.Rules(limit10=200), veg=5), start(spark, 2)))
    assert set(x[:3] for x in plain) <= set(x[:3] for x in epoch)


def test_multiplicity_only_adds(spark):
    f = field(spark, spread.Rules(limit10=60), 9)
    first, _ = spread.by_tick(f, start(spark, 2, 9))
    more, _ = spread.by_tick(f, start(spark, 2, 9), multiplicity="reference")
    assert more.count() >= first.count() > 0


def test_one_bucket_beyond_the_limit(spark):
    f = field(spark, spread.Rules(limit10=30), 9)
    plain, _ = spread.by_tick(f, start(spark, 2, 9))
    more, _ = spread.by_tick(f, start(spark, 2, 9), overshoot=True)
    extra = {r.t_burn for r in more.collect()} - {r.t_burn for r in plain.collect()}
    assert len(extra) == 1 and min(extra) > 30 and plain.agg({"t_burn": "max"}).first()[0] <= 30


def test_one_edge_burns_as_often_as_its_probability(spark):
    f = field(spark, spread.Rules(limit10=spread.NEVER, noise=False), 5, slope=0.0)
    n = 4000
    src = spark.range(n).select(F.col("id").cast("int").alias("rz"), F.lit(2).alias("r"), F.lit(2).alias("c"), F.lit(0).cast("long").alias("t10"), F.lit(0).alias("dup"))
    from cinderplan.functions import physics

    lit = lambda x: F.lit(float(x))
    p = spark.range(1).select(physics.spread_probability(lit(0.475), lit(0), lit(1), lit(0), lit(0), physics.wind_angle(lit(335)), lit(9))).first()[0]
    hit = f.attempts(src).where("nr = 2 and nc = 3").count()
    assert abs(hit / n - p) < 4 * (p * (1 - p) / n) ** 0.5


def test_products(spark):
    rows = spark.createDataFrame([(0, 1, 1, 0.0), (1, 1, 1, 4.0), (2, 1, 1, 2.0), (0, 2, 2, 0.0), (1, 2, 2, float("nan"))], "rz int, r int, c int, ros double")
    assert {(r.r, r.value) for r in products.mean_positive(rows, "ros").collect()} == {(1, 3.0), (2, 0.0)}
    assert {(r.r, r.value) for r in products.largest(rows, "ros").collect()} == {(1, 4.0), (2, 0.0)}


def test_whole_job(spark, tmp_path):
    job = {"time_limit": 20, "time_resolution": 10, "n_threads": 3, "init_date": "202209011500", "do_spotting": False, "ignitions": ["POINT: 44.32372526549074;8.45040310174227"], "boundary_conditions": [{"time": 0, "w_dir": 10, "w_speed": 30, "moisture": 0, "waterline_action": ["LINE:[44.3240 44.3240];[8.4495 8.4515]"], "helicopter": ["POINT: 44.3230;8.4505"], "heavy_action": ["LINE:[44.3225 44.3225];[8.4495 8.4515]"]}]}
    (tmp_path / "p.json").write_text(json.dumps(job))
    s = Simulation(spark, params.read(spark, f"file://{tmp_path}/p.json"))
    meta = GridMeta(455976.0, 4908176.0, 20.0, 20.0, 21, 21, 32)
    s.load_cells(grids.synthetic(spark, 21, 21), meta).run()
    stats = s.stats().orderBy("t10").collect()
    assert [r.t10 for r in stats] == [0, 100, 200]
    area = [r.area_mean for r in stats]
    assert area == sorted(area) and area[0] == pytest.approx(0.04)
    assert all(r.area_50 >= r.area_75 >= r.area_90 for r in stats)
    assert str(stats[1].timeref) == "2022-09-01 15:10:00"
    s.write(f"file://{tmp_path}/out")
    maps = spark.read.parquet(f"file://{tmp_path}/out/maps")
    assert {r[0] for r in maps.select("product").distinct().collect()} == {"probability", "ros_max", "ros_mean", "fli_max", "fli_mean"}
    geo = json.loads((tmp_path / "out/isochrones_20.0.geojson").read_text())
    assert geo["type"] == "FeatureCollection" and {f["properties"]["time"] for f in geo["features"]} <= {0.0, 10.0, 20.0}
    names = {f"{p}{t}" for p in ("", "RoS_max_", "RoS_mean_", "fireline_intensity_max_", "fireline_intensity_mean_") for t in ("10.0", "20.0")} | {"0"}
    for n in names:
        about = json.loads((tmp_path / f"out/{n}.json").read_text())
        data = (tmp_path / f"out/{n}.tiff").read_bytes()
        assert about["time"] == float(n.rsplit("_", 1)[-1]) and gridtiff.tags(data)[1][gridtiff.KEYS][-1] == 4326
        assert gridtiff.image(data).max() > 0
    last = maps.where("product = 'probability' and t10 = 200").agg({"value": "max"}).first()[0]
    assert gridtiff.image((tmp_path / "out/20.0.tiff").read_bytes()).max() == int(last)


def test_errors(spark, tmp_path):
    import pyspark

    (tmp_path / "p.json").write_text(json.dumps({"time_limit": 10}))
    p = params.read(spark, f"file://{tmp_path}/p.json")
    with pytest.raises(grids.SpreadError, match="no ignitions"):
        Simulation(spark, p)
    with pytest.raises(pyspark.errors.PySparkException, match="not a geometry: POINT 1 2"):
        literals.actions(spark.createDataFrame([(1, "POINT 1 2")], "id int, literal string")).collect()
    tiles = spark.createDataFrame([], "tileset string, zone int, var string, i int, j int, r int, c int, value double")
    with pytest.raises(grids.NoTilesError):
        grids.tile_cells(tiles, 32, 0, 0, 4, 10)


def test_command_line(spark, tmp_path):
    """Exit codes 0, 1 and 2; rasters that name their zone; the optional outputs."""
    job = {"time_limit": 10, "time_resolution": 10, "n_threads": 2, "ignitions": ["POINT: 44.32372526549074;8.45040310174227"], "boundary_conditions": [{"time": 0, "w_dir": 10, "w_speed": 30}]}
    (tmp_path / "p.json").write_text(json.dumps(job))
    grid = {"west": 455976.0, "north": 4908176.0, "step_x": 20.0, "step_y": 20.0}
    (tmp_path / "veg.tif").write_bytes(sinks.geotiff(np.full((21, 21), 4, np.uint8), **grid, crs=32632))
    (tmp_path / "dem.tif").write_bytes(sinks.geotiff(np.zeros((21, 21), np.float32), **grid, crs=32632))
    (tmp_path / "far.tif").write_bytes(sinks.geotiff(np.zeros((21, 21), np.float32), **grid, crs=32633))
    at = lambda x: f"file://{tmp_path}/{x}"
    common = ["-f", at("p.json"), "-of", at("out"), "-veg", at("veg.tif"), "-id", "x", "-it", "1", "-st", "2", "-sf", "0.1", "-v", "-sr"]
    assert cli.main([*common, "-dem", at("dem.tif")]) == 0
    assert {"0.tiff", "10.0.tiff", "RoS_max_10.0.json", "isochrones_10.0.geojson"} <= {p.name for p in (tmp_path / "out").iterdir()}
    assert spark.read.parquet(at("out/grids")).count() == 441 and spark.read.parquet(at("out/realizations")).count() > 0
    assert cli.main([*common, "-dem", at("far.tif")]) == 1  # another reference system
    assert cli.main(["-f", at("none.json"), "-of", at("out")]) == 1
    spark.createDataFrame([], "tileset string, zone int, var string, i int, j int, r int, c int, value double").write.parquet(at("tiles"))
    assert cli.main(["-f", at("p.json"), "-of", at("out"), "-tiles", at("tiles")]) == 2
