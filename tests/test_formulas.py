"""Golden values of the formulas, worked out by hand from their definitions."""

import math

import pytest
from pyspark.sql import functions as F

from cinderplan import tables
from cinderplan.functions import geodesy, keyed, literals, physics


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("deg", "want"), [(0, -1.570796), (10, -1.745329), (90, -3.141593), (180, 1.570796), (270, 0), (359, -1.553343)])
def test_wind_angle(spark, deg, want):
    assert one(spark, physics.wind_angle(F.lit(float(deg))))[0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("m", "a", "b"), [(0.0, 1.0, 1.019), (0.05, 0.83273, 0.899872), (0.1, 0.753962, 0.804239), (0.2, 0.670809, 0.67266), (0.27, 0.432647, 0.618482), (0.3, 0.0022, 0.602664), (0.5, 0.0, 0.561037)])
def test_moisture(spark, m, a, b):
    got = one(spark, physics.moisture_probability_1(F.lit(m)), physics.moisture_probability_2(F.lit(m)))
    assert got[0] == pytest.approx(a, abs=1e-6) and got[1] == pytest.approx(b, abs=1e-6)


EDGES = [
    (5, 5, 0, 0, 0, 0, 1, 0, 1.0, 0.35, (3.333333, 6), (3.333333, 6), (3.333333, 6)),
    (5, 5, 0, 30, 0, 0, 1, 0, 2.194719, 0.489523, (7.315729, 3), (14.72882, 1), (18.355597, 1)),
    (5, 5, math.pi, 30, 0, 0, 1, 0, 0.768198, 0.289386, (2.56066, 8), (0.754379, 27), (3.333333, 6)),
    (4, 1, math.pi / 4, 20, 0, 10, 1.414, 0.1, 2.736603, 0.306715, (5.465548, 5), (40.235948, 0.745502), (45.793552, 0.655026)),
    (1, 4, -math.pi / 2, 60, math.pi / 2, -15, 1, 0.2, 0.292844, 0.132671, (0.681391, 37), (0.01, 2500), (0.18076, 138)),
    (3, 2, 0, 10, 0, 5, 1, 0.05, 1.73681, 0.005599, (0.578531, 36), (1.067526, 19), (1.178066, 17)),
]


@pytest.mark.parametrize("case", EDGES)
def test_edges(spark, case):
    src, to, angle, speed, w_dir, dh, dist, m, wh, p, *models = case
    lit = lambda x: F.lit(float(x))
    nominal = {(a, b): x for a, b, x in tables.spread_rows()}[to, src]
    args = lit(angle), lit(dist), lit(dh), lit(m), lit(w_dir), lit(speed)
    assert one(spark, physics.w_h_effect(lit(angle), lit(speed), lit(w_dir), lit(dh), lit(dist)))[0] == pytest.approx(wh, abs=1e-6)
    assert one(spark, physics.spread_probability(lit(nominal), *args))[0] == pytest.approx(p, abs=1e-6)
    for name, (v, t) in zip(("default", "wang", "rothermel"), models, strict=True):
        ros = physics.ros_model(name)(lit(tables.NOMINAL_SPEED[src - 1]), *args)
        got = one(spark, ros, physics.travel_time(ros, lit(dist), lit(dh)))
        assert got[0] == pytest.approx(v, abs=1e-5) and got[1] == pytest.approx(t, abs=1e-4)


@pytest.mark.parametrize(("veg", "dead", "canopy", "fli"), [(1, 19977.558, 6534.8, 1652.3579), (2, 20976.558, 10451.1, 1744.3286), (3, 97.458, 254274.58, 0.3249), (5, 20976.558, 8106.9, 1780.1386), (7, 17979.558, 4712.7, 913.4986)])
def test_intensity(spark, veg, dead, canopy, fli):
    d0, d1, hhv, hum = (F.lit(x) for x in tables.FUEL[veg - 1])
    a, b = physics.lhv_dead(hhv, F.lit(0.1)), physics.lhv_canopy(hhv, hum)
    got = one(spark, a, b, physics.fireline_intensity(d0, d1, F.lit(2.0), a, b))
    assert tuple(got) == pytest.approx((dead, canopy, fli), abs=1e-3)


def test_draws(spark):
    assert one(spark, keyed.uniform(42, 0, 10))[0] == 0.9988320893608034
    d = spark.range(20000).select(keyed.uniform(1, F.col("id"), "a").alias("u"), keyed.normal(keyed.uniform(1, F.col("id"), "b"), keyed.uniform(1, F.col("id"), "c"), 100, 25).alias("n"), keyed.poisson(keyed.uniform(1, F.col("id"), "d")).alias("p"), keyed.jitter(keyed.uniform(1, F.col("id"), "e")).alias("j"))
    m = d.agg(F.avg("u"), F.avg("n"), F.stddev("n"), F.avg("p"), F.avg((F.col("j") == 0).cast("int"))).first()
    assert tuple(m) == pytest.approx((0.5, 100, 25, 2, 0.5), rel=0.03)


@pytest.mark.parametrize(("lat", "lon", "zone", "east", "north"), [(52.47751, -6.82354, 29, 647811.015, 5816377.457), (44.32372526549074, 8.45040310174227, 32, 456176.831, 4907976.175)])
def test_utm(spark, lat, lon, zone, east, north):
    z = geodesy.zone(F.lit(lat), F.lit(lon))
    e, n = geodesy.forward(F.lit(lat), F.lit(lon), z)
    got = one(spark, z, e, n, *geodesy.inverse(e, n, z))
    assert got[0] == zone and got[1] == pytest.approx(east, abs=2e-3) and got[2] == pytest.approx(north, abs=2e-3)
    assert got[3] == pytest.approx(lat, abs=1e-8) and got[4] == pytest.approx(lon, abs=1e-8)


def test_literals(spark):
    text = ["POINT: 52.47751;-6.82354", "LINE:[44.1 44.2 ];[8.1 8.2 ]", "POLYGON:[1 2 3];[4 5 6]", "nonsense", "a:b:c"]
    d = literals.actions(spark.createDataFrame(list(enumerate(text)), "id int, literal string")).orderBy("id").collect()
    assert [(r.id, r.kind, r.lats, r.lons) for r in d] == [(0, "POINT", [52.47751], [-6.82354]), (1, "LINE", [44.1, 44.2], [8.1, 8.2]), (2, "POLYGON", [1, 2, 3], [4, 5, 6])]


def test_grid_side():
    assert [physics.grid_side(km) for km in (20, 1, 6.01, 100)] == [1000, 300, 300, 1500]


def test_table_override(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# head\n1 2.5  3\n\n 4 5 6 # end\n")
    assert tables.read_table(spark, f"file://{tmp_path}/t.txt") == [[1.0, 2.5, 3.0], [4.0, 5.0, 6.0]]
