"""Registry of the queries over the driver's tables, each with its SQL.

Inputs are derived from the star schema by the same expressions on both sides: edges, cells and fuels from lineitem,
conditions and events from events, geometries from customer and supplier.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderplan import oracle, sinks, tables
from cinderplan.functions import geodesy, keyed, literals, physics
from cinderplan.operators import conditions, drawing, products, raster, reproject, schedule
from cinderplan.plans import isochrones, spread
from cinderplan.sources import grids, params
from cinderplan.store import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 42


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    return F.floor(x * 1_000_000 + 0.5) / 1_000_000 + 0.0


ID = ["l_orderkey", "l_partkey", "l_linenumber"]


def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge trial a lineitem: angle, dist, dh, moisture, wind and fuel classes."""
    d = table(spark, sf_dir, "lineitem")
    return d.select(
        *ID,
        ((F.col("l_linenumber") % 8) * (math.pi / 4)).alias("angle"),
        F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(1.414).alias("dist"),
        (F.col("l_quantity") - 25.0).alias("dh"),
        (F.col("l_tax") + 0.0).alias("moist"),
        (F.col("l_partkey") % 360).cast("double").alias("deg"),
        (F.col("l_suppkey") % 70).cast("double").alias("speed"),
        (1 + F.col("l_suppkey") % 7).cast("int").alias("veg_from"),
        (1 + F.col("l_orderkey") % 7).cast("int").alias("veg_to"),
        (F.col("l_discount") * 100 + 1.0).alias("ros"),
    ).withColumn("wdir", physics.wind_angle(F.col("deg")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, rz, veg, dem, ros): several rows a cell and realization."""
    d = table(spark, sf_dir, "lineitem")
    return d.select((F.col("l_orderkey") % 40).cast("int").alias("r"), (F.col("l_partkey") % 40).cast("int").alias("c"), F.col("l_linenumber").alias("rz"), (1 + F.col("l_suppkey") % 7).cast("int").alias("veg"), F.col("l_quantity").alias("dem"), (F.col("l_discount") * 100).alias("ros"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(r, c, veg, dem) with one row a cell, border not burnable."""
    d = cells(spark, sf_dir).groupBy("r", "c").agg(F.min("veg").alias("veg"), F.max("dem").alias("dem"))
    return d.select("r", "c", grids.zero_border(F.col("veg"), F.col("r"), F.col("c"), 40, 40, 1).alias("veg"), "dem")


def burned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where("ros >= 5").select("r", "c", "rz").distinct()


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.probability(burned(spark, sf_dir), 7)


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob(spark, sf_dir).where("value >= 0.4").select("r", "c")


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 60_000_000
    return d.select("event_id", "user_id", "event_type", "value", t.alias("t"))


def bc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes(spark, sf_dir).where("event_type = 'signup'").select(F.col("event_id").alias("bc_id"), F.col("t").alias("time"), F.least("value", F.lit(60.0)).alias("w_speed"), (F.col("user_id") * 7 % 360).alias("w_dir"))


def edge_columns() -> tuple[Column, ...]:
    return F.col("angle"), F.col("dist"), F.col("dh"), F.col("moist"), F.col("wdir"), F.col("speed")


def _row_query(name: str, value: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return trial_rows(spark, sf_dir).select(*ID, r6(value()).alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    oracle.SQL[name] = f"SELECT l_orderkey, l_partkey, l_linenumber, {oracle.r6(sql)} AS value FROM ({oracle.TRIALS})"


def _fuel(d: DataFrame, spark: SparkSession) -> DataFrame:
    return d.join(F.broadcast(tables.veg_params(spark).withColumnRenamed("veg", "veg_to")), "veg_to")  # seven rows


def _fuel_query(name: str, value: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _fuel(trial_rows(spark, sf_dir), spark).select(*ID, r6(value()).alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    oracle.SQL[name] = f"SELECT l_orderkey, l_partkey, l_linenumber, {oracle.r6(sql)} AS value FROM ({oracle.TRIALS}) JOIN ({oracle.VEG}) v ON v.veg = veg_to"


c = F.col
_row_query("normalize_angle", lambda: physics.normalize_angle(c("dh") + c("angle")), oracle.norm("dh + angle"))
_row_query("wind_dir_to_angle", lambda: c("wdir"), "wdir")
_row_query("wind_module", lambda: physics.wind_module(c("speed")), oracle.wind_module("speed"))
_row_query("wind_effect", lambda: physics.wind_effect(c("speed"), c("wdir"), c("angle")), oracle.wind_effect("speed"))
_row_query("slope_effect", lambda: physics.slope_effect(c("dh"), c("dist")), oracle.SLOPE)
_row_query("w_h_effect", lambda: physics.w_h_effect(c("angle"), c("speed"), c("wdir"), c("dh"), c("dist")), oracle.wh("speed"))
_row_query("w_h_effect_on_p", lambda: physics.w_h_effect_on_p(c("angle"), c("speed"), c("wdir"), c("dh"), c("dist")), oracle.WH_P)
_row_query("moist_corr_1", lambda: physics.moisture_model("new_formula")(c("moist") * 4), oracle.pm1("moist * 4"))
_row_query("moist_corr_2", lambda: physics.moisture_model("rothermel")(c("moist") * 4), oracle.pm2("moist * 4"))
_row_query("quantize_tenths", lambda: physics.arrival(c("dh"), c("angle")), "round_even((dh + angle) * 10, 0) / 10")
_row_query("heli_jitter", lambda: keyed.jitter(keyed.uniform(SEED, c("l_orderkey"), c("l_partkey"), c("l_linenumber"), "heli")).cast("double"), f"round_even(2 * {oracle.u('heli')}, 0) - 1")
_row_query("poisson_embers", lambda: keyed.poisson(keyed.uniform(SEED, c("l_orderkey"), c("l_partkey"), c("l_linenumber"), "embers")).cast("double"), oracle.poisson(oracle.u("embers")))
_row_query("normal_draw", lambda: keyed.normal(_u("n1"), _u("n2"), 100.0, 25.0), oracle.normal())
_row_query("ember_success", lambda: physics.ember_success(c("veg_to")), "0.6 * (1 + 0.4 * CASE WHEN veg_to = 5 THEN 1 ELSE 0 END)")
_row_query("travel_time", lambda: physics.travel_time(c("ros"), c("dist"), c("dh")), oracle.travel("ros"))


def _u(tag: str) -> Column:
    return keyed.uniform(SEED, F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), tag)


for _m, _s in (("default", oracle.ROS_DEFAULT), ("wang", oracle.ROS_WANG), ("rothermel", oracle.ROS_ROTHERMEL)):

    def _ros(spark: SparkSession, sf_dir: str, model: str = _m) -> DataFrame:
        v = F.broadcast(tables.veg_params(spark).select(F.col("veg").alias("veg_from"), "v0"))  # seven rows
        d = trial_rows(spark, sf_dir).join(v, "veg_from").withColumn("v", physics.ros_model(model)(F.col("v0"), *edge_columns()))
        return d.select(*ID, r6(F.col("v")).alias("ros"), r6(physics.travel_time(F.col("v"), F.col("dist"), F.col("dh"))).alias("minutes"))

    _name = "ros_standard" if _m == "default" else f"ros_{_m}"
    _ros.__name__ = _name
    QUERIES[_name] = _ros
    oracle.SQL[_name] = f"SELECT l_orderkey, l_partkey, l_linenumber, {oracle.r6('v')} AS ros, {oracle.r6(oracle.travel('v'))} AS minutes FROM (SELECT *, {_s} AS v FROM ({oracle.TRIALS}) JOIN (SELECT veg, v0 FROM ({oracle.VEG})) f ON f.veg = veg_from)"

_fuel_query("lhv_dead", lambda: physics.lhv_dead(F.col("hhv"), F.col("moist")), oracle.DEAD)
_fuel_query("lhv_canopy", lambda: physics.lhv_canopy(F.col("hhv"), F.col("hum")), oracle.CANOPY)
_fuel_query("fireline_intensity", lambda: physics.fireline_intensity(F.col("d0"), F.col("d1"), F.col("ros"), physics.lhv_dead(F.col("hhv"), F.col("moist")), physics.lhv_canopy(F.col("hhv"), F.col("hum"))), f"ros * ({oracle.DEAD} * d0 + {oracle.CANOPY} * d1) / 60")
_fuel_query(
    "fireline_intensity_rg",
    lambda: physics.fireline_intensity_regrown(F.col("d0"), F.col("d1"), F.col("ros"), physics.lhv_dead(F.col("hhv"), F.col("moist")), physics.lhv_canopy(F.col("hhv"), F.col("hum")), F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(F.col("moist") * 5)),
    f"CASE WHEN l_linenumber = 1 THEN ros * ({oracle.DEAD} * d0 + {oracle.CANOPY} * d1) / 2 / 60 WHEN d1 = 0 THEN ros * {oracle.DEAD} * d0 * (1 - moist * 5) / 2 / 60 ELSE ros * ({oracle.DEAD} * d0 + {oracle.CANOPY} * d1 * (1 - moist * 5)) / 2 / 60 END",
)


@query
def p_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trial_rows(spark, sf_dir).join(F.broadcast(tables.spread_table(spark)), ["veg_to", "veg_from"])  # 49 rows
    return d.select(*ID, *(r6(physics.spread_probability(F.col("p"), *edge_columns(), model=m)).alias(f"p_{m}") for m in ("new_formula", "rothermel")))


oracle.SQL["p_transition"] = f"SELECT l_orderkey, l_partkey, l_linenumber, {oracle.r6(oracle.p(oracle.pm1('moist')))} AS p_new_formula, {oracle.r6(oracle.p(oracle.pm2('moist')))} AS p_rothermel FROM ({oracle.TRIALS}) JOIN ({oracle.SPREAD}) s ON s.t = veg_to AND s.f = veg_from"


@query
def wind_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    w_dir, speed = physics.noisy_wind(F.col("wdir"), F.col("speed"), _u("wdir"), _u("wspeed"))
    return trial_rows(spark, sf_dir).select(*ID, r6(w_dir).alias("w_dir"), r6(speed).alias("w_speed"))


oracle.SQL["wind_noise"] = f"SELECT l_orderkey, l_partkey, l_linenumber, {oracle.r6('wdir + pi() / 16 * (0.5 - ' + oracle.u('wdir') + ')')} AS w_dir, {oracle.r6('speed * (1.2 - 0.4 * ' + oracle.u('wspeed') + ')')} AS w_speed FROM ({oracle.TRIALS})"


@query
def bernoulli_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trial_rows(spark, sf_dir).join(F.broadcast(tables.spread_table(spark)), ["veg_to", "veg_from"])  # 49 rows
    return d.where(keyed.bernoulli(F.col("p"), _u("open"))).select(*ID, "p")


oracle.SQL["bernoulli_trial"] = f"SELECT l_orderkey, l_partkey, l_linenumber, p FROM ({oracle.TRIALS}) JOIN ({oracle.SPREAD}) s ON s.t = veg_to AND s.f = veg_from WHERE p > {oracle.u('open')}"


@query
def ember_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, the filter of short ones, landing cells within the grid and success."""
    d = trial_rows(spark, sf_dir).withColumn("a", _u("angle") * (2 * math.pi))
    d = d.withColumn("d", physics.ember_distance(keyed.normal(_u("n1"), _u("n2"), 100.0, 25.0), F.col("a"), F.col("wdir"), F.col("speed"))).where(F.col("d") > 40)
    dr, dc = physics.ember_shift(F.col("d"), F.col("a"))
    at = lambda k, x: F.greatest(F.lit(0), F.least(F.lit(39), (F.col(k) % 40).cast("int") + x))
    return d.where(_u("lands") < physics.ember_success(F.col("veg_to"))).select(*ID, r6(F.col("d")).alias("distance"), at("l_orderkey", dr).cast("long").alias("r"), at("l_partkey", dc).cast("long").alias("c"))


oracle.SQL["ember_flight"] = f"""
SELECT l_orderkey, l_partkey, l_linenumber, {oracle.r6('d')} AS distance,
 greatest(0, least(39, l_orderkey % 40 + CAST(trunc(d * cos(a) / 20) AS BIGINT))) AS r, greatest(0, least(39, l_partkey % 40 + CAST(trunc(d * sin(a) / 20) AS BIGINT))) AS c
FROM (SELECT *, {oracle.normal()} * exp(speed / 3.6 * 0.191 * (cos(wdir - a) - 1)) AS d FROM (SELECT *, {oracle.u('angle')} * (2 * pi()) AS a FROM ({oracle.TRIALS})))
WHERE d > 40 AND {oracle.u('lands')} < 0.6 * (1 + 0.4 * CASE WHEN veg_to = 5 THEN 1 ELSE 0 END)"""


@query
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between burnable neighbours with everything a trial needs."""
    e = spread.edges(grid(spark, sf_dir), spread.Rules())
    return e.select("r", "c", "nr", "nc", "k", "dist", r6(F.col("angle")).alias("angle"), "dh", "veg_from", "veg_to", "p", "v0", "d0", "d1", "hhv", "hum")


oracle.SQL["neighbour_expand"] = oracle.EDGES


@query
def bc_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = minutes(spark, sf_dir).where("event_type <> 'signup'").select("event_id", "t")
    d = conditions.as_of(probes, bc(spark, sf_dir), "t", "time", ["bc_id", "w_speed", "w_dir"])
    return d.where("bc_id is not null").select("event_id", "bc_id", "w_speed", "w_dir")


@query
def bc_asof_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = minutes(spark, sf_dir)
    states = e.where("event_type = 'signup'").select("user_id", F.col("t").alias("time"), "value")
    d = conditions.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "t"), states, "t", "time", ["value"], ["user_id"])
    return d.select("event_id", "user_id", "value")


@query
def bc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.intervals(bc(spark, sf_dir)).select("bc_id", r6(F.col("from_t")).alias("from_t"), r6(F.col("to_t")).alias("to_t"))


oracle.SQL["bc_asof"] = f"SELECT e.event_id, b.bc_id, b.w_speed, b.w_dir FROM ({oracle.MINUTES}) e ASOF JOIN ({oracle.BC}) b ON e.t >= b.time WHERE e.event_type <> 'signup'"
oracle.SQL["bc_asof_by_user"] = f"SELECT e.event_id, e.user_id, b.value FROM (SELECT * FROM ({oracle.MINUTES}) WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM ({oracle.MINUTES}) WHERE event_type = 'signup') b ON e.user_id = b.user_id AND e.t >= b.t"
oracle.SQL["bc_interval"] = f"SELECT bc_id, {oracle.r6('time')} AS from_t, {oracle.r6('lead(time) OVER (ORDER BY time, bc_id)')} AS to_t FROM ({oracle.BC})"


@query
def burned_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cells(spark, sf_dir).select("r", "c", "rz").distinct()
    return d.join(burned(spark, sf_dir), ["r", "c", "rz"], "left_anti")


oracle.SQL["burned_anti_join"] = f"SELECT r, c, rz FROM ({oracle.CELLS}) EXCEPT SELECT r, c, rz FROM ({oracle.CELLS}) WHERE ros >= 5"


@query
def drop_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals at a cell (user) that has already burned are dropped."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    return minutes(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n = 1").select("user_id", "event_id", "event_type")


oracle.SQL["drop_late_events"] = f"SELECT user_id, arg_min(event_id, t) AS event_id, arg_min(event_type, t) AS event_type FROM ({oracle.MINUTES}) GROUP BY user_id"


@query
def first_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes(spark, sf_dir).groupBy("user_id", "event_type").agg(r6(F.min("t")).alias("t"))


oracle.SQL["first_arrival"] = f"SELECT user_id, event_type, {oracle.r6('min(t)')} AS t FROM ({oracle.MINUTES}) GROUP BY user_id, event_type"


@query
def moisture_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = cells(spark, sf_dir).where("rz <= 5").select("r", "c", F.col("rz").alias("priority"), (F.col("rz") * 0.05).alias("moist")).distinct()
    over = drawing.resolved(layers.withColumn("bc_id", F.lit(0)), ["bc_id"])
    d = grid(spark, sf_dir).join(over, ["r", "c"], "left")
    return d.select("r", "c", r6(F.coalesce("moist", F.lit(0.01))).alias("moist"))


oracle.SQL["moisture_overlay"] = f"SELECT g.r, g.c, {oracle.r6('coalesce(o.m, 0.01)')} AS moist FROM ({oracle.GRID}) g LEFT JOIN (SELECT r, c, max(rz) * 0.05 AS m FROM ({oracle.CELLS}) WHERE rz <= 5 GROUP BY r, c) o ON g.r = o.r AND g.c = o.c"


@query
def heavy_veg_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = raster.dilated(mask(spark, sf_dir), 40, 40).withColumn("hit", F.lit(True))
    return grid(spark, sf_dir).join(heavy, ["r", "c"], "left").select("r", "c", F.when(F.col("hit"), 0).otherwise(F.col("veg")).alias("veg"))


oracle.SQL["heavy_veg_update"] = f"SELECT g.r, g.c, CASE WHEN d.r IS NOT NULL THEN 0 ELSE g.veg END AS veg FROM ({oracle.GRID}) g LEFT JOIN ({oracle.DILATED}) d ON g.r = d.r AND g.c = d.c"


@query
def burn_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob(spark, sf_dir).select("r", "c", r6(F.col("value")).alias("value"))


oracle.SQL["burn_probability"] = f"SELECT r, c, {oracle.r6('value')} AS value FROM ({oracle.PROB})"


def _per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("r", "c", "rz").agg(F.max("ros").alias("ros"))


for _n, _f, _v, _s in (("ros_max", products.largest, "ros", "max(ros)"), ("ros_mean", products.mean_positive, "ros", "coalesce(avg(CASE WHEN ros > 0 THEN ros END), 0)"), ("fli_max", products.largest, "fli", "max(ros * 51.5)"), ("fli_mean", products.mean_positive, "fli", "coalesce(avg(CASE WHEN ros > 0 THEN ros * 51.5 END), 0)")):

    def _map(spark: SparkSession, sf_dir: str, f=_f, v: str = _v) -> DataFrame:
        return f(_per_cell(spark, sf_dir).withColumn("fli", F.col("ros") * 51.5), v).select("r", "c", r6(F.col("value")).alias("value"))

    _map.__name__ = _n
    QUERIES[_n] = _map
    oracle.SQL[_n] = f"SELECT r, c, {oracle.r6(_s)} AS value FROM (SELECT r, c, rz, max(ros) AS ros FROM ({oracle.CELLS}) GROUP BY r, c, rz) GROUP BY r, c"


@query
def area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = products.area_stats(prob(spark, sf_dir))
    return d.select(*(r6(F.col(k)).alias(k) for k in d.columns))


oracle.SQL["area_stats"] = f"SELECT {oracle.r6('sum(value) * 0.04')} AS area_mean, " + ", ".join(f"{oracle.r6(f'count(*) FILTER (WHERE value >= {p}) * 0.04')} AS area_{round(p * 100)}" for p in (0.5, 0.75, 0.9)) + f" FROM ({oracle.PROB})"


@query
def active_realizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.active(cells(spark, sf_dir).where("ros > 8"), ["r"])


oracle.SQL["active_realizations"] = f"SELECT r, count(DISTINCT rz) AS active FROM ({oracle.CELLS}) WHERE ros > 8 GROUP BY r"


@query
def last_write_ros(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("r"), (F.col("l_partkey") % 40).alias("c"), F.col("l_linenumber").alias("rz"), "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", (F.col("l_discount") + 0.0).alias("ros"))
    order = [F.col(k) for k in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "ros")]
    return products.last_write(d, order, ["ros"], ["r", "c", "rz"])


oracle.SQL["last_write_ros"] = "SELECT r, c, rz, ros FROM (SELECT l_orderkey % 40 AS r, l_partkey % 40 AS c, l_linenumber AS rz, l_discount + 0.0 AS ros, row_number() OVER (PARTITION BY l_orderkey % 40, l_partkey % 40, l_linenumber ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount + 0.0 DESC) AS n FROM lineitem) WHERE n = 1"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes(spark, sf_dir).select(F.floor(F.col("t") / 60).cast("long").alias("t10"), "event_id", "user_id")


@query
def schedule_pop_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.earliest(_queue(spark, sf_dir)).select("t10", "event_id", "user_id")


@query
def schedule_push_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queue(spark, sf_dir)
    return schedule.sizes(schedule.push(q, q.where("user_id % 2 = 0")))


@query
def schedule_group_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.times(_queue(spark, sf_dir))


_QUEUE = f"SELECT CAST(floor(t / 60) AS BIGINT) AS t10, event_id, user_id FROM ({oracle.MINUTES})"
oracle.SQL["schedule_pop_min"] = f"WITH q AS ({_QUEUE}) SELECT * FROM q WHERE t10 = (SELECT min(t10) FROM q)"
oracle.SQL["schedule_push_union"] = f"WITH q AS ({_QUEUE}) SELECT t10, count(*) AS n FROM (SELECT * FROM q UNION ALL SELECT * FROM q WHERE user_id % 2 = 0) GROUP BY t10"
oracle.SQL["schedule_group_times"] = f"SELECT DISTINCT t10 FROM ({_QUEUE})"


@query
def snapshot_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir).where(F.pmod("t10", F.lit(24)) == 0).select("t10", "event_id")


@query
def snapshot_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, queue = 31 * 24, _queue(spark, sf_dir)
    every = F.lit(0).alias("_k")
    rows = products.running(queue.select("t10", every), "t10", 48, limit, ["_k"], {"n": F.count("*")}, {"n": F.sum})
    first = queue.groupBy("user_id").agg(F.min("t10").alias("t10"))  # a user counts from then on
    users = products.running(first.select("t10", every), "t10", 48, limit, ["_k"], {"users": F.count("*")}, {"users": F.sum})
    return rows.join(users, "s10").select("s10", "n", "users")


oracle.SQL["snapshot_trigger"] = f"SELECT t10, event_id FROM ({_QUEUE}) WHERE t10 % 24 = 0"
oracle.SQL["snapshot_cumulative"] = f"SELECT s10, count(*) AS n, count(DISTINCT user_id) AS users FROM ({_QUEUE}) JOIN (SELECT unnest(range(0, 745, 48)) AS s10) s ON t10 <= s10 GROUP BY s10"


@query
def bc_sort_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = params.sort_and_pad(bc(spark, sf_dir).withColumnRenamed("bc_id", "pos").select("pos", "time", "w_speed", F.col("w_dir").cast("double")))
    return d.select(F.col("bc_id").cast("long").alias("bc_id"), r6(F.col("time")).alias("time"), r6(F.col("w_speed")).alias("w_speed"), "w_dir")


oracle.SQL["bc_sort_pad"] = f"WITH b AS (SELECT bc_id AS pos, time, w_speed, CAST(w_dir AS DOUBLE) AS w_dir FROM ({oracle.BC})) SELECT row_number() OVER (ORDER BY time, pos) - 1 AS bc_id, {oracle.r6('time')} AS time, {oracle.r6('w_speed')} AS w_speed, w_dir FROM (SELECT * FROM b UNION ALL SELECT -1, 0.0, 0.0, 0.0 WHERE (SELECT min(time) FROM b) > 0)"


@query
def fixed_actions_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.array("c_name")).alias("own"), F.when(F.col("c_custkey") % 2 > 0, F.array("c_mktsegment")).alias("fixed"))
    return d.select("c_custkey", F.array_join(params.merged(F.col("own"), F.col("fixed")), ",").alias("merged"))


oracle.SQL["fixed_actions_merge"] = "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 3 > 0 THEN c_name END, CASE WHEN c_custkey % 2 > 0 THEN c_mktsegment END) AS merged FROM customer"


@query
def params_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters read from JSON made of the events' properties, defaults where they are silent."""
    text = F.concat(F.lit('{"n_threads": '), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ', "w_speed": 7.5').otherwise(""), F.lit("}"))
    d = table(spark, sf_dir, "events").select("event_id", F.from_json(text, params.schema()).alias("p")).select("event_id", "p.*")
    return params.with_defaults(d).select("event_id", "n_threads", "w_speed", "time_resolution", "ros_model")


oracle.SQL["params_defaults"] = "SELECT event_id, CAST(event_id AS INTEGER) AS n_threads, CASE WHEN event_id % 2 = 0 THEN 7.5 ELSE 0.0 END AS w_speed, 60.0 AS time_resolution, 'wang' AS ros_model FROM events"


def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = (F.col("c_custkey") % 90).cast("string"), (F.col("c_nationkey") * 7).cast("string")
    point = F.concat(F.lit("POINT: "), lat, F.lit(".5;-"), lon, F.lit(".25"))
    line = F.concat(F.lit("LINE:["), lat, F.lit(" 1.5 ];["), lon, F.lit(" 2 ]"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, point).otherwise(line).alias("literal"))


@query
def parse_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals.points(literals.actions(_literals(spark, sf_dir))).select("id", "kind", F.col("pos").cast("int").alias("pos"), "lat", "lon")


@query
def actions_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals.bounding_box(literals.actions(_literals(spark, sf_dir)))


_POINTS = "SELECT c_custkey AS id, 'POINT' AS kind, 0 AS pos, c_custkey % 90 + 0.5::DOUBLE AS lat, -(c_nationkey * 7 + 0.25::DOUBLE) AS lon FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'LINE', 0, (c_custkey % 90)::DOUBLE, (c_nationkey * 7)::DOUBLE FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'LINE', 1, 1.5, 2.0 FROM customer WHERE c_custkey % 2 = 1"
oracle.SQL["parse_literals"] = _POINTS
oracle.SQL["actions_bbox"] = f"SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, (min(lat) + max(lat)) / 2 AS mid_lat, (min(lon) + max(lon)) / 2 AS mid_lon FROM ({_POINTS})"


@query
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 130 - 60).cast("double").alias("lat"), (F.col("c_custkey") % 359 - 179.5).alias("lon"))
    d = d.withColumn("zone", geodesy.zone(F.col("lat"), F.col("lon")))
    e, n = geodesy.forward(F.col("lat"), F.col("lon"), F.col("zone"))
    r, k = geodesy.cell_of(e, n, 100000.0, 10000000.0)
    return d.select("c_custkey", "zone", (F.floor(e * 1000 + 0.5) / 1000).alias("easting"), (F.floor(n * 1000 + 0.5) / 1000).alias("northing"), r.cast("long").alias("r"), k.cast("long").alias("c"))


oracle.SQL["utm_forward"] = oracle.UTM


@query
def draw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", *((F.col("s_suppkey") * a % 23).cast("int").alias(n) for a, n in ((7, "c0"), (5, "r0"), (11, "c1"), (3, "r1"))))
    d = s.select("s_suppkey", F.posexplode(drawing.segment(F.col("c0"), F.col("r0"), F.col("c1"), F.col("r1"))).alias("pos", "p"))
    return d.select("s_suppkey", "pos", "p.r", "p.c")


oracle.SQL["draw_segments"] = oracle.SEGMENTS


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda a, b: ((F.col("s_suppkey") * a) % 17 + b).cast("int")
    corner = lambda r, k: F.struct(r.alias("r"), k.alias("c"))
    path = F.array(corner(at(3, 1), at(5, 1)), corner(at(7, 1), at(2, 12)), corner(at(11, 12), at(13, 3)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", path.alias("path"))


@query
def draw_polygon_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing.cells_of(_polygons(spark, sf_dir), ["s_suppkey"], drawing.outline(F.col("path")), 40, 40).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.countDistinct("r", "c").alias("distinct_n"))


@query
def fill_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    contour = drawing.cells_of(_polygons(spark, sf_dir), ["s_suppkey"], drawing.outline(F.col("path")), 40, 40)
    return drawing.filled(contour, ["s_suppkey"]).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))


oracle.SQL["draw_polygon_outlines"] = oracle.OUTLINES
oracle.SQL["fill_polygons"] = oracle.FILLED


@query
def dilate_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dilated(mask(spark, sf_dir), 40, 40).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


@query
def erode_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.eroded(mask(spark, sf_dir)).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


@query
def opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.opened(mask(spark, sf_dir), 40, 40).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


@query
def median_9x9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.median(prob(spark, sf_dir), 40, 40).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), r6(F.col("value")).alias("value"))


oracle.SQL["dilate_cross"] = oracle.DILATED
oracle.SQL["erode_cross"] = oracle.ERODED
oracle.SQL["opening"] = oracle.OPENED
oracle.SQL["median_9x9"] = oracle.MEDIAN


@query
def gaussian_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.posexplode(raster.smooth(F.col("v"), 0.8)).alias("pos", "x")).select("vec_id", "pos", r6(F.col("x")).alias("value"))


oracle.SQL["gaussian_ring"] = oracle.gaussian(raster.gaussian_weights(0.8))


@query
def trim_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prob(spark, sf_dir).where("r between 5 and 20 and c between 7 and 30 and value > 0.5")
    return raster.trimmed(d, 40, 40).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), r6(F.col("value")).alias("value"))


oracle.SQL["trim_bbox"] = f"WITH p AS (SELECT * FROM ({oracle.PROB}) WHERE r BETWEEN 5 AND 20 AND c BETWEEN 7 AND 30 AND value > 0.5) SELECT r - (SELECT greatest(min(r) - 1, 0) FROM p) AS r, c - (SELECT greatest(min(c) - 1, 0) FROM p) AS c, {oracle.r6('value')} AS value FROM p WHERE r < (SELECT least(max(r) + 2, 40) FROM p) AND c < (SELECT least(max(c) + 2, 40) FROM p)"


@query
def border_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cells(spark, sf_dir)
    return d.select("r", "c", "rz", grids.zero_border(grids.clean_class(F.col("veg")), F.col("r"), F.col("c"), 40, 40).cast("long").alias("veg"))


oracle.SQL["border_zero"] = f"SELECT r, c, rz, CASE WHEN r < 3 OR r >= 37 OR c < 3 OR c >= 37 OR veg > 6 THEN 0 ELSE veg END AS veg FROM ({oracle.CELLS})"


@query
def timeref(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = literals.init_date(F.lit("202209011500"))
    return _queue(spark, sf_dir).select("event_id", F.date_format(literals.time_reference(start, F.col("t10") * 10.0), "yyyy-MM-dd HH:mm:ss").alias("timeref"))


@query
def log_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes(spark, sf_dir).select("event_id", literals.log_line(F.floor("t").cast("double"), F.col("user_id"), F.lit(1.0)).alias("line"))


oracle.SQL["timeref"] = f"SELECT event_id, strftime(TIMESTAMP '2022-09-01 15:00:00' + to_minutes(t10 * 10), '%Y-%m-%d %H:%M:%S') AS timeref FROM ({_QUEUE})"
oracle.SQL["log_breakdown"] = f"SELECT event_id, (m // 1440)::VARCHAR || 'd ' || (m % 1440 // 60)::VARCHAR || 'h ' || (m % 60)::VARCHAR || 'm - ' || user_id::VARCHAR || ' - 1.00 ha' AS line FROM (SELECT event_id, user_id, CAST(floor(t) AS BIGINT) AS m FROM ({oracle.MINUTES}))"


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = grid(spark, sf_dir)
    split = lambda name, v: d.select(F.lit("default").alias("tileset"), F.lit(32).alias("zone"), F.lit(name).alias("var"), (F.col("r") / 10).cast("int").alias("i"), (F.col("c") / 10).cast("int").alias("j"), (F.col("r") % 10).alias("r"), (F.col("c") % 10).alias("c"), F.col(v).cast("double").alias("value"))
    return split("veg", "veg").unionByName(split("dem", "dem"))


@query
def tile_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.window(_tiles(spark, sf_dir), 32, "dem", 7, 13, 20, 10).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "value")


@query
def tile_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = grids.tile_cells(_tiles(spark, sf_dir), 32, 7, 23, 20, 10, "missing")
    return d.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("veg").cast("long").alias("veg"), "dem")


oracle.SQL["tile_window"] = f"SELECT r - 7 AS r, c - 13 AS c, dem AS value FROM ({oracle.GRID}) WHERE r BETWEEN 7 AND 26 AND c BETWEEN 13 AND 32"
oracle.SQL["tile_fallback"] = f"SELECT a.r, b.c, CASE WHEN a.r < 3 OR a.r >= 17 OR b.c < 3 OR b.c >= 17 THEN 0 ELSE coalesce(g.veg, 0) END AS veg, coalesce(g.dem, 0.0) AS dem FROM (SELECT unnest(range(20)) AS r) a CROSS JOIN (SELECT unnest(range(20)) AS c) b LEFT JOIN ({oracle.GRID}) g ON g.r = a.r + 7 AND g.c = b.c + 23"


@query
def isochrone_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = isochrones.masks(prob(spark, sf_dir), [0.0, 0.5, 0.75])
    return d.groupBy("threshold").agg(F.count("*").alias("n"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))


@query
def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raster.boundary(raster.opened(mask(spark, sf_dir), 40, 40))
    return d.select(*(F.col(k).cast("long").alias(k) for k in ("r0", "c0", "r1", "c1")))


@query
def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings enclose exactly the mask: outer areas less holes."""
    e = raster.boundary(mask(spark, sf_dir)).withColumn("g", F.lit(0))
    rings = raster.rings(e, "g")
    pair = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda a, b: (a["c"] * b["r"] - b["c"] * a["r"]) / 2)
    return rings.agg(F.sum(F.aggregate(pair, F.lit(0.0), lambda s, x: s + x)).alias("area"), F.sum(F.size("path") - 1).alias("edges"))


@query
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = isochrones.isochrones(stored(prob(spark, sf_dir), "prob"), 40, 40)
    return isochrones.geojson(lines, F.lit(60.0), lambda r, k: (k, r))


oracle.SQL["isochrone_mask"] = f"SELECT th AS threshold, count(*) AS n, sum(r) AS sum_r, sum(c) AS sum_c FROM ({oracle.PROB}) JOIN (SELECT unnest([0.0::DOUBLE, 0.5, 0.75]) AS th) t ON value >= th AND value > 0 GROUP BY th"
oracle.SQL["ring_edges"] = oracle.boundary(oracle.OPENED)
oracle.SQL["ring_areas"] = f"SELECT (SELECT count(*) FROM ({oracle.MASK}))::DOUBLE AS area, count(*) AS edges FROM ({oracle.boundary(oracle.MASK)})"


@query
def raster_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = grids.GridMeta(100.0, 900.0, 20.0, 20.0, 40, 40, 32)
    rows = [(k, grids.consistent(a, grids.GridMeta(100.0 + w, 900.0, s, s, 40, 40, z))) for k, (w, s, z) in enumerate([(0, 20.0, 32), (10, 20.0, 32), (30, 20.0, 32), (0, 20.1, 32), (0, 21.0, 32), (0, 20.0, 33)])]
    return spark.createDataFrame(rows, "id int, same boolean")


oracle.SQL["raster_consistency"] = "SELECT id, z = 32 AND abs(20.0 - s) / 20.0 <= 0.01 AND abs(w) + abs(40 * (s - 20.0)) + abs(w + 40 * (s - 20.0)) <= 40 AS same FROM (VALUES (0, 0, 20.0, 32), (1, 10, 20.0, 32), (2, 30, 20.0, 32), (3, 0, 20.1, 32), (4, 0, 21.0, 32), (5, 0, 20.0, 33)) v(id, w, s, z)"


META = grids.GridMeta(456000.0, 4908800.0, 20.0, 20.0, 40, 40, 32)
TARGET = reproject.LonLatGrid(8.4485, 44.3321, 0.00026, 0.00019, 40, 40)


@query
def reproject_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reproject.reprojected(prob(spark, sf_dir), META, TARGET)
    return d.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), r6(F.col("value")).alias("value"))


oracle.SQL["reproject_nearest"] = f"SELECT g.r, g.c, {oracle.r6('p.value')} AS value FROM ({oracle.project_back(META, TARGET)}) g JOIN ({oracle.PROB}) p ON p.r = g.br AND p.c = g.bc"


@query
def utm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and back again."""
    d = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 70 + 5).cast("double").alias("lat"), (F.col("c_custkey") % 6 + 6.5).alias("lon"))
    e, n = geodesy.forward(F.col("lat"), F.col("lon"), F.lit(32))
    lat, lon = geodesy.inverse(e, n, F.lit(32))
    return d.select("c_custkey", r6(lat).alias("lat"), r6(lon).alias("lon"))


oracle.SQL["utm_inverse"] = f"SELECT c_custkey, {oracle.r6('(c_custkey % 70 + 5)::DOUBLE')} AS lat, {oracle.r6('c_custkey % 6 + 6.5::DOUBLE')} AS lon FROM customer"


@query
def product_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as written to rasters."""
    d = _per_cell(spark, sf_dir).withColumn("p", F.col("ros") / 10)
    return d.select("r", "c", "rz", sinks.scaled("probability", F.col("p")).alias("prob"), r6(sinks.scaled("ros_max", F.col("ros"))).alias("ros"))


oracle.SQL["product_scaling"] = f"SELECT r, c, rz, CAST(trunc(max(ros) / 10 * 255) AS INTEGER) AS prob, {oracle.r6('max(ros) * 60')} AS ros FROM ({oracle.CELLS}) GROUP BY r, c, rz"


@query
def arrival_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes(spark, sf_dir).select("event_id", r6(physics.arrival(F.col("t"), F.col("value"))).alias("t"), physics.tenths(F.col("t")).alias("t10"))


oracle.SQL["arrival_time"] = f"SELECT event_id, {oracle.r6('round_even((t + value) * 10, 0) / 10')} AS t, CAST(round_even(t * 10, 0) AS BIGINT) AS t10 FROM ({oracle.MINUTES})"


@query
def ring_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rings keep their closure; their coordinates are convolved."""
    v = F.col("embedding").cast("array<double>")
    half = F.floor(F.size(v) / 2).cast("int")
    path = F.zip_with(F.slice(v, 1, half), F.slice(v, half + 1, half), lambda a, b: F.struct(a.alias("r"), b.alias("c")))
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(raster.smooth_ring(path, 0.8)).alias("pos", "p"))
    return d.select("vec_id", "pos", r6(F.col("p.r")).alias("r"), r6(F.col("p.c")).alias("c"))


oracle.SQL["ring_smoothing"] = oracle.ring(raster.gaussian_weights(0.8))


@query
def initial_ignitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon contours are seeds in every realization; interiors are burned and do not spread."""
    contour = drawing.cells_of(_polygons(spark, sf_dir), ["s_suppkey"], drawing.outline(F.col("path")), 40, 40)
    ring = contour.select("r", "c").distinct()
    queued = spread.seeds(ring, 3)
    inner = drawing.filled(contour, ["s_suppkey"]).select("r", "c").distinct().join(ring, ["r", "c"], "left_anti")
    return queued.select(F.lit("queued").alias("state"), "rz", "r", "c").unionByName(inner.select(F.lit("burned").alias("state"), F.lit(-1).alias("rz"), "r", "c"))


oracle.SQL["initial_ignitions"] = oracle.IGNITIONS


def _field(spark: SparkSession, sf_dir: str, rules: spread.Rules, side: int = 40) -> spread.Field:
    calm = spark.createDataFrame([(0, 0.0, 335.0, 9.0, 0.0), (1, 18.0, 0.0, 30.0, 5.0)], "bc_id int, time double, w_dir double, w_speed double, moisture double")
    return spread.prepare(grid(spark, sf_dir), calm, rules, side, side)


def _start(spark: SparkSession) -> DataFrame:
    return spread.seeds(spark.createDataFrame([(20, 20)], "r int, c int"), 4)


@query
def spread_one_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open edges of every burnable cell at time 0 in two realizations."""
    rules = spread.Rules(limit10=spread.NEVER)
    f = _field(spark, sf_dir, rules)
    sources = f.cells.where("veg > 0").select("r", "c", F.explode(F.array(F.lit(0), F.lit(1))).alias("rz"), F.lit(0).cast("long").alias("t10"), F.lit(0).alias("dup"))
    d = f.attempts(sources)
    return d.select("rz", "r", "c", "nr", "nc", "k", "t_arr", r6(F.col("ros")).alias("ros"), r6(F.col("fli")).alias("fli"))


@query
def spread_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burn times by relaxation, all trials succeeding, without noise: shortest paths."""
    return spread.by_epoch(_field(spark, sf_dir, spread.Rules(certain=True, noise=False, limit10=200)), _start(spark)).select("rz", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "t_burn")


@query
def spread_stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burn times with keyed draws over two conditions."""
    return spread.by_blocks(_field(spark, sf_dir, spread.Rules(limit10=400)), _start(spark)).select("rz", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "t_burn")


@query
def spread_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same burn times by one search a realization."""
    return spread.by_group(_field(spark, sf_dir, spread.Rules(limit10=400)), _start(spark)).select("rz", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "t_burn")


oracle.SQL["spread_one_tick"] = oracle.ONE_TICK
oracle.SQL["spread_fixpoint"] = oracle.fixpoint(True, 200)
oracle.SQL["spread_stochastic"] = oracle.fixpoint(False, 400)
oracle.SQL["spread_grouped"] = oracle.fixpoint(False, 400)


@query
def spotting_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burn times with embers; checked against the grouped plan in the tests."""
    return spread.by_epoch(_field(spark, sf_dir, spread.Rules(limit10=300, spotting=True)), _start(spark)).select("rz", "r", "c", "t_burn")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burned-area statistics at snapshots of a small run."""
    f = _field(spark, sf_dir, spread.Rules(limit10=300))
    done = stored(spread.by_epoch(f, _start(spark)), "burned")
    p = products.running(done, "t_burn", 100, 300, ["r", "c"], {"n": F.count("*")}, {"n": F.sum}).withColumn("value", F.col("n") / 4.0)
    return products.area_stats(p, keys=["s10"])


@query
def snapshot_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flagship(spark, sf_dir)
    return d.select("s10", *(r6(F.col(k)).alias(k) for k in ("area_mean", "area_50", "area_75", "area_90")))


oracle.SQL["snapshot_statistics"] = oracle.statistics(oracle.fixpoint(False, 300))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in QUERIES}
