"""Fire spread as a fixpoint over relations.

With keyed draws an edge's outcome is a function of (seed, realization, source, neighbour, condition in force when the
source burns). Burn time is therefore the shortest path over open edges, and four plans give the same rows:

* ``by_epoch``: label-correcting relaxation, one condition after the other; rounds follow hops, not minutes.
* ``by_blocks`` (default): blocks of cells are searched whole, and only what crosses their borders is exchanged; rounds follow blocks.
* ``by_tick``: one iteration per time bucket, literally the queue; can keep duplicate events (``multiplicity``).
* ``by_group``: open edges are computed as columns for every condition, and each realization is searched in one place.

Tables: cells(r, c, veg, dem); conditions(bc_id, time, w_dir degrees, w_speed, moisture percent); seeds(t10, rz, r, c).
Times are tenths of minutes as longs. Arrivals beyond the limit are dropped.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderplan import tables
from cinderplan.functions import keyed, physics
from cinderplan.operators.conditions import intervals
from cinderplan.store import folder, small, stored

#: Rows of small dimension tables (conditions, overlays, heavy cells) that may be broadcast.
BROADCAST = 200_000
NEVER = 2**62
#: Cells a side of a block that is searched at once.
BLOCK = 64
#: Rounds of relaxation whose improvements are merged on the fly before arrivals are written anew.
COMPACT = 6


@dataclass
class Rules:
    """How to run: seed, models, limits and optional tables."""

    seed: int = 42
    ros_model: str = "wang"
    moisture_model: str = "new_formula"
    limit10: int = 600
    noise: bool = True
    certain: bool = False
    spotting: bool = False
    speed: list[float] = field(default_factory=lambda: tables.NOMINAL_SPEED)
    fuel: list[list[float]] = field(default_factory=lambda: tables.FUEL)
    spread: list[list[float]] = field(default_factory=lambda: tables.SPREAD)


def edges(cells: DataFrame, rules: Rules) -> DataFrame:
    """Directed edges between burnable neighbours with everything static that a trial needs; computed once, kept by (r, c)."""
    spark = cells.sparkSession
    near = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("k", "dr", "dc", "dist", "angle"), row, strict=True))) for row in tables.neighbour_rows())))
    burnable = cells.where("veg > 0")
    src = burnable.select("r", "c", F.col("veg").alias("veg_from"), F.col("dem").alias("_dem"), near.alias("n"))
    src = src.select("r", "c", "veg_from", "_dem", (F.col("r") + F.col("n.dr")).alias("nr"), (F.col("c") + F.col("n.dc")).alias("nc"), "n.k", "n.dist", "n.angle")
    dst = burnable.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("veg").alias("veg_to"), F.col("dem").alias("_to"))
    p = F.broadcast(tables.spread_table(spark, rules.spread))  # 49 rows
    v = tables.veg_params(spark, rules.speed, rules.fuel)  # seven rows
    d = src.join(dst, ["nr", "nc"]).join(p, ["veg_to", "veg_from"]).join(F.broadcast(v.select(F.col("veg").alias("veg_from"), "v0")), "veg_from")
    d = d.join(F.broadcast(v.select(F.col("veg").alias("veg_to"), "d0", "d1", "hhv", "hum")), "veg_to")
    return d.select("r", "c", "nr", "nc", "k", "dist", "angle", (F.col("_to") - F.col("_dem")).alias("dh"), "veg_from", "veg_to", "p", "v0", "d0", "d1", "hhv", "hum")


def trials(sources: DataFrame, e: DataFrame, bc: DataFrame, rules: Rules, moist: DataFrame | None = None, heavy: DataFrame | None = None) -> DataFrame:
    """Open edges of sources(rz, r, c, t10, dup): (rz, r, c, nr, nc, k, dup, t_src, t_arr, ros, fli).

    bc: ``intervals`` with from10 and to10. moist(bc_id, r, c, moist) overrides a condition's moisture; heavy(r, c,
    heavy_t10) says from when a cell cannot burn.
    """
    if heavy is not None:
        sources = sources.join(heavy, ["r", "c"], "left").where("heavy_t10 is null or t10 < heavy_t10").drop("heavy_t10")
    d = sources.join(e, ["r", "c"])
    b = F.broadcast(bc.select("bc_id", "from10", "to10", "w_dir", "w_speed", "moisture"))  # a job's conditions
    d = d.join(b, (F.col("t10") >= F.col("from10")) & (F.col("to10").isNull() | (F.col("t10") < F.col("to10")))).drop("from10", "to10")
    m = F.col("moisture") / 100
    if moist is not None:
        d = d.join(moist.select("bc_id", F.col("r").alias("nr"), F.col("c").alias("nc"), "moist"), ["bc_id", "nr", "nc"], "left")
        m = F.coalesce("moist", m)
    key = lambda *tag: keyed.uniform(rules.seed, F.col("rz"), F.col("r"), F.col("c"), *tag)
    w_dir, w_speed = physics.wind_angle(F.col("w_dir")), F.col("w_speed")
    if rules.noise:
        w_dir, w_speed = physics.noisy_wind(w_dir, w_speed, key(F.col("dup"), "wdir"), key(F.col("dup"), "wspeed"))
    d = d.withColumns({"_m": m, "_wd": w_dir, "_ws": w_speed})
    cols = F.col("angle"), F.col("dist"), F.col("dh"), F.col("_m"), F.col("_wd"), F.col("_ws")
    if not rules.certain:
        d = d.where(keyed.bernoulli(physics.spread_probability(F.col("p"), *cols, model=rules.moisture_model), key(F.col("k"), F.col("dup"), "open")))
    d = d.withColumn("ros", physics.ros_model(rules.ros_model)(F.col("v0"), *cols))
    d = d.withColumn("dt10", physics.tenths(physics.travel_time(F.col("ros"), F.col("dist"), F.col("dh"))))
    fli = physics.fireline_intensity(F.col("d0"), F.col("d1"), F.col("ros"), physics.lhv_dead(F.col("hhv"), F.col("_m")), physics.lhv_canopy(F.col("hhv"), F.col("hum")))
    d = d.select("rz", "r", "c", "nr", "nc", "k", "dup", F.col("t10").alias("t_src"), (F.col("t10") + F.col("dt10")).alias("t_arr"), "ros", fli.alias("fli"), *(["bc_id"] if "bc_id" in d.columns else []))
    if heavy is not None:
        h = heavy.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "heavy_t10")
        d = d.join(h, ["nr", "nc"], "left").where("heavy_t10 is null or t_arr < heavy_t10").drop("heavy_t10")
    return d.where(F.col("t_arr") <= rules.limit10)


def embers(sources: DataFrame, cells: DataFrame, bc: DataFrame, rules: Rules, rows: int, cols: int, moist: DataFrame | None = None, heavy: DataFrame | None = None) -> DataFrame:
    """Embers that burning conifers throw: (rz, r, c, nr, nc, k, dup, t_src, t_arr, ros, fli), the last two null; k is 8 and up."""
    s = sources.join(cells.where(f"veg = {physics.CONIFER}").select("r", "c"), ["r", "c"])
    key = lambda *tag: keyed.uniform(rules.seed, F.col("rz"), F.col("r"), F.col("c"), *tag)
    n = keyed.poisson(key(F.col("dup"), "embers"))
    s = s.withColumn("_n", n).where("_n > 0").withColumn("_e", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    b = F.broadcast(bc.select("bc_id", "from10", "to10", "w_dir", "w_speed", "moisture"))  # a job's conditions
    s = s.join(b, (F.col("t10") >= F.col("from10")) & (F.col("to10").isNull() | (F.col("t10") < F.col("to10"))))
    ember = lambda tag: key(F.col("dup"), F.col("_e"), tag)
    s = s.withColumns({"_a": ember("angle") * (2 * math.pi), "_wd": physics.wind_angle(F.col("w_dir"))})
    base = keyed.normal(ember("n1"), ember("n2"), physics.EMBER_MEAN, physics.EMBER_STD)
    s = s.withColumn("_d", physics.ember_distance(base, F.col("_a"), F.col("_wd"), F.col("w_speed"))).where(F.col("_d") > 2 * tables.CELL)
    dr, dc = physics.ember_shift(F.col("_d"), F.col("_a"))
    within = lambda x, size: F.greatest(F.lit(0), F.least(F.lit(size - 1), x)).cast("int")
    s = s.withColumns({"nr": within(F.col("r") + dr, rows), "nc": within(F.col("c") + dc, cols)})
    v = F.broadcast(tables.veg_params(cells.sparkSession, rules.speed, rules.fuel).select("veg", "v0"))  # seven rows
    s = s.join(cells.where("veg > 0").select(F.col("r").alias("nr"), F.col("c").alias("nc"), "veg"), ["nr", "nc"]).join(v, "veg")
    s = s.where(ember("lands") < physics.ember_success(F.col("veg")))
    m = F.col("moisture") / 100
    if moist is not None:
        s = s.join(moist.select("bc_id", F.col("r").alias("nr"), F.col("c").alias("nc"), "moist"), ["bc_id", "nr", "nc"], "left")
        m = F.coalesce("moist", m)
    zero, far = F.lit(0.0), F.lit(tables.CELL)  # flat, and as far as a cell side in cells
    ros = physics.ros_model(rules.ros_model)(F.col("v0"), zero, far, zero, m, F.col("_wd"), F.col("w_speed"))
    dt10 = physics.tenths(physics.travel_time(ros, far, zero))
    s = s.select("rz", "r", "c", "nr", "nc", (F.col("_e") + 7).alias("k"), "dup", F.col("t10").alias("t_src"), (F.col("t10") + dt10).alias("t_arr"), F.lit(None).cast("double").alias("ros"), F.lit(None).cast("double").alias("fli"), "bc_id")
    if heavy is not None:
        h = heavy.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "heavy_t10")
        s = s.join(h, ["nr", "nc"], "left").where("heavy_t10 is null or t_arr < heavy_t10").drop("heavy_t10")
    return s.where(F.col("t_arr") <= rules.limit10)


@dataclass
class Field:
    """The static side of a run."""

    cells: DataFrame
    edges: DataFrame
    bc: DataFrame
    rules: Rules
    rows: int
    cols: int
    moist: DataFrame | None = None
    heavy: DataFrame | None = None

    def attempts(self, sources: DataFrame) -> DataFrame:
        d = trials(sources, self.edges, self.bc, self.rules, self.moist, self.heavy)
        if self.rules.spotting:
            d = d.unionByName(embers(sources, self.cells, self.bc, self.rules, self.rows, self.cols, self.moist, self.heavy))
        return d

    def release(self) -> None:
        self.edges.unpersist()

    def epochs(self) -> list[tuple[int, int]]:
        """Intervals of time within which all conditions are constant; there are as many as conditions."""
        t = sorted({0, *(max(0, r["from10"]) for r in self.bc.select("from10").collect())})
        return list(zip(t, [*t[1:], NEVER]))


def prepare(cells: DataFrame, bc: DataFrame, rules: Rules, rows: int, cols: int, burned: DataFrame | None = None, moist: DataFrame | None = None, heavy: DataFrame | None = None) -> Field:
    """burned(r, c): cells that have burned before the start and can neither spread nor burn again."""
    if burned is not None:
        cells = cells.join(burned.select("r", "c").distinct(), ["r", "c"], "left_anti")
    cells = stored(cells.select("r", "c", "veg", "dem"), "cells")
    held = intervals(bc.withColumn("time", F.rint(F.col("time") * 10).cast("long")), few=True).withColumnsRenamed({"from_t": "from10", "to_t": "to10"})
    sized = lambda d, name: None if d is None else small(stored(d, name), BROADCAST)
    # dealt by source cell once: every round then shuffles its frontier only; what memory cannot hold goes to disk
    static = stored(edges(cells, rules), "edges").repartition("r", "c").persist(StorageLevel.MEMORY_AND_DISK)
    return Field(cells, static, stored(held, "bc"), rules, rows, cols, sized(moist, "moist"), sized(heavy, "heavy"))


def seeds(contour: DataFrame, n: int, t10: int | Column = 0) -> DataFrame:
    """(t10, rz, r, c): contour cells in each of n realizations."""
    return contour.select((F.lit(t10) if isinstance(t10, int) else t10).cast("long").alias("t10"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rz"), "r", "c").distinct()


def by_epoch(field: Field, start: DataFrame) -> DataFrame:
    """ignitions(rz, r, c, t_burn)."""
    first = start.join(field.cells.where("veg > 0").select("r", "c"), ["r", "c"]).where(F.col("t10") <= field.rules.limit10)
    if field.heavy is not None:
        first = first.join(field.heavy, ["r", "c"], "left").where("heavy_t10 is null or t10 < heavy_t10")
    known = stored(first.groupBy("rz", "r", "c").agg(F.min("t10").alias("t10")), "arrivals")
    rounds = 0
    for since, until in field.epochs():
        within = (F.col("t10") >= since) & (F.col("t10") < until)
        front = known.where(within)
        while True:
            found = field.attempts(front.withColumn("dup", F.lit(0))).groupBy("rz", F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.min("t_arr").alias("new"))
            better = stored(found.join(known, ["rz", "r", "c"], "left").where("t10 is null or new < t10").select("rz", "r", "c", F.col("new").alias("t10")), "better")
            if better.isEmpty():
                break
            known = known.unionByName(better).groupBy("rz", "r", "c").agg(F.min("t10").alias("t10"))
            front, rounds = better.where(within), rounds + 1
            if rounds % COMPACT == 0:
                known = stored(known, "arrivals")
        known = stored(known, "arrivals")
    return known.withColumnRenamed("t10", "t_burn")


def by_blocks(field: Field, start: DataFrame, side: int = BLOCK) -> DataFrame:
    """ignitions(rz, r, c, t_burn): whole blocks of side x side cells are searched at a time; rounds follow block borders, not hops.

    Within a condition a cell's open edges don't depend on when it burns, so that a block's are computed once, when the fire reaches
    it. A task holds one realization's block: its edges, its cells' arrivals, and what arrives from outside.
    """
    rules, spark = field.rules, start.sparkSession
    block = lambda d: d.withColumns({"br": F.floor(F.col("r") / side).cast("int"), "bc": F.floor(F.col("c") / side).cast("int")})
    first = start.join(field.cells.where("veg > 0").select("r", "c"), ["r", "c"]).where(F.col("t10") <= rules.limit10)
    if field.heavy is not None:
        first = first.join(field.heavy, ["r", "c"], "left").where("heavy_t10 is null or t10 < heavy_t10")
    known = stored(block(first.groupBy("rz", "r", "c").agg(F.min("t10").alias("t10"))), "arrivals")
    everywhere = block(field.cells.where("veg > 0").select("r", "c"))
    free = Field(field.cells, field.edges, field.bc, Rules(**{**rules.__dict__, "limit10": NEVER}), field.rows, field.cols, field.moist, None)
    at, keys = ["rz", "br", "bc"], ["rz", "r", "c"]
    rounds = 0
    for since, until in field.epochs():
        path, seen = folder(spark, "open"), None
        front = known.where((F.col("t10") >= since) & (F.col("t10") < until))
        while not front.isEmpty():
            touched = front.select(*at).distinct()
            fresh = touched if seen is None else touched.join(seen, at, "left_anti")
            sources = fresh.join(everywhere, ["br", "bc"]).select("rz", "r", "c", F.lit(since).cast("long").alias("t10"), F.lit(0).alias("dup"))
            opened = block(free.attempts(sources)).select(*at, "r", "c", "nr", "nc", (F.col("t_arr") - F.col("t_src")).alias("dt10"))
            if field.heavy is not None:
                opened = opened.join(field.heavy.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "heavy_t10"), ["nr", "nc"], "left")
            else:
                opened = opened.withColumn("heavy_t10", F.lit(None).cast("long"))
            opened = opened.select(*at, "r", "c", "nr", "nc", "dt10", "heavy_t10")
            opened.write.mode("append").parquet(path)
            seen = stored(touched if seen is None else seen.unionAll(fresh), "seen")
            edge = spark.read.schema(opened.schema).parquet(path).join(touched, at, "left_semi")
            here = known.join(touched, at, "left_semi").select(*at, "r", "c", "t10", F.lit(False).alias("new")).unionByName(front.select(*at, "r", "c", "t10", F.lit(True).alias("new")))
            found = here.groupBy(*at).cogroup(edge.groupBy(*at)).applyInPandas(_searched(since, until, rules.limit10), "rz int, r int, c int, t10 long, crossed boolean")
            # of equal arrivals one from within the block comes first: its own block has been searched from there
            best = found.groupBy(*keys).agg(F.min(F.struct("t10", "crossed")).alias("b")).select(*keys, F.col("b.t10").alias("new"), "b.crossed")
            better = stored(best.join(known.select(*keys, "t10"), keys, "left").where("t10 is null or new < t10").select(*keys, F.col("new").alias("t10"), "crossed"), "better")
            known = block(known.select(*keys, "t10").unionByName(better.select(*keys, "t10")).groupBy(*keys).agg(F.min("t10").alias("t10")))
            rounds += 1
            if rounds % COMPACT == 0:
                known = stored(known, "arrivals")
            front = block(better.where(F.col("crossed") & (F.col("t10") >= since) & (F.col("t10") < until)).select(*keys, "t10"))
        known = stored(known, "arrivals")
    return known.select(*keys, F.col("t10").alias("t_burn"))


def _searched(since: int, until: int, limit: int):
    """A block's earliest arrivals from its new sources: what is better than known, and all that leaves the block (crossed)."""

    def search(key: tuple, cells: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        near: dict[tuple, list] = {}
        for r, c, nr, nc, dt, heavy in zip(*(edge[x].tolist() for x in ("r", "c", "nr", "nc", "dt10", "heavy_t10")), strict=True):
            near.setdefault((r, c), []).append((nr, nc, dt, heavy if heavy == heavy and heavy is not None else NEVER))
        known: dict[tuple, int] = {}
        todo = []
        for r, c, t, new in zip(*(cells[x].tolist() for x in ("r", "c", "t10", "new")), strict=True):
            known[r, c] = min(t, known.get((r, c), t))
            if new:
                todo.append((t, r, c))
        if len(cells) == 0 or not todo:
            return pd.DataFrame({"rz": [], "r": [], "c": [], "t10": [], "crossed": []}).astype({"rz": "int32", "r": "int32", "c": "int32", "t10": "int64", "crossed": bool})
        side = {(r, c) for r, c in zip(edge.r.tolist(), edge.c.tolist(), strict=True)} | known.keys()
        inside: dict[tuple, int] = {}
        outside: dict[tuple, int] = {}
        heapq.heapify(todo)
        while todo:
            t, r, c = heapq.heappop(todo)
            if known[r, c] < t:
                continue
            for nr, nc, dt, heavy in near.get((r, c), ()):
                u, cell = t + dt, (nr, nc)
                if u > limit or u >= heavy:
                    continue
                if cell not in side:
                    outside[cell] = min(u, outside.get(cell, u))
                elif u < known.get(cell, NEVER):
                    known[cell] = inside[cell] = u
                    if since <= u < until:
                        heapq.heappush(todo, (u, nr, nc))
        rows = [(key[0], r, c, t, False) for (r, c), t in inside.items()] + [(key[0], r, c, t, True) for (r, c), t in outside.items()]
        return pd.DataFrame(rows, columns=["rz", "r", "c", "t10", "crossed"])

    return search


def by_tick(field: Field, start: DataFrame, multiplicity: str = "first", overshoot: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ignitions, attempts) bucket by bucket. multiplicity "reference": a cell queued k times for a bucket tries k times.

    overshoot: the bucket after the limit still runs. Each bucket appends to the two tables; none is written again.
    """
    rules, spark = field.rules, start.sparkSession
    if overshoot:  # what comes after the limit must be queued, too
        field = Field(field.cells, field.edges, field.bc, Rules(**{**rules.__dict__, "limit10": NEVER}), field.rows, field.cols, field.moist, field.heavy)
    queue = stored(start.select("t10", "rz", "r", "c"), "queue")
    burned_path, attempts_path = folder(spark, "burned"), folder(spark, "attempts")
    burned = attempts = None
    while True:
        t = queue.agg(F.min("t10")).first()[0]
        if t is None or (t > rules.limit10 and not overshoot):
            break
        bucket = queue.where(F.col("t10") == t).join(field.cells.where("veg > 0").select("r", "c"), ["r", "c"])
        if field.heavy is not None:
            bucket = bucket.join(field.heavy, ["r", "c"], "left").where("heavy_t10 is null or t10 < heavy_t10").drop("heavy_t10")
        if burned is not None:
            bucket = bucket.join(burned.select("rz", "r", "c"), ["rz", "r", "c"], "left_anti")
        order = Window.partitionBy("rz", "r", "c").orderBy("t10")
        bucket = bucket.withColumn("dup", F.row_number().over(order) - 1) if multiplicity == "reference" else bucket.distinct().withColumn("dup", F.lit(0))
        bucket = stored(bucket.select("rz", "r", "c", "t10", "dup"), "bucket")
        now = bucket.where("dup = 0").select("rz", "r", "c", F.col("t10").alias("t_burn"))
        now.write.mode("append").parquet(burned_path)
        burned = spark.read.schema(now.schema).parquet(burned_path)
        tried = field.attempts(bucket).join(burned.select("rz", F.col("r").alias("nr"), F.col("c").alias("nc")), ["rz", "nr", "nc"], "left_anti")
        tried = stored(tried, "tried")
        tried.write.mode("append").parquet(attempts_path)
        attempts = spark.read.schema(tried.schema).parquet(attempts_path)
        queue = stored(queue.where(F.col("t10") > t).unionByName(tried.select(F.col("t_arr").alias("t10"), "rz", F.col("nr").alias("r"), F.col("nc").alias("c"))), "queue")
        if overshoot and t > rules.limit10:
            break
    return burned, attempts


def by_group(field: Field, start: DataFrame) -> DataFrame:
    """ignitions(rz, r, c, t_burn): open edges as columns for every condition, then one shortest-path search a realization.

    A realization's open edges are held in one place: for grids whose edges fit a worker.
    """
    rules = field.rules
    s = start.join(field.cells.where("veg > 0").select("r", "c"), ["r", "c"]).where(F.col("t10") <= rules.limit10)
    if field.heavy is not None:
        s = s.join(field.heavy, ["r", "c"], "left").where("heavy_t10 is null or t10 < heavy_t10").drop("heavy_t10")
    when = field.bc.select(F.greatest(F.col("from10"), F.lit(0)).alias("t10"), F.col("to10").alias("_to"))
    everywhere = field.cells.where("veg > 0").select("r", "c")
    # every burnable cell as a source at the start of every condition: outcomes don't depend on when within it
    at = [r["t10"] for r in when.select("t10").collect()]
    rz = [r["rz"] for r in s.select("rz").distinct().collect()]  # the realizations' numbers
    sources = everywhere.withColumn("t10", F.explode(F.array(*(F.lit(t).cast("long") for t in at)))).withColumn("rz", F.explode(F.array(*map(F.lit, rz)) if rz else F.array().cast("array<int>"))).withColumn("dup", F.lit(0))
    free = Field(field.cells, field.edges, field.bc, Rules(**{**rules.__dict__, "limit10": NEVER}), field.rows, field.cols, field.moist, None)
    opened = free.attempts(sources).select("rz", F.col("t_src").alias("epoch"), "r", "c", "nr", "nc", (F.col("t_arr") - F.col("t_src")).alias("dt10"))
    blocked = field.heavy.select("r", "c", "heavy_t10") if field.heavy is not None else None
    heavy = {(r["r"], r["c"]): r["heavy_t10"] for r in blocked.collect()} if blocked is not None else {}  # cells of fire-fighting lines
    starts, limit = sorted(at), rules.limit10

    def search(key: tuple, seed: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple, list] = {}
        for e, r, c, nr, nc, dt in zip(edge.epoch, edge.r, edge.c, edge.nr, edge.nc, edge.dt10, strict=True):
            out.setdefault((e, r, c), []).append((nr, nc, dt))
        todo = [(t, r, c) for t, r, c in zip(seed.t10, seed.r, seed.c, strict=True)]
        heapq.heapify(todo)
        done: dict[tuple, int] = {}
        while todo:
            t, r, c = heapq.heappop(todo)
            if (r, c) in done:
                continue
            done[r, c] = t
            epoch = max((x for x in starts if x <= t), default=None)
            for nr, nc, dt in out.get((epoch, r, c), ()):
                if (nr, nc) not in done and t + dt <= limit and t + dt < heavy.get((nr, nc), NEVER):
                    heapq.heappush(todo, (t + dt, nr, nc))
        return pd.DataFrame([(key[0], r, c, t) for (r, c), t in done.items()], columns=["rz", "r", "c", "t_burn"])

    return s.groupBy("rz").cogroup(opened.groupBy("rz")).applyInPandas(search, "rz int, r int, c int, t_burn long")


def attempts_of(field: Field, ignitions: DataFrame) -> DataFrame:
    """All open trials of a finished run: those whose destination had not burned when the source did."""
    tried = field.attempts(ignitions.select("rz", "r", "c", F.col("t_burn").alias("t10"), F.lit(0).alias("dup")))
    burned = ignitions.select("rz", F.col("r").alias("nr"), F.col("c").alias("nc"), "t_burn")
    return tried.join(burned, ["rz", "nr", "nc"], "left").where("t_burn is null or t_src < t_burn")
