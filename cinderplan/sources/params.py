"""Job parameters: JSON with defaults, boundary conditions sorted and padded, fixed actions merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderplan.operators.ordered import numbered

ACTIONS = ["waterline_action", "heavy_action", "canadair", "helicopter"]
CONDITION = "time double, w_dir double, w_speed double, moisture double, " + ", ".join(f"{a} array<string>" for a in [*ACTIONS, "ignitions"])
SCHEMA = (
    "time_limit double, time_resolution double, n_threads int, grid_dim_km double, tileset string, ros_model string, prob_moist_model string, do_spotting boolean, "
    "init_date string, w_dir double, w_speed double, moisture double, prob_file string, v0_file string, p_vegetation string, "
) + ", ".join(f"{a} array<string>" for a in [*ACTIONS, "ignitions"])
# What a job runs with where its parameters are silent.
DEFAULTS = {"n_threads": 10, "grid_dim_km": 20.0, "tileset": "default", "ros_model": "wang", "prob_moist_model": "new_formula", "w_dir": 0.0, "w_speed": 0.0, "moisture": 0.0, "time_resolution": 60.0, "do_spotting": False}


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f.strip().replace(" ", ":", 1) for f in ddl.split(",")) + ">"


def schema() -> str:
    return f"{SCHEMA}, boundary_conditions array<{_struct(CONDITION)}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The parameter file as one row with defaults filled in; malformed files fail."""
    return with_defaults(spark.read.schema(schema()).option("mode", "FAILFAST").json(path, multiLine=True))


def with_defaults(d: DataFrame) -> DataFrame:
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in d.columns})


def merged(own: Column, fixed: Column) -> Column:
    """A condition's list of actions and the job's fixed ones; null lists count as empty."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(own, none), F.coalesce(fixed, none))


def conditions(p: DataFrame) -> DataFrame:
    """Boundary conditions (bc_id, time, w_dir, w_speed, moisture, actions and ignitions) in time order.

    Without any, the job's own wind and moisture hold from time 0; before a first condition that starts later, calm
    holds. Equal times keep the order of the file.
    """
    base = F.array(F.struct(F.lit(0.0).alias("time"), "w_dir", "w_speed", "moisture", *(F.lit(None).cast("array<string>").alias(a) for a in [*ACTIONS, "ignitions"])))
    d = p.withColumn("_bc", F.when(F.size(F.coalesce("boundary_conditions", F.array().cast(f"array<{_struct(CONDITION)}>"))) > 0, F.col("boundary_conditions")).otherwise(base))
    rows = d.select(*(F.col(a).alias(f"_{a}") for a in ACTIONS), F.posexplode("_bc").alias("pos", "b"))
    rows = rows.select("pos", F.coalesce("b.time", F.lit(0.0)).alias("time"), *(F.coalesce(f"b.{c}", F.lit(0.0)).alias(c) for c in ("w_dir", "w_speed", "moisture")), *(merged(F.col(f"b.{a}"), F.col(f"_{a}")).alias(a) for a in ACTIONS), F.coalesce("b.ignitions", F.array().cast("array<string>")).alias("ignitions"))
    return sort_and_pad(rows, few=True)


def sort_and_pad(rows: DataFrame, few: bool = False) -> DataFrame:
    """rows(pos, time, ...) numbered by time; a calm row at 0 goes first if the first starts later.

    few: rows are a job's own list of conditions, which one task may sort; otherwise they are any table.
    """
    first = rows.agg(F.min("time").alias("time")).where("time > 0")
    calm = first.select(*((F.lit(-1) if f.name == "pos" else F.lit(0.0) if f.name == "time" or f.dataType.typeName() == "double" else F.array()).cast(f.dataType).alias(f.name) for f in rows.schema))
    d = rows.unionByName(calm)
    d = d.withColumn("bc_id", F.row_number().over(Window.orderBy("time", "pos")) - 1) if few else numbered(d, "time", "pos", name="bc_id")
    return d.drop("pos")


def ignitions(p: DataFrame, bc: DataFrame) -> DataFrame:
    """All ignition literals (time, literal): the job's own at 0, conditions' at theirs."""
    own = p.select(F.lit(0.0).alias("time"), F.explode("ignitions").alias("literal"))
    return own.unionAll(bc.select("time", F.explode("ignitions").alias("literal")))


def time_limit(from_json: float | None, cli_hours: float | None) -> float | None:
    """Minutes: the file's, else the command line's hours; 0 and nothing mean no limit."""
    minutes = from_json if from_json is not None else cli_hours * 60 if cli_hours else None
    return minutes or None


def spotting(from_json: bool | None, cli: bool) -> bool:
    return cli if from_json is None else from_json
