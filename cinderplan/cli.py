"""Command line: python -m cinderplan.cli -f params.json -of out -dem dem.tif -veg veg.tif -zone 29."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from cinderplan.plans.simulation import Simulation
from cinderplan.sources import params
from cinderplan.sources.grids import NoTilesError

OK, FAILED, NO_TILES = 0, 1, 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Simulates wildfire spread.")
    p.add_argument("-f", dest="params", required=True, help="parameters (JSON)")
    p.add_argument("-of", dest="out", required=True, help="output folder")
    p.add_argument("-tl", dest="hours", type=float, default=None, help="time limit in hours, unless the parameters have one")
    p.add_argument("-dem", help="heights (TIFF)")
    p.add_argument("-veg", help="fuel classes (TIFF)")
    p.add_argument("-zone", type=int, default=0, help="UTM zone of rasters that don't say theirs")
    p.add_argument("-tiles", help="tile table (Parquet), instead of rasters")
    p.add_argument("-side", type=int, default=2000, help="cells a side of a tile")
    p.add_argument("-id", dest="run_id", help="the run's name, for the log")
    p.add_argument("-it", dest="image_time", help="accepted and not used, as are -st and -sf")
    p.add_argument("-st", dest="isochrone_time", type=int, help=argparse.SUPPRESS)
    p.add_argument("-sf", dest="simplify", type=float, default=0.00001, help=argparse.SUPPRESS)
    p.add_argument("-d", dest="debug", action="store_true", help="log more")
    p.add_argument("-v", dest="grids", action="store_true", help="write fuels and heights too (Parquet)")
    p.add_argument("-sr", dest="realizations", action="store_true", help="write the burn times of each realization too (Parquet)")
    p.add_argument("-spo", dest="spotting", action="store_true", help="with fire spotting")
    p.add_argument("-seed", type=int, default=42)
    p.add_argument("-plan", choices=["block", "epoch", "tick", "group"], default="block")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.debug else logging.INFO, stream=sys.stdout)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    logging.info("run %s", a.run_id or "")
    spark = SparkSession.builder.appName("cinderplan").getOrCreate()
    try:
        s = Simulation(spark, params.read(spark, a.params), a.seed, a.hours, a.spotting)
        s = s.load_tiles(spark.read.parquet(a.tiles), a.side) if a.tiles else s.load_files(a.veg, a.dem, a.zone)
        s.run(a.plan).write(a.out)
        if a.grids:
            s.cells.write.mode("overwrite").parquet(f"{a.out}/grids")
        if a.realizations:
            s.burned.write.mode("overwrite").parquet(f"{a.out}/realizations")
    except NoTilesError:
        logging.exception("no tiles")
        return NO_TILES
    except Exception:
        logging.exception("failed")
        return FAILED
    return OK


if __name__ == "__main__":
    sys.exit(main())
