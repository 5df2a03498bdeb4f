"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def folder(spark: SparkSession, name: str) -> str:
    """A new folder on storage that all executors share; a local one only on a local master that names none (tests)."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own = root = _own or tempfile.mkdtemp(prefix="cinderplan-")
    return f"{root.rstrip('/')}/cinderplan/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: lineage ends here, and a lost executor costs no recomputation."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has no more than ``rows`` rows; otherwise left to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
