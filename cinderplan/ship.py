"""Gives executors this package, wherever the driver runs from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: How much a batch between Spark and a Python worker may hold; both keep some of them beside their heaps.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources, zipped, to the Python path of the application's workers, once; bounds Arrow batches unless the session does."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if sc.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="cinderplan-")) / "cinderplan.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, Path(root.name) / source.relative_to(root))
    sc.addPyFile(str(path))
    _done.add(sc.applicationId)
