"""Session set-up."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What a session of ours sets where nothing is set: adaptive plans, UTC, Arrow.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "sextant", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword names have ``__`` for the dots of Spark's settings."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_sextant_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sextant-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(folder, "tree")
    shutil.copytree(package, root / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", root))
    sc._sextant_shipped = True
