"""Sends the package to the executors, which may not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application, once; Spark serves it to every executor."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="gaugeworks-zip-"))
    source = folder / "source"
    shutil.copytree(PACKAGE, source / PACKAGE.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / PACKAGE.name), "zip", source))
    _shipped.add(application)
