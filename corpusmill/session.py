"""Sessions and the shipping of this package to executors that don't have it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def create(app: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is the cluster's own setting."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    b = b.master(master) if master else b
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, unless PYTHONPATH already leads them to it."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    work = tempfile.mkdtemp(prefix="corpusmill-code-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, work, ignore_errors=True)
    shutil.copytree(root, f"{work}/src/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{work}/{root.name}", "zip", f"{work}/src"))
    _shipped.add(app)
