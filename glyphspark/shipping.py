"""Ships this package to the executors of a session that can't import it themselves."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file, once for each Spark context."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        folder = Path(tempfile.mkdtemp(prefix="glyphspark-zip-"))  # the driver serves the file as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        package = Path(__file__).resolve().parent
        shutil.copytree(package, folder / "in" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "in"))
        _SHIPPED.add(sc.applicationId)
