"""Gives this package to the Python workers of a session, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package's modules as a ZIP file that Spark hands to every worker, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-package-"), f"{root.name}.zip")  # the driver's; Spark serves it from there
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(application)
