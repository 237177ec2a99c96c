"""Makes the package importable in Python workers, wherever the session was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once per Spark context.

    Spark's own file server hands the archive to the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_calibrant_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(_PACKAGE.rglob("*.py")):
            target.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    context._calibrant_shipped = True
