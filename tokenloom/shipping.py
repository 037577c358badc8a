"""Python workers import this package too; send it to executors that don't have it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the application's Python files, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _SENT:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tokenloom-")  # the driver's own; executors fetch the file from the driver
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent).as_posix())
        spark.sparkContext.addPyFile(str(archive))
        _SENT.add(application)
    return spark
