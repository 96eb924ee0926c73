"""The package for executors: Python functions that run there import it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to an application's Python files, once; where it is installed on executors that changes nothing."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
    _done.add(context.applicationId)
