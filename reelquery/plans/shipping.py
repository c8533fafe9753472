"""Sends this package to the executors, whose Python workers may not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_reelquery_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    if os.path.isdir(package):  # else it came in an archive, which is shipped already
        path = os.path.join(tempfile.mkdtemp(prefix="reelquery-"), "reelquery_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(package):
                for name in sorted(files):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
    sc._reelquery_shipped = True
