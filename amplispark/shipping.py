"""Sends the package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DONE = "spark.amplispark.shipped"


def ship(spark: SparkSession) -> None:
    """Adds the package's source files, zipped, to the session's Python files, once a session: it may not be installed on the executors."""
    if spark.conf.get(DONE, "no") == "yes":
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="amplispark-"), "amplispark.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "amplispark")):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(to)
    spark.conf.set(DONE, "yes")
