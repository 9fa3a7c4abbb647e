"""Making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds this package's source to the session's Python files, once a context."""
    context = spark.sparkContext
    if getattr(context, "_helixion_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="helixion-"), "helixion_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("helixion", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._helixion_shipped = True
