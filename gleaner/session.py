"""Makes this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_gleaner_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="gleaner-"), "gleaner_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*")):
            if f.suffix in (".py", ".json"):
                z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._gleaner_shipped = True
