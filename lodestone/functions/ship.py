"""Python workers need the package that their functions come from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per context; they may not have it on their path."""
    sc = spark.sparkContext
    if not getattr(sc, "_lodestone_shipped", False):
        root = Path(__file__).resolve().parents[1]
        name = f"{tempfile.mkdtemp(prefix='lodestone-')}/lodestone.zip"  # the driver serves the file itself
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(name)
        sc._lodestone_shipped = True
