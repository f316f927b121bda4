"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def shipped(spark: SparkSession) -> None:
    """Give the executors this package, as --py-files does, once for each context."""
    context = spark.sparkContext
    if any(x.endswith(f"{PACKAGE.name}.zip") for x in context._python_includes):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
