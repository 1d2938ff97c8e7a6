"""Puts this package on the executors."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application once; executors that find them by their own path are no worse off."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    root = pathlib.Path(__file__).resolve().parent.parent
    with tempfile.NamedTemporaryFile(prefix="lodestone-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(f.name)
    _done.add(context.applicationId)
