"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_tidemark_shipped"


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once; Spark itself brings them to the executors.

    Functions are pickled by name, so the workers must be able to import them wherever the driver found them.
    """
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        path = Path(tempfile.mkdtemp(prefix="sources-")) / "tidemark.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, f"{package.name}/{file.relative_to(package)}")
        context.addPyFile(str(path))
    setattr(context, _SHIPPED, True)
