"""Make this package importable in Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application.

    Needed where it isn't installed there; Spark's own file server carries it,
    so executors and driver need no common folder.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillspark-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "quillspark_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
