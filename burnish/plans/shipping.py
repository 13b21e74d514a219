"""Make this package importable in the Python workers of every executor."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package along with the application, once; needed before a Python stage.

    Spark serves the file to executors, also to those that join later. Nothing is sent when
    the package came with ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped or not _PACKAGE.is_dir():
        return
    folder = tempfile.mkdtemp(prefix=f"{_PACKAGE.name}-")
    archive = shutil.make_archive(
        f"{folder}/{_PACKAGE.name}", "zip", _PACKAGE.parent, _PACKAGE.name
    )
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
