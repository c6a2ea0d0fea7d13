"""Makes the package importable on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors' Python, unless their path names it already."""
    context = spark.sparkContext
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{_ROOT.name}", "zip", _ROOT.parent, _ROOT.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
