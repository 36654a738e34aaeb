"""Makes the package known to Python workers that would not find it by themselves."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's files, once, unless PYTHONPATH or the working folder leads workers to it."""
    root = Path(__file__).resolve().parents[2]
    found = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    app = spark.sparkContext.applicationId
    if str(root) in found or app in _DONE or (Path(os.getcwd()) / "ridgeline").exists():
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-ridgeline-')}/ridgeline", "zip", root, "ridgeline")
    spark.sparkContext.addPyFile(made)
    _DONE.add(app)
