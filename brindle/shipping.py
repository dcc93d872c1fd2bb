"""Gives Python workers the package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: adds a zip of this package, unless driver and workers are one machine's processes and find it there.

    The driver's path says nothing about a cluster's executors, so there it is always sent.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    local = context.master == "local" or context.master.startswith("local[")
    on_path = [os.path.realpath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p]
    if not (local and str(ROOT) in on_path):
        path = os.path.join(tempfile.mkdtemp(prefix="brindle-"), "brindle.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted([*ROOT.glob("brindle/**/*.py"), *ROOT.glob("corpus_pipeline.py")]):
                z.write(f, f.relative_to(ROOT))
        context.addPyFile(path)
    _shipped.add(context.applicationId)
