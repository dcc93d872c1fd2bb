"""SparkSession factory with the settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: ANSI arithmetic, adaptive execution with skew handling, and a fixed time zone.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(cpus: int | None = None, **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's own session is used."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{n}]").appName("brindle")
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"} | settings).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{os.path.realpath(tempfile.mkdtemp(prefix='brindle-'))}"
        found = _own[context.applicationId]
    return found.rstrip("/")
