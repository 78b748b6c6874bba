"""Session defaults: AQE on, UTC, ANSI, Arrow batches bounded."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # tables that are bucketed by some of a join's keys need no exchange
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | None = None, app: str = "tilesmith", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", "8g")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus)} | extra).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
