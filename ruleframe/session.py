"""Sessions for local work, and what every query needs of a session it is given."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def get_or_create(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are tested with; on a cluster the caller brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies, whatever the session's own search path is."""
    known = spark.sparkContext.environment
    parts = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in parts:
        known["PYTHONPATH"] = os.pathsep.join([str(ROOT), *parts])
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{directory}/{name}.parquet")
