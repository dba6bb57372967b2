"""Sessions for local work; on a cluster the caller brings a session of its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine with UTC clocks and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemill")
        .config("spark.driver.memory", os.environ.get("TIDEMILL_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
