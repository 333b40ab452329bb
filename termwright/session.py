"""Spark session helper used by tests, the benchmark and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "termwright", cores: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution on; on a cluster, build your own and pass it in."""
    spark = (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TERMWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
