"""Session settings used by tests, bench and examples. Production jobs bring their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "wardline") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
