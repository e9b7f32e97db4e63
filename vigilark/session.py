"""Session factory used by tests, the bench and interactive work."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "vigilark", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session in UTC with adaptive execution on; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
