"""Session settings this library is tuned for.

Callers may bring any session; nothing in the library depends on these values
for correctness.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # runtime re-planning: partition coalescing, skewed-partition splitting,
    # broadcast only when the measured side is small
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # pattern matching makes even a small partition worth a task of its own
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # A side already hash-partitioned on (dataset, id) may join on
    # (dataset, id, ...) without another exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def builder(app_name: str = "diagtab", cores: str | int = "*", shuffle_partitions: int | None = None):
    """A session builder with the library settings, for local runs and tests."""
    b = SparkSession.builder.appName(app_name).master(f"local[{cores}]").config("spark.ui.enabled", "false")
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    memory = os.environ.get("SPARK_DRIVER_MEMORY", "8g")
    return b.config("spark.driver.memory", memory)
