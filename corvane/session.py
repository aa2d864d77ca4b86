"""A session for local use; on a cluster the submitting side decides."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, Arrow transfer and UTC. Shuffle partitions follow the cores here; adaptive execution merges small ones."""
    n = cpus or os.cpu_count() or 1
    b = SparkSession.builder.appName("corvane")
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    if "SPARK_MASTER" not in os.environ:
        defaults |= {"spark.master": f"local[{n}]", "spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
