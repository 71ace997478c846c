"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adaptive execution with skew handling; sizes are left to the cluster's own settings."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Typed state of the live strips.
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture costs more than building the column it is for.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def local_session(cores: int | str = 8, app: str = "fieldspark") -> SparkSession:
    return (
        tuned(SparkSession.builder.master(f"local[{cores}]").appName(app))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
