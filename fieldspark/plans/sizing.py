"""Size checks that decide between a plain plan and one cut into bounded pieces."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows one task may hold for one window group before the group is cut.
MAX_GROUP_ROWS = 5_000_000
# Rows a side may have to be broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def group_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.fieldspark.maxGroupRows", str(MAX_GROUP_ROWS)))


def largest_group(df: DataFrame, group: list[str]) -> int:
    """Rows of the largest group."""
    if not group:
        return df.count()
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def fits_one_task(df: DataFrame, group: list[str]) -> bool:
    """Whether every group has few enough rows.  The whole row count is tried first: it is free on parquet."""
    limit = group_limit(df.sparkSession)
    return df.count() <= limit or (bool(group) and largest_group(df, group) <= limit)


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a side counted to be small; otherwise Spark shuffles it."""
    small = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if small else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a temporary one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="fieldspark-checkpoint-")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the checkpoint folder: later reads take only the columns they need, and no
    executor keeps rows in memory."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
