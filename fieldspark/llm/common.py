"""Helpers the operators share: shared folders, written tables, let-expressions, words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.plans.sizing import ensure_checkpoint_dir

#: Characters that part words, as a Java and DuckDB pattern.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there and columns can be pruned."""
    path, conf = shared_folder(df.sparkSession, name), df.sparkSession.conf
    # Shuffle files of the finished write are of no more use; without this they stay until the driver collects garbage.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more, so that a long job doesn't keep them all at once."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def local_path(uri: str) -> str | None:
    """The path of a file: URI, None for other stores."""
    return re.sub(r"^file:(//)?(?=/)", "", uri) if re.match(r"^(file:|/)", uri) else None


class Store:
    """Files of a shared folder as Python tasks see them: file: paths or what pyarrow can open."""

    def __init__(self, folder: str):
        self.local = local_path(folder)
        if self.local is None:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)

    def write(self, name: str, chunks) -> None:
        """Write under a temporary name, then rename: a repeated or killed attempt leaves no half file."""
        import os

        attempt = f".{name}.{uuid.uuid4().hex}"
        if self.local is None:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(f"{self.root}/{attempt}") as out:
                for c in chunks:
                    out.write(c)
            self.fs.move(f"{self.root}/{attempt}", f"{self.root}/{name}")
            return
        os.makedirs(self.local, exist_ok=True)
        with open(os.path.join(self.local, attempt), "wb") as out:
            for c in chunks:
                out.write(c)
        os.replace(os.path.join(self.local, attempt), os.path.join(self.local, name))

    def open(self, name: str):
        import os

        if self.local is None:
            return self.fs.open_input_stream(f"{self.root}/{name}", compression=None)
        return open(os.path.join(self.local, name), "rb")
