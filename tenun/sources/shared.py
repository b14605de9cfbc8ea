"""Working tables in the folder that driver and executors share.

Long lineages are cut by writing a Parquet table there and reading it again:
such a table survives the loss of any executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder the session names; in local mode one of our own if none is named."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tenun-")
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


def open_shared(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder as tasks reach it without Spark, and the name in it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/(?!/)", "file:///", uri)))


ROWS_PER_FILE = 500_000


def files_for(rows: int) -> int:
    """How many files a table of ``rows`` narrow rows is worth."""
    return max(4, -(-rows // ROWS_PER_FILE))


class Workspace:
    """One run's tables under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: later plans start from the files.

        With ``files``, small rows made by many tasks are gathered into so many
        files; ``files_for`` gives a number that grows with the rows.
        """
        if files:
            df = df.repartition(files)
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _files(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def uri(self, name: str) -> str:
        """A table's whole path, for ``open_shared``."""
        path, system = self._files(name)
        return system.makeQualified(path).toString()

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path, system = self._files(name)
        system.delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these: the ones that a result still reads."""
        path, system = self._files()
        for found in system.listStatus(path) if system.exists(path) else []:
            if found.getPath().getName() not in names:
                system.delete(found.getPath(), True)
