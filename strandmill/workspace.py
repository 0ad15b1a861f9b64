"""Tables that cut the lineage of iterative jobs.

They are written to the folder that all executors share, named by
``spark.checkpoint.dir``; an executor that is lost takes nothing with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the setting is missing a new temporary one is set, but only if all tasks run in this process."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{SETTING} is not set: on {master} intermediate tables need a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


class Workspace:
    """A folder for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as a scan of the written table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
