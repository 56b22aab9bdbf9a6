"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where it is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="leakloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Cuts:
    """Each call writes a DataFrame once and rereads it, so that a lost executor costs no recomputation of what came before.

    Results are lazy and may read these tables, so they stay until the driver ends; ``forget`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/cuts-{uuid.uuid4().hex}", 0
        path, fs = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        schema = df.schema
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{self.n}")

    def forget(self, upto: int) -> None:
        """Deletes the tables numbered up to ``upto``."""
        for k in range(1, upto + 1):
            path, fs = self._fs(f"{self.root}/{k}")
            fs.delete(path, True)
