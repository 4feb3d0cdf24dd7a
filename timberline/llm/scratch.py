"""Written tables that cut lineage.

Every intermediate result that is used more than once, or that ends an
iteration, is written as Parquet below the shared folder that the cluster
names in ``spark.checkpoint.dir`` and read again from there, so a lost
executor costs a re-read and never a recomputation of the whole plan.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session. Only a session of a single machine, such as
    the tests', may go without one and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.timberline.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        root = "file://" + tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.timberline.scratch.dir", root)
    return root.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The URI that Spark understands by ``path``: one without a scheme lies in the
    cluster's default file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return f"file://{uri.getPath()}" if uri.getScheme() == "file" else str(uri.toString())


class Scratch:
    """One folder of written tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back from the shared folder."""
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Remove one table that no later plan reads."""
        self._delete(f"{self.path}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the session has ended; the cluster clears the folder
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p.getFileSystem(conf).delete(p, True)
