"""Intermediate tables in the folder that all executors share.

A table written there cuts the lineage and survives the loss of executors.  The
folder is ``spark.checkpoint.dir`` of the session.  Where that is unset, a session in local mode (as in
tests) takes a folder of this machine; on a cluster that would lose rows and is an error.
Tables that a result still reads stay until the session ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run of an operator, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="tabdelta-")
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._saved: list[tuple[DataFrame, str]] = []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.deleteOnExit(path)

    def save(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        """Write ``df`` and return it read back.

        The shuffles behind it are done with then, and Spark deletes their files as the write ends.  What it remembers of
        them goes when the driver collects garbage, which it seldom does by itself, so it is asked to.
        """
        path = f"{self.root}/{len(self._saved)}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.spark._jvm.java.lang.System.gc()
        table = self.spark.read.schema(df.schema).parquet(path)
        self._saved.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later step reads."""
        for table in tables:
            for saved, at in self._saved:
                if saved is table:
                    self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(at), True)

    def clear(self) -> None:
        """Delete all saved tables, when what they led to is written elsewhere."""
        self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root), True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    Beyond the bound Spark joins it by a shuffle.
    """
    return F.broadcast(df) if df.count() <= rows else df
