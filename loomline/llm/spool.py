"""Durable intermediate tables, so that a lost executor never costs lineage.

Everything goes to the shared folder that the session names in spark.checkpoint.dir. Only
a session on one machine (tests) may leave it unset and gets a folder of its own; on a
cluster that is an error. A run's tables go when the application ends, those that are
used up before go at once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch between the JVM and its Python workers.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/loomline-checkpoints"
    return found


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes (for the session, if it has a greater bound): texts are long, and rows no measure of them."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small frame; its files go when the frame is no longer referenced."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


class Spool:
    """A folder of Parquet tables of one run."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/loomline/{what}-{uuid.uuid4().hex}"
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at)
        self._fs.deleteOnExit(self._at)
        small_batches(spark)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write and read again. The shuffle files that the write has made go as it ends."""
        at, conf = f"{self.path}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        finally:
            conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Tables that nothing reads any more."""
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
