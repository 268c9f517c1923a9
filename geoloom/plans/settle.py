"""Intermediate results that are written: later plans read columns of them, and lost executors do not lose them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. A local session without one gets a folder of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Whether Spark deletes a plan's shuffle files at its end, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back. The files go when the driver ends or `discard` is called, the write's shuffle files at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/geoloom/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    atexit.register(_discard, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._geoloom_path = path  # noqa: SLF001
    return out


def discard(df: DataFrame) -> None:
    """Deletes what settled() wrote. Only for tables that no later plan reads."""
    _discard(df.sparkSession, df._geoloom_path)  # noqa: SLF001


def _discard(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001
    except Exception:  # noqa: BLE001  the session has ended; the folder is temporary
        pass
