"""Tables that a job writes to the shared folder and reads again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file of a stored table of known length, so that files follow the rows and not the shuffle's partitions.
FILE_ROWS = 8192


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that set with setCheckpointDir; without either a temporary one, in local
    mode only: executors elsewhere could not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def stored(df: DataFrame, release: bool = False, rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation of what came
    before. The folder goes when the driver's JVM ends. With release, Spark is made to look
    for shuffle files that nothing refers to any more, which else stay for long. With rows
    (about how many df has), small tables have few files, of FILE_ROWS each.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    jvm = spark.sparkContext._jvm
    if release:
        gc.collect()
        jvm.System.gc()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by stored(); nothing may read it afterwards."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._plumbline_path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
