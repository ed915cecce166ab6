"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a cluster must name; only a local session without one gets its own."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sievework-")
    context.setCheckpointDir(found)
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the application ends."""
    context = spark.sparkContext
    own = f"{shared_dir(spark).rstrip('/')}/sievework/{context.applicationId}"
    _files(spark, own).deleteOnExit(_path(spark, own))
    return f"{own}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder, read back: its rows are computed once and outlive executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sw_path = path
    return out


def bucketed(df: DataFrame, by: list[str], name: str = "bucketed", buckets: int | None = None) -> DataFrame:
    """df as a table in the shared folder whose files are split and sorted by columns, so that joins on them need no shuffle of it.

    ``discard`` deletes it, table and files.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = scratch_path(spark, name), f"sievework_{uuid.uuid4().hex}"
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._sw_path, out._sw_table = path, table
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of checkpointed() and bucketed() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "_sw_table"):
            spark.sql(f"DROP TABLE IF EXISTS {df._sw_table}")
        delete(spark, df._sw_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it."""
    _files(spark, path).delete(_path(spark, path), True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all in a folder."""
    return _files(spark, path).getContentSummary(_path(spark, path)).getLength()


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are done, which Spark deletes only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path."""
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
