"""The folder that driver and executors share: cutting the lineage of loops by tables in it, and deleting these."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that written() and folder() have made, until release().
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only in local mode, where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="codequarry-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def folder(spark: SparkSession, tag: str) -> str:
    """The name of a new folder in the shared one."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back. Outlives lost executors."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what was written to the shared folder. Call it once the results are written elsewhere."""
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
