"""Writing the code tables: inserts that ignore known keys, updates, resets, backups and generated files.

Tables are Parquet folders. An update writes a new folder beside the old one, so that readers of the
old one and lost tasks do no harm; the caller moves on to the new one.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

col = F.col


def insert(new: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows of new whose keys are not there yet, one for each key; how many that were."""
    spark = new.sparkSession
    fresh, where = new.dropDuplicates(keys), spark._jvm.org.apache.hadoop.fs.Path(path)
    there = spark.read.parquet(path).select(*keys) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None
    fresh = fresh if there is None else fresh.join(there, keys, "left_anti")
    before = 0 if there is None else there.count()
    fresh.select(*new.columns).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the values of changes, where these are not null, in rows of the same key."""
    names = [c for c in changes.columns if c != key]
    joined = table.join(changes.select(key, *(col(c).alias(f"new_{c}") for c in names)), key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in names else col(c) for c in table.columns))


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows in place of those of the same key, and the others of them added."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def reset(table: DataFrame, path: str) -> None:
    """Leave an empty table of the same columns."""
    table.limit(0).write.mode("overwrite").parquet(path)


def backed_up(containers: DataFrame, backup_id: str, at: Column) -> DataFrame:
    own = containers.where("source_code IS NOT NULL")
    return own.select(F.lit(backup_id).alias("backup_id"), col("id").alias("container_id"), col("source_code").alias("original_source_code"), at.alias("backup_timestamp"))


def eliminated(containers: DataFrame) -> DataFrame:
    return containers.withColumn("source_code", F.lit(None).cast("string"))


def restored(containers: DataFrame, backup: DataFrame, backup_id: str) -> DataFrame:
    saved = backup.where(col("backup_id") == backup_id).select(col("container_id").alias("id"), col("original_source_code").alias("saved"))
    return containers.join(saved, "id", "left").withColumn("source_code", F.coalesce("saved", "source_code")).select(*containers.columns)


def retained(backup: DataFrame, now: Column, days: int) -> DataFrame:
    return backup.where(col("backup_timestamp") >= now - F.make_dt_interval(F.lit(days)))


def file_system(directory: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (file, hdfs, s3, gs) or a plain path, and the path on it."""
    return fs.FileSystem.from_uri(directory.replace("s3a://", "s3://", 1) if "://" in directory else "file://" + directory.removeprefix("file:"))


def write_files(files: DataFrame, directory: str) -> int:
    """Write content to path under a directory that all executors share; a task that runs again writes the same files."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(directory)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                full = posixpath.normpath(posixpath.join(root, path))
                if not full.startswith(posixpath.normpath(root) + "/"):
                    raise ValueError(f"outside of the directory: {path}")
                system.create_dir(posixpath.dirname(full), recursive=True)
                aside = f"{full}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(aside) as f:
                    f.write((content or "").encode())
                system.move(aside, full)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "content").mapInPandas(written, "n long").agg(F.sum("n")).first()[0] or 0
