"""Source files as rows, and checks of paths and addresses before anything is read."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions.source_text import language_of

#: Directories that are never read.
IGNORED = (".git", "node_modules", "target", "dist", "build", ".next", "__pycache__", ".pytest_cache", "venv", ".env")
SYSTEM = ("/etc", "/proc", "/sys", "/dev", "/boot", "/root", "/var/log")
MOST_BYTES, TOTAL_BYTES, MOST_FILES = 10 << 20, 500 << 20, 10_000
EMPTY_INIT = "# Empty __init__.py file\n"


def underscored(spark: SparkSession, directory: str) -> list[str]:
    """Files whose names begin with an underscore, such as __init__.py: Spark's own reader leaves them out."""
    top = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found, out = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().startswith("_"):
            out.append(path.toString())
    return out


def raw(spark: SparkSession, directory: str) -> DataFrame:
    """path, length and content (bytes) of every file below a directory of any file system that Spark reads."""
    read = spark.read.format("binaryFile")
    own = read.option("recursiveFileLookup", True).load(directory)
    own = own.select("path", "length", "content")
    if more := underscored(spark, directory):
        paths = spark.createDataFrame([(x,) for x in more], "path string").repartition(max(1, len(more) // 1000))
        own = own.unionByName(paths.mapInPandas(opened, "path string, length long, content binary"))
    return own


def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files read by Arrow's file systems, where they are asked for."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch["path"]:
            store, place = fs.FileSystem.from_uri("file://" + path.removeprefix("file:").removeprefix("//") if path.startswith("file:") else path)
            with store.open_input_file(place) as f:
                content = f.read()
            rows.append((path, len(content), content))
        yield pd.DataFrame(rows, columns=["path", "length", "content"])


def decoded(content: Column) -> Column:
    """Text of bytes in UTF-8 (without its mark); null if they are not."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.regexp_replace(text, "^\ufeff", "")


def lenient(content: Column) -> Column:
    """Text and encoding of bytes: UTF-8, else Latin-1, in which any bytes are a text."""
    good = decoded(content)
    return F.when(good.isNotNull(), F.struct(good.alias("text"), F.lit("utf-8").alias("encoding"))).otherwise(F.struct(F.decode(content, "ISO-8859-1").alias("text"), F.lit("latin1").alias("encoding")))


def ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED)))


def scan(spark: SparkSession, directory: str) -> DataFrame:
    """path, language, content and hash of the files of known languages; those that are not UTF-8 are left out."""
    below = F.regexp_replace("path", "^.*?" + re.escape(directory.rstrip("/")), "")
    files = raw(spark, directory).where(~ignored(below)).withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    text = decoded(F.col("content"))
    own = files.select("path", "language", text.alias("text")).where("text IS NOT NULL")
    content = F.when(F.col("text").rlike(r"^\s*$") & F.col("path").endswith("/__init__.py"), EMPTY_INIT).otherwise(F.col("text"))
    return own.select("path", "language", content.alias("content"), F.sha2(content.cast("binary"), 256).alias("hash"))


def discover(spark: SparkSession, directory: str, most_bytes: int = MOST_BYTES, total_bytes: int = TOTAL_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """The files to analyse, in order of their paths: none above most_bytes, and no more than add up to
    total_bytes and most_files. The limits are the feature; only the first most_files paths and lengths meet in one task."""
    own = raw(spark, directory).select("path", "length").where(~ignored(F.col("path")) & language_of(F.col("path")).isNotNull() & (F.col("length") <= most_bytes))
    own = own.orderBy("path").limit(most_files).withColumn("upto", F.sum("length").over(Window.orderBy("path")))
    return own.where(F.col("upto") <= total_bytes).select("path", "length")


def checked_path(path: str) -> str:
    """The absolute path, unless it climbs or names a system directory."""
    if not path or "\0" in path or ".." in path.replace("\\", "/").split("/"):
        raise ValueError("not a path inside a project")
    full = os.path.abspath(path)
    if any(full == s or full.startswith(s + "/") for s in SYSTEM):
        raise ValueError("a system directory")
    return full


def checked_url(url: str) -> str:
    """The address, if it is one of a repository elsewhere."""
    made = urlparse(url or "")
    if made.scheme not in ("http", "https", "git") or not made.hostname:
        raise ValueError("not an address of a repository")
    if made.hostname in ("localhost", "127.0.0.1", "0.0.0.0", "::1"):
        raise ValueError("an address of this machine")
    return url


def valid_url(url: Column) -> Column:
    """checked_url() as a condition on a column."""
    host = F.regexp_extract(F.lower(url), r"^(?:https?|git)://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1)
    return F.coalesce((host != "") & ~host.isin("localhost", "127.0.0.1", "0.0.0.0", "[::1]"), F.lit(False))
