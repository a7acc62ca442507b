"""What the corpus operators share: the shared folder, folds and token arrays."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.plans import lineage
from codequarry.plans.lineage import folder

#: Words of the contracts: runs of anything but ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"


#: Bytes of rows that reach a Python worker at once: texts may be very long.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, where the session allows larger ones."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that bucketed() has named, until release().
TABLES: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete what operators have written to the shared folder. Call it once the results are written elsewhere."""
    while TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {TABLES.pop()}")
    lineage.release(spark)


@contextmanager
def cleaned(spark: SparkSession, cleanup: bool) -> Iterator[None]:
    """With cleanup, the shuffles of what is written within are deleted once it is."""
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if cleanup else kept)
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, kept)


def materialise(df: DataFrame, tag: str, cleanup: bool = False, by: str | None = None) -> DataFrame:
    """Write df to the shared folder, in a folder for each value of `by` if given, and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    bounded(spark)
    path = folder(spark, tag)
    with cleaned(spark, cleanup):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, by: str, n: int) -> DataFrame:
    """As materialise(), in n buckets by a column: tables with as many buckets are joined by it without a shuffle."""
    spark = df.sparkSession
    bounded(spark)
    name = f"{tag}_{uuid.uuid4().hex}"
    with cleaned(spark, True):
        df.write.bucketBy(n, by).option("path", folder(spark, tag)).saveAsTable(name)
    TABLES.append(name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that nothing reads any more."""
    spark = df.sparkSession
    for parent in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, mod k; null for a null id, which is then never learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(k)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings, '' for null."""
    return [x or "" for x in column.to_pylist()]


#: A-Z lower-cased; every other ASCII character that is neither letter nor digit is a space.
TERM_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def as_terms(column: pa.Array) -> pa.Array:
    """Texts as binary in which terms (runs of letters, digits and characters beyond ASCII, A-Z lower-cased) stand between spaces; '' for null."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if column.offset:
        column = column.take(pa.array(np.arange(len(column))))
    raw = column.buffers()[2]
    mapped = TERM_BYTES[np.frombuffer(raw, np.uint8)] if raw else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(column), [None, column.buffers()[1], pa.py_buffer(mapped)])


class Words:
    """The words of a batch of texts as codes into the batch's distinct words.

    codes: int32 code of each word, all texts one after another; bounds: int64, text i has
    codes[bounds[i]:bounds[i + 1]]; distinct: the words as bytes.
    """

    def __init__(self, column: pa.Array, lower: bool = True):
        if column.offset:  # a slice, once cast, misleads ascii_lower
            column = column.take(pa.array(np.arange(len(column))))
        if pa.types.is_large_binary(column.type):  # as large_string, without a check of UTF-8
            column = pa.Array.from_buffers(pa.large_string(), len(column), column.buffers(), offset=column.offset)
        column = pc.fill_null(column.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
        flat, ends = pc.list_flatten(split), np.cumsum(pc.list_value_length(split).to_numpy())
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        seen = np.concatenate([[0], np.cumsum(full)])
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.bounds = seen[np.concatenate([[0], ends])].astype(np.int64)
        self.codes = coded.indices.to_numpy().astype(np.int32) if len(coded) else np.zeros(0, np.int32)
        self.words = coded.dictionary.cast(pa.large_binary())

    @property
    def distinct(self) -> list[bytes]:
        return self.words.to_pylist()

    def texts(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each distinct word."""
        return hash_bytes(self.words)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift), over whole arrays."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


def hash_bytes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of a binary array: two crc32 passes, mixed."""
    words = words.to_pylist()
    first = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    second = np.fromiter((zlib.crc32(w[::-1], 0x5BD1E995) for w in words), np.uint64, len(words))
    return mix((first << np.uint64(32)) | second)
