"""Operator 7: token-id files with Elias-Fano document boundaries.

A file is a run of shards, one row each of a Parquet table in the shared folder, so that writing
is atomic, survives lost executors and works on any file system Spark knows. A shard's blob:

    magic "CQT1", id width (2 or 4 bytes), n documents, n null doc_ids, n ids  (little-endian)
    the ids, concatenated in ascending doc_id order (nulls first, ties in any order)
    Elias-Fano of the documents' ends, Elias-Fano of the doc_ids less their smallest

Elias-Fano stores value >> l in unary and the low l bits packed, about 2 + log2(universe / n) bits
a value; every SAMPLE-th one bit of the unary part has its place stored, from which select()
reaches any offset by counting bits in a few bytes. No table of 64-bit offsets exists.

Nulls: null text is the empty text (only the end id); a document without id keeps its place with
a null doc_id. Repeated ids and repeated rows are all kept, one output row each. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm._common import documents, materialise
from codequarry.llm._tokenizer import encoder, tokenizer_path

END_ID = 2
SAMPLE = 64
MAGIC = b"CQT1"
HEAD = struct.Struct("<4sBIIQ")
EF_HEAD = struct.Struct("<IBQII")


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about n * (2 + log2(u / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values, n = np.asarray(values, np.uint64), len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1, np.uint8)
        unary[places] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return EF_HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The structure at a place of blob, and the place behind it; arrays are views, not copies."""
        n, low_bits, a, b, c = EF_HEAD.unpack_from(blob, at)
        at += EF_HEAD.size
        low, high = np.frombuffer(blob, np.uint8, a, at), np.frombuffer(blob, np.uint8, b, at + a)
        return cls(n, low_bits, low, high, np.frombuffer(blob, "<u4", c, at + a + b)), at + a + b + 4 * c

    def _low(self, i: int) -> int:
        bits = np.unpackbits(self.low[(first := i * self.low_bits) // 8 : (first + self.low_bits + 7) // 8], bitorder="little")
        return int.from_bytes(np.packbits(bits[first % 8 : first % 8 + self.low_bits], bitorder="little").tobytes(), "little")

    def select(self, i: int) -> int:
        """Value i, from the nearest sampled one bit on, without decoding the rest."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, left = place // 8, left + 1 + bin(int(self.high[place // 8]) & ((1 << place % 8) - 1)).count("1")
        while (ones := int(self.high[byte]).bit_count()) < left:
            left, byte = left - ones, byte + 1
        bits = int(self.high[byte])
        for _ in range(left - 1):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def decode(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        low = (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if self.low_bits else np.zeros(self.n, np.uint64)
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | low


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    flat = np.concatenate(ids).astype(f"<u{width}", copy=False) if ids else np.zeros(0, "<u2")
    base = int(known[0]) if len(known) else 0
    ends = EliasFano.of(np.cumsum([len(x) for x in ids], dtype=np.int64))
    offsets = EliasFano.of(known.astype(np.uint64) - np.uint64(base % (1 << 64)))  # exact also for negative ids
    return HEAD.pack(MAGIC, width, len(doc_ids), len(doc_ids) - len(known), len(flat)) + struct.pack("<q", base) + flat.tobytes() + ends.to_bytes() + offsets.to_bytes()


class Shard:
    """Random access to one shard: document i's ids by two select() calls."""

    def __init__(self, blob: bytes):
        magic, width, self.n, self.n_null, self.n_ids = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        (self.base,) = struct.unpack_from("<q", blob, HEAD.size)
        at = HEAD.size + 8
        self.ids = np.frombuffer(blob, "<u2" if width == 2 else "<u4", self.n_ids, at)
        self.ends, at = EliasFano.from_bytes(blob, at + width * self.n_ids)
        self.offsets, at = EliasFano.from_bytes(blob, at)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]

    def doc_ids(self) -> list[int | None]:
        shifted = self.offsets.decode() + np.uint64(self.base % (1 << 64))
        return [None] * self.n_null + shifted.astype(np.int64).tolist()


def key() -> Column:
    """The id that orders documents; null ids count as the least."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def bounds_of(docs: DataFrame, parts: int) -> list[int]:
    """parts - 1 quantiles of the ids; an id that fills several parts stands there several times."""
    shares = [k / parts for k in range(1, parts)]
    made = docs.agg(F.percentile_approx(key(), shares, 100 * parts).alias("x")).first()["x"] if shares else None
    return list(made or [])


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_ids: int = 4_000_000) -> DataFrame:
    """Tokenise docs and write their shards to the shared folder; the table of shards, read back.

    Texts are encoded where they are read; their ids, two bytes each, are then dealt to parts by
    quantiles of the doc_ids and sorted. An id that repeats often is dealt to all the parts that it
    fills. A task holds one Arrow batch and at most about shard_ids ids at a time.
    """
    path = path or tokenizer_path()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(bounds_of(docs, parts), np.int64)
    width = 2 if max(encoder(path).vocabulary, end_id + 1) <= 1 << 16 else 4

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.array([end_id], np.uint32)
        for batch in batches:
            key, tie = batch.column("key").to_numpy(), batch.column("tie").to_numpy()
            low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
            part = low + (tie.view(np.uint64) % (high - low + 1).astype(np.uint64)).astype(np.int64)
            at, made, size = 0, [], 0
            for ids in own.encode(batch.column("text")):
                made.append(np.concatenate([ids, end]).astype(f"<u{width}").tobytes())
                size += len(made[-1])
                if size > 4 << 20 or at + len(made) == batch.num_rows:
                    to = at + len(made)
                    yield pa.RecordBatch.from_arrays([pa.array(part[at:to], pa.int32()), *(batch.column(c).slice(at, len(made)) for c in ("doc_id", "tie")), pa.array(made, pa.binary())], ["part", "doc_id", "tie", "ids"])
                    at, made, size = to, [], 0

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list = []
        size = 0

        def flush():
            row = {"part": [part], "number": [number], "n_ids": [size], "n_docs": [len(doc_ids)]}
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in row.values()), pa.array([pack_shard(doc_ids, held, width)], pa.binary())], [*row, "blob"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                held.append(np.frombuffer(ids, f"<u{width}"))
                size += len(held[-1])
                if size >= shard_ids:
                    yield flush()
                    doc_ids, held, size, number = [], [], 0, number + 1
        if doc_ids:
            yield flush()

    rows = docs.select(key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text", F.monotonically_increasing_id()))  # equal rows too are spread
    rows = rows.mapInArrow(encoded, "part int, doc_id long, tie long, ids binary").repartitionById(parts, "part")
    return materialise(rows.select("doc_id", "tie", "ids").sortWithinPartitions("doc_id", "tie").mapInArrow(shards, "part long, number long, n_ids long, n_docs long, blob binary"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, out of the shards' bytes alone.

    Shards know their part and their number in it: starts are running sums over the shards of a part
    and over the parts, of which there are as many as shuffle partitions.
    """

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "blob")), strict=True):
                shard = Shard(blob)
                ends = shard.ends.decode().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part] * n, pa.int64()), "number": pa.array([number] * n, pa.int64()), "doc_id": pa.array(shard.doc_ids(), pa.int64()), "within": pa.array(starts), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64())}
                )

    rows = shards.select("part", "number", "blob").mapInArrow(documents_of, "part long, number long, doc_id long, within long, n_tokens long, ids_crc32 long")
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("before"))
    starts = shards.select("part", "number", earlier(Window.partitionBy("part").orderBy("number")).alias("base")).join(parts, "part")
    return rows.join(starts, ["part", "number"]).select("doc_id", (F.col("before") + F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(documents(spark, sf_dir)))


QUERIES = {"op7_token_files": op7_token_files}
ORACLE_SQL: dict[str, str] = {}
