"""Operator 6: best-fit packing by minimum bin slack.

Only the lengths 1..capacity matter, so the search runs on a histogram that never grows with the
corpus. Each bin starts with the longest piece left; a bitset subset-sum over the lengths that
remain finds the fullest feasible combination; it is taken as often as its pieces allow and then
removed. Every take uses up some length or nearly so, hence a few thousand patterns at most.
Pieces as long as a bin are a bin each, numbered where they are made. The others get their bin by
their rank within their length; lengths are dealt into salts of some SALT_PIECES pieces, as many as
the corpus needs, so that no length is ranked in one task, nor are equal rows.

Nulls: null text is the empty text (only the end id). Rows with a null or repeated doc_id are
packed like any other. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm._common import documents, materialise
from codequarry.llm._tokenizer import encoder, tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Pieces of one length in a salt, about.
SALT_PIECES = 250_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than capacity if cut."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how many of each, whose sum is the largest that fits room; long pieces preferred."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            grown = (reach | reach << k * length) & mask
            if grown != reach:
                steps.append((length, k, reach))
                reach = grown
            left, k = left - k, 2 * k
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= k * length
    return used


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, lengths) until nothing is left."""
    counts, out = {x: n for x, n in counts.items() if n}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        used = fullest({x: n for x, n in rest.items() if n}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[x] // k for x, k in used.items())
        out.append((times, used))
        for x, k in used.items():
            counts[x] -= times * k
            if not counts[x]:
                del counts[x]
    return out


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; number, of its own, below 0 for a piece of capacity ids."""
    path = path or tokenizer_path()

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, end = encoder(path), np.array([end_id], np.uint32)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "number": []}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text")), strict=True):
                raw = np.concatenate([ids, end]).astype("<u4").tobytes()
                for k, (a, n) in enumerate(cut(len(raw) // 4, capacity)):
                    number += 1
                    for name, x in zip(rows, (doc_id, k, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), -number if n == capacity else number), strict=True):
                        rows[name].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c == "piece" else pa.int64()) for c, x in rows.items()], list(rows))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(tokenised, "doc_id long, piece int, start long, length long, ids_crc32 long, number long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, salt_pieces: int = SALT_PIECES) -> DataFrame:
    """Every piece with its sequence_id (below 0 for full pieces) and offset."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    held = materialise(pieces(docs, path, capacity), "pieces")
    rest = held.where("number > 0")
    # capacity rows, then one for each salt: some rows in a million pieces
    totals = np.zeros(capacity + 1, np.int64)
    for r in rest.groupBy("length").count().collect():
        totals[r["length"]] = r["count"]
    salts = -(-totals // salt_pieces)
    ends = np.cumsum(salts)
    dealt = F.element_at(F.split(F.lit(",".join(map(str, salts.tolist()))), ",").cast("array<long>"), F.col("length").cast("int") + 1)
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("number"), dealt))
    counts = np.zeros(int(ends[-1]), np.int64)
    for r in rest.groupBy("length", "salt").count().collect():
        counts[ends[r["length"]] - salts[r["length"]] + r["salt"]] = r["count"]
    before = np.cumsum(counts) - counts  # of all shorter pieces and of lower salts
    first_of = (np.cumsum(totals) - totals)[np.repeat(np.arange(capacity + 1), salts)]
    base = before - first_of
    spans: dict[int, list] = {}  # by length: first rank, pieces a bin, first sequence, offset of the first piece
    taken, sequence = np.zeros(capacity + 1, np.int64), 0
    for times, used in patterns({int(x): int(totals[x]) for x in np.flatnonzero(totals)}, capacity):
        offset = 0
        for length, k in used.items():
            spans.setdefault(length, []).append((int(taken[length]), k, sequence, offset))
            taken[length] += times * k
            offset += k * length
        sequence += times
    table = {x: np.array(rows, np.int64).T for x, rows in spans.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy() for c in ("length", "salt", "rank"))
            rank = rank - 1 + base[(ends - salts)[length] + salt] if len(rank) else rank
            sequence_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own, (first, k, seq, off) = length == x, table[int(x)]
                j = np.searchsorted(first, rank[own], "right") - 1
                nth = rank[own] - first[j]
                sequence_id[own], offset[own] = seq[j] + nth // k[j], off[j] + nth % k[j] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence_id), pa.array(offset)], [*names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("number")
    ranked = rest.withColumn("rank", F.row_number().over(order).cast("long"))
    own = ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return own.unionByName(held.where("number < 0").select(*names, F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
