"""Operator 13: target-distribution importance resampling by an exact integer-score histogram.

Features are runs of one to three words, hashed into BUCKETS buckets by crc32. Two multinomials over the
buckets, of the target (the benchmark) and of the raw corpus, make an integer gain for each bucket: the
smoothed log ratio in thousandths. A document's weight is the sum of its features' gains, and its score adds
Gumbel noise drawn from a hash of its id, so that the largest scores are a sample without replacement in
proportion to exp(weight / 1000).

The corpus is read twice, once to count buckets (one row a bucket leaves each task) and once to score, in
arrays: the crc32 of a run is put together from those of its words. Scores are integers; their exact
histogram is sorted by ranges, each range's total (one row a range) goes to the driver, and suffix sums over
ranges and within them say how many documents score higher than each score. The cutoff is the score at which
the draw is full; only scores from it on are ranked, each by row_number in order of doc_id. No text is ever shuffled.

Nulls: null texts have no words, no features and weight 0. A null doc_id is hashed as no characters and comes last among ties.
Repeated ids and rows are drawn and ranked each; of rows that tie in all of doc_id, weight and features any may come first. Very long texts count
whole. An empty target or an empty corpus counts as no features; empty documents give an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm._common import Words, as_terms, bounded, documents, materialise

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
#: Documents drawn, of a hundred that have LEAST_WORDS words.
PERCENT = 5
SEED = 42
#: Distinct scores in a range of the histogram, about.
RANGE_SCORES = 200_000
#: Lengths of words whose crc32 is put together from tables.
TABLED = 32


def _zeros_after() -> np.ndarray:
    """[n, k, b]: the crc32 register of byte b at place k, once n zero bytes are read."""
    one = np.zeros(256, np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        one[b] = c
    table = np.zeros((TABLED, 4, 256), np.uint32)
    table[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(1, TABLED):
        table[n] = (table[n - 1] >> np.uint32(8)) ^ one[table[n - 1] & np.uint32(255)]
    return table


ZEROS = _zeros_after()


def longer(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two strings one after the other, from that of each and the size of the right one."""
    out, small = np.zeros(len(left), np.uint32), size < TABLED
    n = np.where(small, size, 0)
    for k in range(4):
        out ^= ZEROS[n, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(~small):  # words of many bytes are few
        c, rest = left[i], int(size[i])
        while rest:
            step = min(rest, TABLED - 1)
            c = np.bitwise_xor.reduce(ZEROS[step, np.arange(4), (c >> np.uint32(8) * np.arange(4, dtype=np.uint32)) & np.uint32(255)])
            rest -= step
        out[i] = c
    return out ^ right


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and of every feature of a batch its text's number and its bucket."""
    words = Words(as_terms(column), lower=False)
    lens, own = np.diff(words.bounds), words.distinct
    alone = np.fromiter(map(zlib.crc32, own), np.uint32, len(own))[words.codes]
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in own), np.uint32, len(own))[words.codes]
    size = np.fromiter(map(len, own), np.int64, len(own))[words.codes] + 1
    text, left = words.texts(), np.repeat(words.bounds[1:], lens) - np.arange(len(words.codes))
    run, at = alone, np.arange(len(words.codes))
    texts, hashes = [text], [run]
    for k in range(1, LONGEST):
        going = left[at] > k
        run, at = run[going], at[going]
        run = longer(run, spaced[at + k], size[at + k])
        texts.append(text[at])
        hashes.append(run)
    return lens, np.concatenate(texts), np.concatenate(hashes) % np.uint32(BUCKETS)


def slices(batch: pa.RecordBatch, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for some in slices(batch):
                total += np.bincount(features(some.column("text"))[2], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    bounded(texts.sparkSession)
    made = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in made.collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to raw, by bucket."""
    s_all, t_all = int(raw.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratio = lambda s, t: (float(t + 1) * float(s_all)) / (float(s + 1) * float(t_all))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    fields = ["doc_id", "n_words", "n_features", "weight", "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                lens, text, bucket = features(some.column("text"))
                order = np.argsort(text, kind="stable")
                n = np.bincount(text, minlength=len(lens))
                sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])[np.concatenate([[0], np.cumsum(n)])]
                weight, drawn = np.diff(sums), np.array([noise(i, seed) for i in some.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (lens, n, weight, weight + drawn))], fields)

    bounded(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(scored, ", ".join(f"{c} long" for c in fields))


def histogram(scores: DataFrame, range_scores: int = RANGE_SCORES) -> tuple[DataFrame, int]:
    """Of the column score: each distinct one with the number of rows n that have it and of rows `before` that score higher; and the number of rows."""
    counts = materialise(scores.groupBy("score").agg(F.count("*").alias("n")), "score-counts")
    ranges = max(1, -(-counts.count() // range_scores))
    held = materialise(counts.repartitionByRange(ranges, F.desc("score")).withColumn("part", F.spark_partition_id()), "score-ranges")
    totals = {r["part"]: r["n"] for r in held.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a range
    higher, n = [], 0
    for part in range(max(totals, default=-1) + 1):
        higher.append(n)
        n += totals.get(part, 0)
    within = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.split(F.lit(",".join(map(str, higher))), ",").cast("array<long>"), F.col("part") + 1)
    return held.select("score", "n", (base + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before")), n


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, range_scores: int = RANGE_SCORES) -> DataFrame:
    """doc_id, n_features, weight, score of every row, and its rank if it is drawn."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = materialise(weighted(docs, gain, seed), "scores")
    able = F.col("n_words") >= LEAST_WORDS
    steps, n = histogram(rows.where(able), range_scores)
    wanted = n * percent // 100
    found = steps.where(F.col("before") < wanted).agg(F.min("score")).first()[0] if wanted else None
    names = ["doc_id", "n_features", "weight", "score"]
    if found is None:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    drawable = able & (F.col("score") >= found)
    tied = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features")
    first = rows.where(drawable).join(steps.where(F.col("score") >= found).select("score", "before"), "score")
    rank = F.col("before") + F.row_number().over(tied)
    first = first.withColumn("rank", rank).select(*names, F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank"))
    return first.unionByName(rows.where(~drawable).select(*names, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_resampling": op13_resampling}

_SQL = rf"""
WITH RECURSIVE step AS (SELECT i::BIGINT AS i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS crc FROM step WHERE k = 8),
sides AS (SELECT 'd' AS side, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
own AS (SELECT side, k, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM sides),
word AS (SELECT side, k, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3 FROM own),
gram AS (SELECT side, k, g FROM (SELECT side, k, unnest([w1, w1 || ' ' || w2, w1 || ' ' || w2 || ' ' || w3]) AS g FROM word) WHERE g IS NOT NULL),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM gram)), crcs),
feature AS (SELECT side, k, bucket, COUNT(*)::BIGINT AS n FROM gram JOIN hashed USING (g) GROUP BY ALL),
bucket AS (SELECT bucket, COALESCE(SUM(n) FILTER (side = 'd'), 0)::BIGINT AS s, COALESCE(SUM(n) FILTER (side = 'b'), 0)::BIGINT AS t FROM feature GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (SUM(s) OVER () + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (SUM(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM bucket),
weight AS (SELECT k, SUM(n)::BIGINT AS n_features, SUM(n * gain)::BIGINT AS weight FROM feature JOIN gain USING (bucket) WHERE side = 'd' GROUP BY k),
score AS (SELECT doc_id, len(w) AS n_words, COALESCE(n_features, 0) AS n_features, COALESCE(weight, 0) AS weight,
  COALESCE(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || COALESCE(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM own LEFT JOIN weight USING (k) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS r, COUNT(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS able FROM score)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND r <= able * {PERCENT} // 100 THEN r END AS rank FROM ranked
"""
ORACLE_SQL: dict[str, str] = {"op13_resampling": _SQL.strip()}
