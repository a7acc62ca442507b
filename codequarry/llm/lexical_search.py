"""Operator 12: ranked lexical search over document shards.

Queries (benchmark items) are taken in blocks of bounded text. For a block, one pass over the documents
cuts them into shards and writes each shard's postings of the block's terms as compressed sparse rows: where
each term's postings begin, the documents' places and the terms' frequencies, with the shard's document
frequencies, lengths and ids. Document frequencies of all shards are summed by term. A second pass over the
shards turns every posting into an integer impact, once for all queries; a query then adds the impacts of its
terms, term at a time, into a dense array with an entry for each document of the shard. The k-th largest
score is found by argpartition; every document above it stays, and of those that have it the least ids. A task
merges its shards' results as it goes, so that it returns k rows a query at most; Spark merges the tasks'.
Documents' texts are never shuffled, and memory is bounded by a shard.

Nulls: null texts hold no terms and are neither found nor counted; such items find nothing. Null ids are kept: a document without one comes last
among equal scores, an item without one has a ranking of its own. Documents of one id are ranked each; of equal rows of items one counts; items of one id
and different texts are ranked each. Very long texts are indexed whole, in shards of their own if need be. Empty tables give an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm._common import Words, as_terms, bounded, documents, materialise

TOP = 10
#: Documents of a shard at most; a shard also ends with the batch of rows that reaches a worker.
SHARD = 10_000
#: Bytes of queries that meet the documents in one pass, about.
BLOCK_BYTES = 8 << 20
#: In impacts and lengths: fixed values of the definition.
LENGTH_SHARE, SATURATION, SCALE = 75, 8, 1_000_000_000


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return as_terms(pa.array([text], pa.large_string()))[0].as_py().split()


def shards(docs: DataFrame, vocabulary: list[bytes], size: int = SHARD) -> DataFrame:
    """doc_ids, lens (terms by document), n_docs and n_terms of those that have any, and the postings of the vocabulary: starts by
    term, places and tfs."""
    known = pa.array(vocabulary, pa.large_binary())

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                some = batch.slice(a, size)
                words = Words(as_terms(some.column("text")), lower=False)
                lens = np.diff(words.bounds)
                term = pc.fill_null(pc.index_in(words.words, value_set=known), -1).to_numpy(zero_copy_only=False)[words.codes]
                there = term >= 0
                key = term[there].astype(np.int64) * some.num_rows + words.texts()[there]
                key, tf = np.unique(key, return_counts=True)
                starts = np.searchsorted(key, np.arange(len(vocabulary) + 1) * some.num_rows)
                row = {"doc_ids": some.column("doc_id").to_pylist(), "lens": lens.astype(np.int64).tobytes(), "n_docs": int((lens > 0).sum()), "n_terms": int(lens.sum())}
                row |= {"starts": starts.astype(np.int64).tobytes(), "places": (key % some.num_rows).astype(np.int32).tobytes(), "tfs": tf.astype(np.int32).tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("doc_ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), *((c, pa.binary()) for c in ("starts", "places", "tfs"))]))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(indexed, "doc_ids array<long>, lens binary, n_docs long, n_terms long, starts binary, places binary, tfs binary")


def frequencies(held: DataFrame, n: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary, over all shards."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for batch in batches:
            for starts in batch.column("starts").to_pylist():
                df += np.diff(np.frombuffer(starts, np.int64))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    out = np.zeros(n, np.int64)
    for r in held.select("starts").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # the block's terms
        out[r["term"]] = r["n"]
    return out


def impacts(weight: np.ndarray, starts: np.ndarray, tfs: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of every posting of a shard, in 64 bits; length: of each posting's document, in hundredths of the usual length."""
    return np.repeat(weight, np.diff(starts)) * (SCALE * tfs // (1000 * tfs + SATURATION * length))


def best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0, largest first; order: by place, what decides among equal ones (the least)."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        above, equal = at[scores[at] > least], at[scores[at] == least]
        if len(equal) > (more := k - len(above)):
            equal = equal[np.argpartition(order[equal], more - 1)[:more]]
        at = np.concatenate([above, equal])
    return at[np.lexsort((order[at], -scores[at]))]


class Merged:
    """The best k of what is added, by query."""

    def __init__(self, k: int):
        self.k, self.own = k, {}

    def add(self, query: int, ids: list, scores: list) -> None:
        rows = self.own.get(query, []) + list(zip((-s for s in scores), (i is None for i in ids), ids, strict=True))
        self.own[query] = sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[: self.k]


def blocks_of(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """The items' ids and terms, block after block; each collects about block_bytes at most."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if block := [(r["item_id"], found) for r in rows if (found := Counter(terms_of(r["text"])))]:
            yield block


def searched(docs: DataFrame, block: list[tuple[int | None, Counter]], top: int = TOP, shard: int = SHARD) -> DataFrame:
    """query (a number in the block), doc_id and score of the top documents of each query, from every task."""
    vocabulary = sorted(set().union(*(c for _, c in block)))
    place = {w: i for i, w in enumerate(vocabulary)}
    asked = [(np.array([place[w] for w in c]), np.array(list(c.values()), np.int64)) for _, c in block]
    held = materialise(shards(docs, vocabulary, shard), "postings")
    sums = held.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n, all_terms = sums["n"] or 0, sums["l"] or 0
    df = frequencies(held, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = Merged(top)
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.slice(row, 1).to_pylist()[0]
                lens, starts = np.frombuffer(x["lens"], np.int64), np.frombuffer(x["starts"], np.int64)
                places, tfs = np.frombuffer(x["places"], np.int32), np.frombuffer(x["tfs"], np.int32).astype(np.int64)
                length = 100 - LENGTH_SHARE + LENGTH_SHARE * lens * n // max(1, all_terms)
                own, ids = impacts(weight, starts, tfs, length[places]), x["doc_ids"]
                order = np.empty(len(ids), np.int64)  # ranks of the ids, null last
                order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
                for query, (terms, times) in enumerate(asked):
                    scores = np.zeros(len(ids), np.int64)
                    for t, m in zip(terms.tolist(), times.tolist(), strict=True):
                        at = slice(starts[t], starts[t + 1])
                        scores[places[at]] += m * own[at]  # a term's places are distinct
                    if len(top_places := best(scores, order, top)):
                        merged.add(query, [ids[i] for i in top_places], scores[top_places].tolist())
        rows = [(query, i, -s) for query, own in merged.own.items() for s, _, i in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["query", "doc_id", "score"])

    return held.mapInArrow(found, "query long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's `top` documents."""
    bounded(docs.sparkSession)
    result = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks_of(items, block_bytes):
        made = searched(docs, block, top, shard)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ids = F.element_at(F.split(F.lit(",".join("" if i is None else str(i) for i, _ in block)), ",").cast("array<string>"), F.col("query").cast("int") + 1)
        result = result.unionByName(ranked.select(F.nullif(ids, F.lit("")).cast("long").alias("item_id"), "rank", "doc_id", "score"))
    return result


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op12_lexical_search": op12_lexical_search}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
size AS (SELECT k, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
whole AS (SELECT COUNT(*)::BIGINT AS docs, SUM(n)::BIGINT AS terms FROM size),
item AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT q, item_id, w, COUNT(*)::BIGINT AS m FROM (SELECT q, item_id, unnest(t) AS w FROM item) GROUP BY ALL),
post AS (SELECT k, w, COUNT(*)::BIGINT AS tf FROM (SELECT k, unnest(t) AS w FROM d) WHERE w IN (SELECT w FROM asked) GROUP BY ALL),
weight AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT w, COUNT(*)::BIGINT AS df FROM post GROUP BY w), whole),
impact AS (SELECT k, doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS impact FROM post JOIN size USING (k) JOIN weight USING (w), whole),
score AS (SELECT q, item_id, k, doc_id, SUM(m * impact)::BIGINT AS score FROM asked JOIN impact USING (w) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0) WHERE rank <= 10
"""
ORACLE_SQL: dict[str, str] = {"op12_lexical_search": _SQL.strip()}
