"""Operator 10: benchmark decontamination by BM25 retrieval with block-max WAND.

Test items are the indexed side and every passage of every training document is a query. A score
is the BM25 sum over the passage's distinct terms, divided by what the item's own text scores, so
that one threshold fits every item. Items are indexed by classes of length, each twice as long as the last; a
class's passages are windows of twice its length, with enough overlap for every stretch of an item's
length to lie whole within one, so that an item is judged alike whatever else is indexed. Of every item, the terms that most items
share, up to half the threshold together, are set aside; passages whose impacts on the others
can't reach what an item then lacks are passed over (exactly, in whole batches); the others run
WAND over posting lists with block maxima and yield every item above the threshold. An item counts
as leaked if both its question and its answer (its last sentence) stand in the passage: at least
OVERLAP of the word trigrams of each. A half of one or two words stands there if these follow each other; if
both halves are so short, the item is one half.

The index is built from blocks of items of bounded size, each of which meets all documents once; terms'
document frequencies are those of all items. Documents are never shuffled.

Nulls: null texts have no words; such items and documents match nothing. An item without an id is an item like any other, and all of one text are one, reported with a null item_id. Repeated items count once, items of one id and different texts each, of which the best match is reported; of passages
with equal scores the first is reported. Very long texts are searched whole, passage by passage.
Rows with null or repeated doc_id are searched like any other. Extra columns are ignored by
search() and kept by clean(), whatever their names; empty tables give no matches.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm._common import documents, materialise, texts_of

K1, B = 1.2, 0.75
#: Least share of an item's own score.
THRESHOLD = 0.6
#: Least share of the trigrams of the question, and of the answer.
OVERLAP = 0.6
#: Words of the longest item in the shortest class.
SHORTEST = 64
POSTING_BLOCK = 32
#: Bytes of item text in one block of the index, about.
BLOCK_BYTES = 8 << 20
#: ASCII that is neither letter nor digit separates words.
SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode(errors="replace").translate(SPACED).split()


def grams(own: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    """Runs of n words."""
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}


def halves(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: the last sentence, or both the whole if there is one
    or if both are short."""
    parts = [w for x in re.split(r"(?<=[.?!])\s+|\n+", text) if (w := words(x))]
    question, answer = [w for x in parts[:-1] for w in x], parts[-1] if parts else []
    if not question or len(question) < 3 > len(answer):
        return words(text), words(text)
    return question, answer


def length_class(n: int) -> int:
    """Least SHORTEST * 2 ** k that is n or more."""
    size = SHORTEST
    while size < n:
        size *= 2
    return size


class Index:
    """Normalised BM25 impacts of a block of items, as posting lists with block maxima."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[bytes, int], n_items: int, average: float, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items = [i for i, _ in items]
        tokens = [words(t) for _, t in items]
        longest = length_class(max(map(len, tokens), default=0))
        self.sides = [tuple((n := min(3, len(own)), grams(own, n)) for own in halves(t)) for _, t in items]
        self.vocabulary: dict[bytes, int] = {}
        lists: list[list[tuple[int, float]]] = []
        essential: list[tuple[int, int, float]] = []
        self.need = np.zeros(len(items))
        for i, own in enumerate(tokens):
            norm = K1 * (1 - B + B * len(own) / average)
            tf = Counter(own)
            impact = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            total = sum(impact.values())
            aside = 0.0
            for w, x in sorted(impact.items(), key=lambda x: (-df[x[0]], x[0])):
                if self.vocabulary.setdefault(w, len(lists)) == len(lists):
                    lists.append([])
                lists[t := self.vocabulary[w]].append((i, x / total))
                if not essential or essential[-1][1] != i:
                    if aside + x / total <= threshold / 2:
                        aside += x / total
                        continue
                essential.append((t, i, x / total))
            self.need[i] = threshold - aside - 1e-9
        self.ids = [[i for i, _ in x] for x in lists]
        self.impacts = [[v for _, v in x] for x in lists]
        self.block_max = [[max(v[k : k + POSTING_BLOCK]) for k in range(0, len(v), POSTING_BLOCK)] for v in self.impacts]
        self.top = [max(x) for x in self.impacts]
        essential.sort()
        self.terms, self.owners, self.shares = (np.array(x, kind) for x, kind in zip(zip(*essential, strict=True), (np.int64, np.int64, np.float64), strict=True))
        self.first = np.searchsorted(self.terms, np.arange(len(lists) + 2))
        self.window = 2 * longest
        self.step = self.window - longest + 1

    def passages(self, coded: list[np.ndarray]) -> list[list[int]]:
        """By text, the starts of the passages in which some item may reach the threshold."""
        lens = np.fromiter(map(len, coded), np.int64, len(coded))
        windows = np.maximum(1, -(-lens // self.step))
        base, begin = np.cumsum(windows) - windows, np.cumsum(lens) - lens
        flat = np.concatenate([*coded, np.zeros(0, np.int64)])
        at = np.flatnonzero((n := self.first[flat + 1] - self.first[flat]) > 0)
        text = np.repeat(np.arange(len(coded)), lens)[at]
        place, n = at - begin[text], n[at]
        entry = np.repeat(self.first[flat[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        window = np.repeat(place // self.step + base[text], n)
        again = np.repeat((place // self.step > 0) & (place % self.step + self.step < self.window), n)
        key = np.concatenate([window, window[again] - 1]) * len(self.items) + np.concatenate([self.owners[entry], self.owners[entry[again]]])
        share, order = np.concatenate([self.shares[entry], self.shares[entry[again]]]), np.argsort(key)
        key, heads = np.unique(key[order], return_index=True)
        sums = np.add.reduceat(share[order], heads) if len(key) else share
        hot = np.unique(key[sums >= self.need[key % len(self.items)]] // len(self.items))
        out: list[list[int]] = [[] for _ in coded]
        for w, i in zip(hot.tolist(), (np.searchsorted(base, hot, "right") - 1).tolist(), strict=True):
            out[i].append(int((w - base[i]) * self.step))
        return out

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every item that scores at least threshold, with its score: document-at-a-time block-max WAND."""
        cursors = sorted(([self.ids[t][0], 0, t] for t in terms), key=lambda c: c[0])
        found, end, least = [], len(self.items), threshold - 1e-9

        def advance(c: list, target: int) -> None:
            own = self.ids[c[2]]
            c[1] = bisect_left(own, target, c[1])
            c[0] = own[c[1]] if c[1] < len(own) else end

        while True:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] == end:
                    break
                bound += self.top[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
            for c in cursors[: pivot + 1]:  # the blocks in which item would stand
                own = self.ids[c[2]]
                block = bisect_left(own, item, c[1]) // POSTING_BLOCK
                if block < len(self.block_max[c[2]]):
                    bound += self.block_max[c[2]][block]
                    last = own[min(len(own), (block + 1) * POSTING_BLOCK) - 1]
                    until = min(until, last + 1)
            if bound < least:
                for c in cursors[: pivot + 1]:
                    advance(c, max(item + 1, until))
            else:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    if c[0] < item:
                        advance(c, item)
                    if c[0] == item:
                        score += self.impacts[c[2]][c[1]]
                        advance(c, item + 1)
                if score >= least:
                    found.append((item, score))
            cursors.sort(key=lambda c: c[0])

    def search(self, texts: list[str | None], overlap: float = OVERLAP) -> list[dict[int | None, tuple[int, float, float, float]]]:
        """By text, item_id → (first word, score, question overlap, answer overlap) of the best passage."""
        split = [words(t) for t in texts]
        none = len(self.ids)
        coded = [np.fromiter(map(self.vocabulary.get, own, repeat(none)), np.int64, len(own)) for own in split]
        out = []
        for own, terms, starts in zip(split, coded, self.passages(coded), strict=True):
            best: dict = {}
            for a in starts:
                passage, there = terms[a : a + self.window], {}
                for item, score in self.wand(np.unique(passage[passage < none]).tolist(), self.threshold):
                    for n, _ in self.sides[item]:
                        there[n] = there[n] if n in there else grams(own[a : a + self.window], n)
                    shares = [len(side & there[n]) / len(side) for n, side in self.sides[item]]
                    if min(shares) >= overlap and min(1.0, score) > best.get(self.items[item], (0, 0.0))[1]:
                        best[self.items[item]] = (a, min(1.0, score), *shares)
            out.append(best)
        return out


class Indexes:
    """The indexes of a block of items, one for each class of length."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[bytes, int], n_items: int, average: float, threshold: float = THRESHOLD):
        classes: dict[int, list] = {}
        for item in items:
            classes.setdefault(length_class(len(words(item[1]))), []).append(item)
        self.own = [Index(classes[k], df, n_items, average, threshold) for k in sorted(classes)]

    def search(self, texts: list[str | None], overlap: float = OVERLAP) -> list[dict[int | None, tuple[int, float, float, float]]]:
        out: list[dict] = [{} for _ in texts]
        for index in self.own:
            for best, found in zip(out, index.search(texts, overlap), strict=True):
                for item, hit in found.items():
                    if hit[1] > best.get(item, (0, 0.0))[1]:
                        best[item] = hit
        return out


def indexes(items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> Iterator[Indexes]:
    """The items' indexes, block after block; each collects about block_bytes at most."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where(F.col("text").isNotNull()).distinct()

    @F.pandas_udf("array<binary>")
    def terms(texts):
        return texts.map(words)

    own = materialise(own.withColumn("words", terms("text")).where(F.size("words") > 0), "items")
    total = own.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.avg(F.size("words")).alias("average")).first()
    if not total["n"]:
        return
    blocks = math.ceil(total["bytes"] / block_bytes)
    if blocks > 1:  # so that each block is read alone
        own = own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        each = own.select("block", F.explode(F.array_distinct("words")).alias("word"))
        df = each.groupBy("word").agg(F.count("*").alias("count"), F.collect_set("block").alias("blocks"))
        df = materialise(df.select("word", "count", F.explode("blocks").alias("block")), "item-terms", by="block")
        own = materialise(own.select("item_id", "text", "block"), "item-blocks", by="block")
    else:
        own = own.withColumn("block", F.lit(0))
        df = own.select("block", F.explode(F.array_distinct("words")).alias("word")).groupBy("block", "word").count()
    for k in range(blocks):
        known = df.where(F.col("block") == k).select("word", "count").collect()
        block = own.where(F.col("block") == k).select("item_id", "text").collect()
        if block:
            yield Indexes(sorted(((r["item_id"], r["text"]) for r in block), key=lambda x: (x[0] is None, x)), {bytes(r["word"]): r["count"] for r in known}, total["n"], total["average"], threshold)


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, first_word, score and both overlaps."""
    schema = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
    fields = [(x.split()[0], pa.float64() if x.endswith("double") else pa.int64()) for x in schema.split(", ")]
    own, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []

    def over(index: Indexes):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc_id, item, *hit) for doc_id, hits in zip(batch.column("doc_id").to_pylist(), index.search(texts_of(batch.column("text")), overlap), strict=True) for item, hit in sorted(hits.items(), key=lambda x: (x[0] is None, x[0] or 0))]
                columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(columns, fields, strict=True)], [c for c, _ in fields])

        return own.mapInArrow(found, schema)

    for index in indexes(items, threshold, block_bytes):
        out.append(over(index))
    if not out:
        return docs.sparkSession.createDataFrame([], schema)
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs without those that hold a leaked item."""
    for index in indexes(items, threshold):

        @F.pandas_udf("boolean")
        def leaks(texts, index=index):
            return pd.Series(list(map(bool, index.search(list(texts), overlap))), dtype=bool)

        docs = docs.where(~leaks(docs["text"]))
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE_SQL: dict[str, str] = {}
