"""Operator 1: quality rules by a hashed n-gram log-likelihood ratio. DataFrame functions only.

Uni- and bigrams of words are hashed into BUCKETS. Two multinomials over the buckets are compared:
one of a trusted target (labelled good documents), one of the whole raw corpus, smoothed by PRIOR
in the target and as much in proportion in the raw counts, so that n-grams of a few texts, labelled
or not, weigh little. A document's ratio is the mean over its n-grams of log p_target - log p_raw. Documents that
fail the base rules, or whose ratio is below THRESHOLD, are rejected.

Corpus counts take one pass in which every task sums its own buckets first, so at most BUCKETS rows
a task are shuffled; target counts take another, over a join of texts with all trusted ids in which
neither side is broadcast; scoring is a third pass without a shuffle. The weights are BUCKETS
doubles, whatever the corpus.

Nulls: null text has no words (base_failed). Rows with a null or repeated doc_id are judged like
any other, very long texts whole; equal rows get equal verdicts, and a ratio equal to THRESHOLD is kept; a text counts as trusted if any row of its id is labelled good. Extra columns are
ignored by measure() and kept by accept(), whatever their names. Without trusted documents all
ratios are 0 and only the base rules reject. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm._common import WHITE, documents

BUCKETS = 1 << 15
#: Pseudo-counts of every bucket.
PRIOR = 50.0
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.06
FEWEST_WORDS = 20
REPEATED_PERCENT = 30
RUN = 8


def bound(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def places(n: Column) -> Column:
    """0 .. n - 1, or no place."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def buckets(hashes: Column) -> Column:
    """Buckets of all uni- and bigrams of hashed words."""
    mask = F.lit(BUCKETS - 1).cast("long")
    ones = F.transform(hashes, lambda h: F.xxhash64(h).bitwiseAND(mask).cast("int"))
    twos = F.transform(places(F.size(hashes) - 1), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)).bitwiseAND(mask).cast("int"))
    return F.concat(ones, twos)


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a run of RUN words found twice or more; equal runs have equal hashes."""

    def covered(runs: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
            twice = F.filter(s, lambda e, k: F.coalesce(F.when(k > 0, same(e, k)).otherwise(F.get(s, k + 1)["h"] == e["h"]), F.lit(False)))
            return bound(
                F.array_sort(F.transform(twice, lambda e: e["i"])),
                lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(RUN), F.coalesce(F.get(p, k + 1) - x, F.lit(RUN)))), F.lit(0), lambda a, b: a + b),
            )

        keyed = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(bound(keyed, of_sorted))

    runs = F.transform(places(F.size(hashes) - (RUN - 1)), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(RUN))))
    return bound(runs, covered)


def hashed(own: Column) -> Column:
    return F.transform(own, lambda w: F.xxhash64(w))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def counted(texts: DataFrame) -> dict[int, int]:
    """Number of n-grams by bucket; BUCKETS rows at most reach the driver."""
    grams = texts.select(F.explode(bound(hashed(words(F.col("text"))), buckets)).alias("bucket"))
    return {r["bucket"]: r["n"] for r in grams.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def weights(docs: DataFrame, labels: DataFrame) -> Column:
    """The array of log p_target - log p_raw by bucket, to four places, as a constant."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    raw, target = counted(own), counted(own.join(trusted_ids(labels).hint("merge"), "doc_id", "left_semi"))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    share = n_target / n_raw if n_raw else 0.0
    ratio = lambda b: math.log((target.get(b, 0) + PRIOR) / (raw.get(b, 0) * share + PRIOR))
    return F.split(F.lit(",".join(f"{ratio(b):.4f}" for b in range(BUCKETS))), ",").cast("array<double>")


def measured(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> dict[str, Column]:
    """Columns over docs' text, by name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    model = weights(docs, labels)

    def of_hashes(h: Column) -> Column:
        total = bound(buckets(h), lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(model, b)) / F.greatest(F.size(g), F.lit(1)))
        return F.struct(repeated_words(h).cast("long").alias("repeated"), total.alias("ratio"))

    def of_lines(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": bound(lines, of_lines).cast("long"),
        "of_words": bound(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), bound(hashed(w), of_hashes).alias("h"))),
    }


def measure(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, ratio and verdict of every row."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for n, c in measured(docs, labels).items()))
    out = out.select("doc_id", F.col("of_words.n_words").alias("n_words"), F.col("of_words.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("of_words.h.repeated").alias("n_repeat_words"), F.col("of_words.h.ratio").alias("llr"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    own = measured(docs, labels)["of_words"]
    good = bound(own, lambda r: (r["n_words"] >= FEWEST_WORDS) & (100 * r["h"]["repeated"] <= REPEATED_PERCENT * r["n_words"]) & (r["h"]["ratio"] >= threshold))
    return docs.where(good)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL: dict[str, str] = {}
