"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm._common import fold

FOLDS = 5
#: Bytes of texts that a classifier is fitted on, at most.
SAMPLE_BYTES = 64 << 20


def held_out(doc_id: str = "doc_id"):
    """True in fold 0, which labels are never learnt from; a null id is held out too."""
    return F.coalesce(fold(doc_id, FOLDS) == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """At most `most` rows (text, label) of the learning folds, the first by a hash of the id, and as many whole texts of these as add up to most_bytes.

    Sizes are looked at first, so that no text beyond the bound leaves its task."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumns({"order": F.xxhash64("doc_id"), "key": F.xxhash64("text")})
    sizes = own.select("order", "doc_id", "key", F.octet_length("text").alias("bytes")).join(F.broadcast(chosen), "doc_id")  # `most` small rows
    first = sizes.orderBy("order", "key", "label").limit(most).select("order", "key", "label", "bytes").toPandas()
    within = first[np.cumsum(first["bytes"].to_numpy()) <= most_bytes]
    if not len(within):
        return pd.DataFrame({"text": pd.Series(dtype=object), "label": pd.Series(dtype="int32")})
    wanted = docs.sparkSession.createDataFrame(within[["order", "key"]].drop_duplicates(), "order long, key long")
    texts = own.join(F.broadcast(wanted), ["order", "key"]).select("order", "key", "text").dropDuplicates(["order", "key"]).toPandas()
    return within.merge(texts, on=["order", "key"]).sort_values(["order", "key", "label"])[["text", "label"]].reset_index(drop=True)
