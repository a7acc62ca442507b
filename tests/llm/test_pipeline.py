"""The pipeline's rows after each stage against plain Python."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

pytest.importorskip("codequarry.llm")

import corpus_pipeline  # noqa: E402
from codequarry.llm import near_dedup, packing, quality_rules  # noqa: E402
from codequarry.llm._tokenizer import encoder, tokenizer_path  # noqa: E402

ITEM = "which river flows past the old granite mill before it meets the northern estuary near the lighthouse? it is the long silver water of the quiet valley."
SECRET = "password=hunter22"


def tables():
    """docs (doc_id, text), good ids, bad ids."""
    rng = random.Random(7)
    fine = lambda n=200: [rng.choice([f"good{i}" for i in range(400)]) for _ in range(n)]
    docs = {i: " ".join(fine()) for i in range(30)}
    docs |= {i: " ".join(rng.choice([f"bad{i}" for i in range(10)]) for _ in range(150)) for i in range(30, 70)}
    docs[70], docs[71] = " ".join(fine(19)), " ".join([f"run{i}" for i in range(10)] * 4)
    for i in range(72, 76):  # near copies of the first documents, and one of a copy
        docs[i] = docs[i - 72 if i < 75 else 74].rsplit(" ", 1)[0] + f" changed{i}"
    docs[76] = docs[5]
    docs[77] = " ".join([*fine(80), ITEM, *fine(80)])
    docs[78] = " ".join([*fine(80), SECRET, *fine(80)])
    return docs, range(30), range(30, 70)


def accepted(docs, good):
    """Ids that pass the quality rules, n-grams counted without hashing."""
    own = {i: t.split() for i, t in docs.items()}
    grams = {i: [*w, *zip(w, w[1:])] for i, w in own.items()}
    raw, target = Counter(g for x in grams.values() for g in x), Counter(g for i in good for g in grams[i])
    share, prior, kept = target.total() / raw.total(), quality_rules.PRIOR, set()
    for i, w in own.items():
        llr = sum(math.log((target[g] + prior) / (raw[g] * share + prior)) for g in grams[i]) / len(grams[i])
        assert abs(llr - quality_rules.THRESHOLD) > 0.01, (i, llr)  # buckets that n-grams share can't decide
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        twice = {k + j for k, r in enumerate(runs) if Counter(runs)[r] > 1 for j in range(8)}
        if len(w) >= 20 and 100 * len(twice) <= 30 * len(w) and llr >= quality_rules.THRESHOLD:
            kept.add(i)
    return kept


def first_of_classes(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in docs.items() for w in [t.split()]}
    label = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if len(sets[a] & sets[b]) >= near_dedup.SIMILARITY * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return set(label.values())


def test_run_against_plain_python(spark, tmp_path, monkeypatch):
    docs, good, bad = tables()
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in good), 0) for i in [*good, *bad]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, write = {}, corpus_pipeline.materialise
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, tag: seen.setdefault(tag, write(df, tag)))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    after = [{r["doc_id"]: r["text"] for r in seen[f"stage-{name}"].collect()} for name, _ in corpus_pipeline.STAGES[:-1]]

    expected = {i: docs[i] for i in accepted(docs, good)}
    assert after[0] == expected and not set(expected) & {*bad, 70, 71}
    expected = {i: expected[i] for i in first_of_classes(expected)}
    assert after[1] == expected and not set(expected) & {72, 73, 74, 75, 76}
    expected = {i: t for i, t in expected.items() if ITEM not in t}
    assert after[2] == expected and 77 not in expected
    expected = {i: t.replace(SECRET, "[SECRET]") for i, t in expected.items()}
    assert after[3] == expected and "[SECRET]" in expected[78]
    lengths, filled = Counter(), Counter()
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]] += r["length"]
    ids = encoder(tokenizer_path()).encode(pa.array(expected.values()))
    assert lengths == {i: len(own) + 1 for i, own in zip(expected, ids, strict=True)}
    assert max(filled.values()) <= packing.CAPACITY


@pytest.mark.parametrize("n", [0, 9])
def test_stages_take_odd_rows(spark, tmp_path, n):
    """Nulls, empty and long texts, repeated rows, clashing columns; and no rows at all."""
    words = " ".join(f"good{i % 90}" for i in range(25_000))
    fine = " ".join(f"good{i}" for i in range(60))
    rows = [(None, fine + " tail", 1, "a", 2), (1, None, None, None, None), (2, "", 0, "b", 1), (3, fine, 5, "c", 1), (3, fine, 5, "c", 1), (4, fine, 6, "d", 1), (5, words, 7, "e", 1), (6, f"{fine} more {SECRET}", 8, "f", 1), (7, " \n\t ", 9, "g", 1)]
    docs = spark.createDataFrame(rows[:n], "doc_id long, text string, n_chars int, item_id string, length long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)] if n else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)] if n else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "n_chars", "item_id", "length"]
        if n and name == "near_dedup":
            kept = {r["doc_id"] for r in docs.collect()}
            assert 3 in kept and 4 not in kept and not kept & {1, 2, 7}
    assert bool(docs.count()) == bool(n)
