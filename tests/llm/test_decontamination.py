"""search() against brute force over every passage and item."""

import math
import random
import re
import time
from collections import Counter

import pytest

pytest.importorskip("codequarry.llm")

from codequarry.llm import decontamination as d  # noqa: E402


def split(text):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", text.lower()).split()


def sides(text):
    parts = [split(x) for x in re.split(r"(?<=[.?!])\s+|\n+", text) if split(x)]
    question, answer = sum(parts[:-1], []), parts[-1]
    return (question, answer) if question and max(len(question), len(answer)) >= 3 else (split(text), split(text))


def share(side, passage):
    n = min(3, len(side))
    runs = lambda x: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
    return len(runs(side) & runs(passage)) / len(runs(side))


def brute(docs, items):
    """(doc place, item_id) of every leak."""
    own = {i: split(t) for i, t in items if t and split(t)}
    n, average = len(own), sum(map(len, own.values())) / len(own)
    df = Counter(w for x in own.values() for w in set(x))
    found = set()
    for item, text in items:
        if item not in own:
            continue
        tf, size = Counter(own[item]), 64
        while size < len(own[item]):
            size *= 2
        norm = d.K1 * (1 - d.B + d.B * len(own[item]) / average)
        impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * k * (d.K1 + 1) / (k + norm) for w, k in tf.items()}
        for place, doc in enumerate(docs):
            words = split(doc or "")
            for at in range(0, max(1, len(words)), size + 1):
                passage = words[at : at + 2 * size]
                score = sum(v for w, v in impact.items() if w in set(passage)) / sum(impact.values())
                if score >= d.THRESHOLD - 1e-9 and min(share(s, passage) for s in sides(text)) >= d.OVERLAP:
                    found.add((place, item))
    return found


def tables():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    run = lambda n: " ".join(word() for _ in range(n))
    answers = ["Paris.", "two words.", run(3) + ".", run(9) + ".", run(30) + "."]
    items = [(k, f"{run(6 + 3 * k)}? {answers[k % 5]}") for k in range(25)]
    items += [(30, "Yes? No."), (31, "lone"), (32, "Why? " + run(8) + "."), (33, run(150) + ". " + run(90)), (34, None), (35, "..."), (36, "one line of " + run(10))]
    docs = [None, "", "?", "Yes no", "lone", run(3000), run(20)]
    for _, text in items:
        if text:
            docs += [text, f"{run(100)} {text} {run(100)}", f"{run(60)} {text.rsplit(' ', 1)[0]}"]
            own = text.split()
            own[len(own) // 2] = "changed"
            docs.append(f"{run(30)} {' '.join(own)} {run(300)}")
    return docs, items


@pytest.mark.parametrize("block_bytes", [200, 8 << 20])
def test_search_against_brute_force(spark, block_bytes):
    docs, items = tables()
    expected = brute(docs, items)
    left = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    right = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    if block_bytes == 200:  # a few items in each of many blocks
        right, expected = right.where("item_id < 5 OR item_id > 30"), None
        expected = brute(docs, [x for x in items if x[0] < 5 or x[0] > 30])
    rows = d.search(left, right, block_bytes=block_bytes).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == expected and len(rows) == len(expected)
    whole = [i for i, t in items if t and split(t)]
    if block_bytes > 200:
        assert all(any((k, i) in expected for k, t in enumerate(docs) if t == dict(items)[i]) for i in whole)
        kept = d.clean(left, right)
        assert kept.columns == left.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {k for k, _ in expected}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.search(docs.limit(0), items).count() == 0 == d.search(docs, items.limit(0)).count()
    assert d.clean(docs, items.limit(0)).count() == 1


@pytest.mark.parametrize("block_bytes", [20, 8 << 20])
def test_items_without_an_id(spark, block_bytes):
    text = "which river flows past the old granite mill? it is the long silver water."
    docs = spark.createDataFrame([(1, text), (2, "nothing of the kind stands here"), (None, text + " and more")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (None, text), (7, "some other question of many words? with its own answer."), (None, None)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in d.search(docs, items, block_bytes=block_bytes).collect()) == [(0, None), (1, None)]
    assert [r["doc_id"] for r in d.clean(docs, items).collect()] == [2]


def test_long_items_in_linear_time():
    words = [f"w{i}" for i in range(100_000)]
    began = time.process_time()
    index = d.Index([(1, " ".join(words))], dict.fromkeys((w.encode() for w in words), 1), 1, len(words))
    assert time.process_time() - began < 10 and len(index.ids) == 100_000  # a second; counting each word anew takes minutes
