"""Nearest neighbours, ranked search and importance resampling against plain Python versions of their contracts, over odd texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("codequarry.llm")

from codequarry.llm import lexical_search, nearest, resampling  # noqa: E402
from tests.llm.test_brute import ROWS  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = np.random.default_rng(3)
MORE = [(200 + i, " ".join(RNG.choice([f"word{j}" for j in range(30)], n))) for i, n in enumerate([19, 20, 21, 60, 60, 300])]
LONG = "é" * 40 + "x" * 200
DOCS = [*ROWS, *MORE, (300, "same words in one text"), (290, "same words in one text"), (None, "same words in one text"), (310, f"{LONG} word1 {LONG}"), (311, "Ünïcode joined WORD1"), (312, "word1 " * 30_000)]
ITEMS = [(1, "word1 word2 word2 word40"), (2, None), (3, "nothing of this stands anywhere zzz"), (None, "same words"), (5, "same words"), (6, "  ... "), (1, "Word1"), (7, f"one {LONG} line"), (7, f"one {LONG} line")]


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "x", 1) for i, t in DOCS], "doc_id long, text string, query int, places string, score long")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, rank int")


def ranking(docs, items, top):
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, all_terms = sum(n > 0 for *_, n in own), sum(n for *_, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc, c, n in own:
            score = 0
            for w in terms(text):
                if w in c:
                    m = 100 - 75 + 75 * n * n_docs // all_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "block_bytes", "shard"), [(10, 8 << 20, 10_000), (3, 100, 7), (200, 8 << 20, 1)])
def test_search_equals_scores_of_all_documents(docs, items, top, block_bytes, shard):
    made = lexical_search.search(docs.repartition(3), items, top, block_bytes, shard)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, made.collect()), key=str) == ranking(DOCS, ITEMS, top)


def test_search_of_nothing(spark, docs, items):
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []


def test_best_keeps_the_least_of_equal_scores():
    scores, order = RNG.integers(0, 4, 300), RNG.permutation(300)
    for k in (1, 5, 299, 400):
        wanted = sorted((i for i in range(300) if scores[i]), key=lambda i: (-scores[i], order[i]))[:k]
        assert lexical_search.best(scores, order, k).tolist() == wanted


def buckets(text):
    own = terms(text)
    return Counter(zlib.crc32(" ".join(own[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(own) - k + 1))


def drawn(docs, target, percent):
    raw, wanted = sum(map(buckets, (t for _, t in docs)), Counter()), sum(map(buckets, (t for _, t in target)), Counter())
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    rows = []
    for i, t in docs:
        own = buckets(t)
        weight = sum(n * math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((raw[b] + 1) * (t_all + 10_000)))) for b, n in own.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, sum(own.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(terms(t))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("percent", "range_scores"), [(5, 200_000), (40, 3), (100, 5), (0, 5)])
def test_resampling_equals_a_plain_draw(docs, items, percent, range_scores):
    made = resampling.resample(docs.repartition(3), items, percent, range_scores=range_scores)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, made.collect()), key=str) == drawn(DOCS, ITEMS, percent)


def test_resampling_ranks_ties_by_id(spark):
    """Rows of one id have one score; others that tie are ranked by id."""
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(i % 30, text) for i in range(90)]
    made = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"), 50)
    assert sorted(map(tuple, made.collect()), key=str) == drawn(rows, [], 50)


def test_resampling_of_nothing(spark, docs, items):
    assert resampling.resample(docs.limit(0), items).collect() == []
    assert resampling.resample(docs, items.limit(0)).count() == len(DOCS)


def test_crc32_of_joined_strings():
    parts = [bytes(RNG.integers(0, 256, n, dtype=np.uint8)) for n in (1, 2, 31, 32, 33, 500)]
    for a in parts:
        for b in parts:
            made = resampling.longer(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
            assert made[0] == zlib.crc32(a + b)


def cosines(rows, k=5):
    """Of every query (id divisible by 50), by brute force in double precision: (score, id) of every other row, best first."""
    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: sum(x / math.hypot(*a) * y / math.hypot(*b) for x, y in zip(a, b))
    return {(i, v): sorted((-round(cos(v, w), 9), j) for j, w in good if j != i and len(w) == len(v))[:k] for i, v in good if i % 50 == 0}


ODD = [
    (0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (3, [2.0, 0.0, 4.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]),
    (None, [1.0, 0.0, 2.0]), (50, [0.0, 1.0, 0.0]), (50, [0.0, 3.0, 1.0]), (100, [1.0, 1.0]), (11, [1.0, 2.0]), (150, [5.0]), (200, [1e-200, 0.0, 0.0]), (250, [1e200, 2e200, 1e200]), (300, [float("nan"), 1.0, 1.0]), *((400 + i, [1.0, 0.0, 2.0]) for i in range(60)),
]


def test_nearest_of_odd_vectors(spark):
    """Few vectors are compared all: results are exact."""
    rows = spark.createDataFrame([(i, v, "x", 1) for i, v in ODD], "vec_id long, embedding array<double>, ids string, dim int").repartition(3)
    for shard in (8_192, 4):
        found = nearest.search(rows, rows.where("vec_id % 50 = 0"), shard=shard, block=2)
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        made = [(r.query_id, r.rank, r.vec_id, -round(r.score, 9)) for r in found.collect()]
        wanted = [(i, n, j, s) for (i, _), own in cosines(ODD).items() for n, (s, j) in enumerate(own, 1)]
        assert sorted(made) == sorted(wanted)


def test_nearest_of_nothing(spark):
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.search(rows, rows).collect() == []


def test_nearest_recall(spark):
    """Of clustered vectors, a third of them equal, in shards of some thousand: at least 0.9, and exact scores."""
    centres = RNG.normal(size=(40, 16))
    vectors = (centres[RNG.integers(0, 40, 6_000)] + 0.4 * RNG.normal(size=(6_000, 16))).astype(np.float32)
    vectors[::3] = vectors[0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>")
    made = {}
    for r in nearest.search(rows, rows.where("vec_id % 50 = 0"), shard=2_500, block=64).collect():
        made.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    exact = vectors.astype(float)
    exact /= np.linalg.norm(exact, axis=1)[:, None]
    hits = 0
    assert sorted(made) == list(range(0, 6_000, 50))
    for q, found in made.items():
        own = exact @ exact[q]
        own[q] = -2
        wanted = np.lexsort((np.arange(6_000), -np.round(own, 12)))[:5].tolist()
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(own[i] - s) < 1e-12 for i, s in found.values())
        hits += len({i for i, _ in found.values()} & set(wanted))
    assert hits >= 0.9 * 5 * len(made)


def test_graph_finds_near_nodes():
    units = nearest.units_of(RNG.normal(size=(3_000, 24)))
    level = np.sort(np.floor(-np.log(RNG.random(3_000)) / np.log(16)).astype(int))[::-1]
    graph = nearest.Graph.built(units, nearest.layer_sizes(level))
    assert [x.shape[1] for x in graph.links][:2] == [32, 16]
    assert all((x < len(x)).all() for x in graph.links)
    queries = units[RNG.integers(0, 3_000, 200)]
    truth = np.argsort(-(queries @ units.T), axis=1)[:, :5]
    found = graph.search(queries)
    assert np.mean([len(set(a) & set(b[:5])) / 5 for a, b in zip(truth.tolist(), found.tolist())]) >= 0.95
