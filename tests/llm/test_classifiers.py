"""The classifiers, whole, against plain Python: sample, features, token labels, training, calibration, scores and offsets."""

import math
import random
import re
import struct
import zlib
from collections import defaultdict

import pytest
import xxhash

pytest.importorskip("codequarry.llm")

from codequarry.llm import _labelled, quality_classifier, toxicity  # noqa: E402
from tests.llm.test_brute import folded, ftrl  # noqa: E402

MASK = (1 << 64) - 1
GOOD, BAD = [f"fine{i}" for i in range(30)], [f"rudeness{i}" for i in range(12)]


def mixed(x):
    x &= MASK
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & MASK
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & MASK
    return x ^ x >> 33


def hashed(word):
    return mixed((zlib.crc32(word) << 32) | zlib.crc32(word[::-1], 0x5BD1E995))


def rows():
    r = random.Random(12)
    out = [(i, " ".join(r.choice(GOOD) for _ in range(r.randrange(3, 25))) + (f" {r.choice(BAD)} and {r.choice(BAD)}" if i % 3 == 0 else "")) for i in range(150)]
    return out + [(150, None), (151, ""), (152, "... !"), (153, " ".join(GOOD * 9)), (154, "RUDENESS3 Ünïcode rudeness4"), (3, "a second text of one id"), (None, f"no id {BAD[0]} {BAD[1]}"), (9, out[9][1])]


LABELS = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(140)] + [(150, 1, 0), (152, None, None), (153, 2, 0), (None, 1, 1), (3, 0, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id long, text string, label string").repartition(3)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def sampled(column, most=10**9, most_bytes=10**9):
    signed = lambda raw: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(raw, seed=42)))[0]
    known = [(i, x[column]) for i, *x in LABELS if i is not None and x[column] in (0, 1) and folded(i, 5)]
    known = sorted(known, key=lambda x: (signed(struct.pack("<q", x[0])), x))[:most]
    found = [(signed(struct.pack("<q", i)), signed((t or "").encode()), y, t or "") for j, t in rows() for i, y in known if i == j]
    out, size = [], 0
    for *_, y, t in sorted(found)[:most]:
        size += len(t.encode())
        if size > most_bytes:
            break
        out.append((t, y))
    return out


@pytest.mark.parametrize(("most", "most_bytes"), [(10**6, 10**9), (20, 10**9), (10**6, 900), (5, 0)])
def test_sample(tables, most, most_bytes):
    made = _labelled.sample(*tables, "quality", most, most_bytes)
    assert list(zip(made["text"], made["label"])) == sampled(0, most, most_bytes)


def shaped(word):
    return bytes(97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in word)


def buckets(text):
    out = []
    for salt, own in enumerate([[w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text) if w]] * 2):
        own = [hashed(shaped(w) if salt else w) for w in own]
        out += [mixed(h + salt + 1) >> 46 for h in own] + [mixed(a * 0x9E3779B97F4A7C15 + b + salt + 7) >> 46 for a, b in zip(own, own[1:])]
    return out


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def test_quality_classifier(tables):
    docs, labels = tables
    weights = quality_classifier.fit(docs, labels)
    bias, examples = 1 << 18, []
    for text, y in sampled(0):
        own, n = buckets(text), defaultdict(int)
        for b in own:
            n[b] += 1
        examples.append(({b: quality_classifier.SCALE * k / max(1, len(own)) for b, k in n.items()} | {bias: 1.0}, y))
    wanted = ftrl(examples * quality_classifier.EPOCHS, (1 << 18) + 1)
    assert weights.tolist() == pytest.approx(wanted, rel=1e-4, abs=1e-6)
    score = lambda t: sigmoid(weights[bias] + quality_classifier.SCALE * sum(weights[b] for b in buckets(t)) / max(1, len(buckets(t))))
    made = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in quality_classifier.score(docs, weights).collect())
    expected = sorted((i is None, i or 0, score(t or "")) for i, t in rows())
    assert [x[:2] for x in made] == [x[:2] for x in expected] and [x[2] for x in made] == pytest.approx([x[2] for x in expected], rel=1e-5)


def tokens(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text.lower())


def features(word):
    return [mixed(hashed(w.encode()) + k) for k, w in enumerate((word, word[:4], word[:5]))]


def chain(delta, pair):
    """Marginals of toxic and expected pairs of states, by forward and backward sums."""
    step = [[math.exp(x) for x in row] for row in pair]
    weight = [(1.0, math.exp(max(-30.0, min(30.0, d)))) for d in delta]
    ahead, behind = [list(weight[0])] if weight else [], [[1.0, 1.0]]
    for w in weight[1:]:
        a = [w[s] * sum(ahead[-1][q] * step[q][s] for q in (0, 1)) for s in (0, 1)]
        ahead.append([x / sum(a) for x in a])
    for w in weight[:0:-1]:
        b = [sum(step[s][q] * w[q] * behind[0][q] for q in (0, 1)) for s in (0, 1)]
        behind.insert(0, [x / sum(b) for x in b])
    p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, behind)]
    expected = [[0.0, 0.0], [0.0, 0.0]]
    for t in range(1, len(delta)):
        joint = [[ahead[t - 1][s] * step[s][q] * weight[t][q] * behind[t][q] for q in (0, 1)] for s in (0, 1)]
        total = sum(map(sum, joint))
        expected = [[expected[s][q] + joint[s][q] / total for q in (0, 1)] for s in (0, 1)]
    return p, expected


def evidence(p):
    none = min(sum(math.log1p(-min(x, 1 - 1e-12)) for x in p), -1e-9)
    return math.log(-math.expm1(none)) - none


class PlainField:
    def __init__(self, sample):
        t = toxicity
        self.word, self.before, self.after, self.bias, self.pair = defaultdict(float), defaultdict(float), defaultdict(float), 0.0, [[0.0, 0.0], [0.0, 0.0]]
        texts, toxic = [tokens(x) for x, _ in sample], [y for _, y in sample]
        seen = defaultdict(lambda: [0, 0])
        for own, y in zip(texts, toxic):
            for f in {(k, f) for w in own for k, f in enumerate(features(w))}:
                seen[f][y] += 1
        hot = {f for f, n in seen.items() if n[1] >= t.LEAST and n[1] / sum(toxic) >= t.RATIO * (n[0] + 0.5) / (len(toxic) - sum(toxic))}
        gold = [[y and any((k, f) in hot for k, f in enumerate(features(w))) for w in own] for own, y in zip(texts, toxic)]
        squares = defaultdict(lambda: 1e-8)
        for _ in range(t.STEPS):
            grads, pairs, bias = [defaultdict(float) for _ in range(3)], [[0.0, 0.0], [0.0, 0.0]], 0.0
            for own, g in zip(texts, gold):
                p, expected = chain(self.potentials(own), self.pair)
                for k in range(1, len(own)):
                    pairs[g[k - 1]][g[k]] += 1
                pairs = [[pairs[s][q] - expected[s][q] for q in (0, 1)] for s in (0, 1)]
                for k, w in enumerate(own):
                    off = g[k] - p[k]
                    bias += off
                    for f in features(w):
                        grads[0][f >> 46] += off
                    if k:
                        grads[1][features(own[k - 1])[0] >> 46] += off
                    if k + 1 < len(own):
                        grads[2][features(own[k + 1])[0] >> 46] += off
            for name, own, grad in zip("wba", (self.word, self.before, self.after), grads):
                for f in {*own, *grad}:
                    x = grad[f] - t.DECAY * own[f]
                    squares[name, f] += x * x
                    own[f] += t.RATE * x / math.sqrt(squares[name, f])
            squares["bias"] += bias * bias
            self.bias += t.RATE * bias / math.sqrt(squares["bias"])
            for s in (0, 1):
                for q in (0, 1):
                    squares[s, q] += pairs[s][q] ** 2
                    self.pair[s][q] += t.RATE * pairs[s][q] / math.sqrt(squares[s, q])
        x, (a, b) = [evidence(chain(self.potentials(own), self.pair)[0]) for own in texts], (0.0, 0.0)
        for _ in range(25):
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, a * e + b)))) for e in x]
            h = [q * (1 - q) for q in p]
            haa, hab, hbb = sum(k * e * e for k, e in zip(h, x)) + 1e-2, sum(k * e for k, e in zip(h, x)), sum(h) + 1e-2
            ga, gb = sum(e * (y - q) for e, y, q in zip(x, toxic, p)) - 1e-2 * a, sum(y - q for y, q in zip(toxic, p)) - 1e-2 * b
            det = haa * hbb - hab * hab
            a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
        self.slope, self.offset = a, b

    def potentials(self, own):
        at = [[f >> 46 for f in features(w)] for w in own]
        return [sum(self.word[f] for f in at[k]) + self.bias + (self.before[at[k - 1][0]] if k else 0) + (self.after[at[k + 1][0]] if k + 1 < len(own) else 0) for k in range(len(own))]

    def scored(self, text):
        p = chain(self.potentials(tokens(text)), self.pair)[0]
        spans = [f"{m.start()}:{m.end()}" for m, x in zip(re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", text), p) if x >= 0.5]
        return sigmoid(self.slope * evidence(p) + self.offset), ",".join(spans)


def test_toxicity(tables):
    docs, labels = tables
    model, plain = toxicity.fit(docs, labels), PlainField(sampled(1))
    assert model.pair.ravel().tolist() == pytest.approx([x for row in plain.pair for x in row], rel=1e-6, abs=1e-9) and model.bias == pytest.approx(plain.bias, rel=1e-6)
    for name in ("word", "before", "after"):
        own, wanted = getattr(model, name), getattr(plain, name)
        assert {int(k) for k in own.nonzero()[0]} == {k for k, v in wanted.items() if v}
        assert [own[k] for k in wanted] == pytest.approx(list(wanted.values()), rel=1e-5, abs=1e-8)
    assert (model.slope, model.offset) == pytest.approx((plain.slope, plain.offset), rel=1e-5)
    made = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["spans"], r["score"]) for r in toxicity.score(docs, model).collect())
    expected = sorted((i is None, i or 0, *plain.scored(t or "")[::-1]) for i, t in rows())
    assert [x[:3] for x in made] == [x[:3] for x in expected] and [x[3] for x in made] == pytest.approx([x[3] for x in expected], rel=1e-5)
    assert any(x[2] for x in made)
