"""Operator 9: toxic spans by a linear-chain conditional random field.

Two states, plain and toxic. A token's potentials come from hashed features: the word, its first
four and five letters, the word before and the word after; state pairs have their own weights.
The corpus labels documents, so labelled tokens are made first, from the learning folds alone: in
a toxic document, a token is toxic if its word or beginning is many times as frequent in toxic
documents as in others. Gradients are feature counts less their forward-backward expectations.
A document's score is the calibrated chance that at least one of its tokens is toxic; tokens with
a marginal of a half or more are its offending spans. A text is one chain; it is laid out in rows of CHAIN
tokens, and messages pass from row to row by the rows' 2 x 2 products.

The model is fitted on at most SAMPLE labelled rows: calibration on all of their tokens, potentials on the rows of CHAIN tokens that
hold a toxic one, their neighbours, and about PLAIN_ROWS others, evenly spread. Very long texts are one chain like others; a score equal to CUT is predicted 1. Nulls: null text is the empty text, which
scores as a text without toxic tokens; without labels every score is the prior 0.5. Rows with a
null id are held out. Repeated rows are scored each. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm._common import Words, documents, mix, hash_bytes, texts_of
from codequarry.llm._labelled import held_out, sample

BITS = 18
CHAIN = 64
#: Rows that the model is fitted on, at most.
SAMPLE = 4_000
#: Rows of CHAIN tokens without toxic ones near that potentials are fitted on, about.
PLAIN_ROWS = 4_000
#: A feature marks a token if it is this many times as frequent in toxic documents, in so many at least.
RATIO, LEAST = 15.0, 4
STEPS, RATE, DECAY = 60, 0.5, 1e-4
CUT = 0.5
SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def tokens(texts: list[str]) -> Words:
    """Lower-cased runs of letters and digits of every text."""
    spaced = [t.lower().encode(errors="replace").translate(SPACED) for t in texts]
    return Words(pa.array(spaced, pa.large_binary()), lower=False)


def features(words: pa.Array) -> np.ndarray:
    """By distinct word, hashes of the word, of its first four letters and of its first five."""
    own = [w.decode(errors="replace") for w in words.to_pylist()]
    starts = [hash_bytes(pa.array([w[:k].encode() for w in own], pa.large_binary())) for k in (4, 5)]
    return np.stack([mix(h + np.uint64(k)) for k, h in enumerate((hash_bytes(words), *starts))])


@dataclass
class Model:
    word: np.ndarray  # of hashed words and beginnings: potential of toxic less plain
    before: np.ndarray
    after: np.ndarray
    bias: float
    pair: np.ndarray  # 2 x 2, from state to state
    slope: float
    offset: float


def grid(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of each token in a padded table, and by row whether it goes on with the row before."""
    lens = np.diff(bounds)
    rows = -(-lens // CHAIN)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lens)
    follows = np.ones(rows.sum(), bool)
    follows[(np.cumsum(rows) - rows)[rows > 0]] = False
    return np.repeat(np.cumsum(rows) - rows, lens) + place // CHAIN, place % CHAIN, follows


def messages(ratio: np.ndarray, there: np.ndarray, step: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of toxic that enters each row from the row before it, and from the row behind it."""
    n, width = ratio.shape
    ahead, behind = np.full(n, 0.5), np.full(n, 0.5)
    used = np.flatnonzero(follows | np.append(follows[1:], False))
    if not len(used):
        return ahead, behind
    at = np.zeros(n, np.int64)
    at[used] = np.arange(len(used))
    # by state before the row (plain, toxic, or no row): weights of its last token's two states
    r = ratio[used, 0]
    plain = np.stack([np.full(len(r), step[0, 0]), np.full(len(r), step[1, 0]), np.ones(len(r))])
    toxic = np.stack([r * step[0, 1], r * step[1, 1], r])
    for t in range(1, width):
        r, live = ratio[used, t], there[used, t]
        new_plain, new_toxic = plain * step[0, 0] + toxic * step[1, 0], r * (plain * step[0, 1] + toxic * step[1, 1])
        plain, toxic = np.where(live, new_plain, plain), np.where(live, new_toxic, toxic)
        both = plain + toxic
        total = np.stack([both[0] + both[1], both[0] + both[1], both[2]])
        plain, toxic = plain / total, toxic / total
    rows = np.arange(n)
    depth = rows - np.maximum.accumulate(np.where(follows, 0, rows))
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
    levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for d, own in enumerate(levels):
        k, a = at[own - 1], ahead[own - 1]
        x, y = (toxic[2, k], plain[2, k]) if d == 0 else ((1 - a) * toxic[0, k] + a * toxic[1, k], (1 - a) * plain[0, k] + a * plain[1, k])
        ahead[own] = x / (x + y)
    for own in reversed(levels):
        k, b = at[own], behind[own]
        x, y = plain[1, k] * (1 - b) + toxic[1, k] * b, plain[0, k] * (1 - b) + toxic[0, k] * b
        behind[own - 1] = x / (x + y)
    return ahead, behind


def marginals(delta: np.ndarray, there: np.ndarray, pair: np.ndarray, pairs: bool = False, follows: np.ndarray | None = None):
    """Chance of toxic for each place of each row, by forward-backward; also the expected number
    of each pair of states if asked for. delta: potential of toxic less plain; there: place is real;
    follows: the row's chain goes on from the row before (none does, if not given)."""
    n, width = delta.shape
    step, ratio = np.exp(pair), np.exp(np.clip(delta, -30, 30))
    follows = np.zeros(n, bool) if follows is None else follows
    ahead, behind = messages(ratio, there, step, follows)
    forward, a = np.empty((width, n)), ahead  # share of toxic
    for t in range(width):
        plain, toxic = (1 - a) * step[0, 0] + a * step[1, 0], ratio[:, t] * ((1 - a) * step[0, 1] + a * step[1, 1])
        if t == 0:
            plain, toxic = np.where(follows, plain, 1.0), np.where(follows, toxic, ratio[:, 0])
        a = np.where(there[:, t], toxic / (plain + toxic), a)
        forward[t] = a
    out, expected = np.empty((n, width)), np.zeros((2, 2))
    b = behind  # share of toxic in the backward vector
    for t in range(width - 1, -1, -1):
        toxic, plain = forward[t] * b, (1 - forward[t]) * (1 - b)
        out[:, t] = toxic / (toxic + plain)
        if pairs:
            live, last = (there[:, t], forward[t - 1]) if t else (follows, ahead)
            f0, f1, r, b1 = 1 - last[live], last[live], ratio[live, t], b[live]
            p = np.stack([f0 * step[0, 0] * (1 - b1), f0 * step[0, 1] * r * b1, f1 * step[1, 0] * (1 - b1), f1 * step[1, 1] * r * b1])
            expected += (p / p.sum(axis=0)).sum(axis=1).reshape(2, 2)
        up0 = step[0, 0] * (1 - b) + step[0, 1] * ratio[:, t] * b
        up1 = step[1, 0] * (1 - b) + step[1, 1] * ratio[:, t] * b
        b = np.where(there[:, t], up1 / (up0 + up1), b)
    return (out, expected) if pairs else out


def around(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words before and after each, one past the last code at a text's ends."""
    codes, text, none = words.codes, words.texts(), len(words.words)
    before, after = np.full(len(codes), none), np.full(len(codes), none)
    inner = np.flatnonzero(text[1:] == text[:-1]) + 1
    before[inner], after[inner - 1] = codes[inner - 1], codes[inner]
    return before, after


def potentials(model: Model, hashes: np.ndarray, codes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    own = model.word[at].sum(axis=0) + model.bias
    return own[codes] + np.append(model.before[at[0]], 0)[before] + np.append(model.after[at[0]], 0)[after]


def token_marginals(model: Model, words: Words) -> np.ndarray:
    if not len(words.codes):
        return np.zeros(0)
    row, column, follows = grid(words.bounds)
    delta = np.zeros((row[-1] + 1, CHAIN))
    there = np.zeros(delta.shape, bool)
    delta[row, column], there[row, column] = potentials(model, features(words.words), words.codes, *around(words)), True
    return marginals(delta, there, model.pair, follows=follows)[row, column]


def evidence(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """By text, the log odds that at least one token is toxic, were tokens independent."""
    none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    none = np.minimum(none[bounds[1:]] - none[bounds[:-1]], -1e-9)
    return np.log(-np.expm1(none)) - none


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    rows = sample(docs, labels, label, most)
    size = 1 << BITS
    model = Model(np.zeros(size), np.zeros(size), np.zeros(size), 0.0, np.zeros((2, 2)), 0.0, 0.0)
    toxic = rows["label"].to_numpy().astype(bool)
    if not len(rows) or not toxic.any() or toxic.all():
        return model
    words = tokens(rows["text"].tolist())
    hashes, text = features(words.words), words.texts()
    marked = np.zeros(len(words.words), bool)
    for h in hashes:  # documents of either kind that hold a feature
        seen = np.unique(np.stack([text, np.unique(h, return_inverse=True)[1][words.codes]]), axis=1)
        n = [np.bincount(seen[1][toxic[seen[0]] == k], minlength=len(h)) for k in (False, True)]
        hot = (n[1] >= LEAST) & (n[1] / toxic.sum() >= RATIO * (n[0] + 0.5) / (~toxic).sum())
        marked |= hot[np.unique(h, return_inverse=True)[1]]
    gold = marked[words.codes] & toxic[text]
    row, column, follows = grid(words.bounds)
    # rows with a toxic token, their neighbours in the text, and as bounded a number of others
    toxic_rows = np.zeros(row[-1] + 1, bool)
    toxic_rows[row[gold]] = True
    hit = toxic_rows.copy()
    hit[1:] |= toxic_rows[:-1] & follows[1:]
    hit[:-1] |= toxic_rows[1:] & follows[1:]
    plain = np.flatnonzero(~hit)
    hit[plain[:: max(1, len(plain) // PLAIN_ROWS)]] = True
    use = hit[row]
    follows = (follows & np.append(False, hit[:-1]))[hit]
    before, after = (x[use] for x in around(words))
    row, column, codes, gold = np.unique(row[use], return_inverse=True)[1], column[use], words.codes[use], gold[use].astype(float)
    at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    lost = np.append(at[0], size)
    there = np.zeros((row[-1] + 1, CHAIN), bool)
    there[row, column] = True
    state = np.zeros(there.shape, int)
    state[row, column] = gold.astype(int)
    inner = there[:, 1:]
    joins = np.flatnonzero(follows)
    seen_pairs = np.append((2 * state[:, :-1] + state[:, 1:])[inner], 2 * state[joins - 1, -1] + state[joins, 0])
    seen_pairs = np.bincount(seen_pairs, minlength=4).reshape(2, 2)
    squares = [np.full(size, 1e-8), np.full(size, 1e-8), np.full(size, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(STEPS):
        delta = np.zeros(there.shape)
        delta[row, column] = potentials(model, hashes, codes, before, after)
        p, expected = marginals(delta, there, model.pair, pairs=True, follows=follows)
        off = gold - p[row, column]
        by_word = np.bincount(codes, off, at.shape[1])
        grads = [
            sum(np.bincount(a, by_word, size) for a in at) - DECAY * model.word,
            np.bincount(lost[before], off, size + 1)[:size] - DECAY * model.before,
            np.bincount(lost[after], off, size + 1)[:size] - DECAY * model.after,
            off.sum(),
            seen_pairs - expected,
        ]
        for k, (name, g) in enumerate(zip(("word", "before", "after", "bias", "pair"), grads, strict=True)):
            squares[k] = squares[k] + g * g
            setattr(model, name, getattr(model, name) + RATE * g / np.sqrt(squares[k]))
    # calibration of the documents' evidence, by Newton steps
    x = np.stack([evidence(token_marginals(model, words), words.bounds), np.ones(len(rows))])
    fitted = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(fitted @ x, -30, 30)))
        fitted = fitted + np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-2 * np.eye(2), x @ (toxic - p) - 1e-2 * fitted)
    model.slope, model.offset = map(float, fitted)
    return model


def offsets(text: str, bad: np.ndarray) -> str:
    """start:end of each offending token, in code points."""
    return ",".join(f"{m.start()}:{m.end()}" for m, b in zip(TOKEN.finditer(text), bad, strict=False) if b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and offending spans of every row; no shuffle."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                texts = texts_of(some.column("text"))
                words = tokens(texts)
                p = token_marginals(model, words)
                z = model.slope * evidence(p, words.bounds) + model.offset
                bad = p >= 0.5 if model.slope else p > 1
                any_bad = np.add.reduceat(np.append(bad, 0), words.bounds[:-1]) * (np.diff(words.bounds) > 0)
                spans = [offsets(t, bad[words.bounds[i] : words.bounds[i + 1]]) if any_bad[i] else "" for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35)))), pa.array(spans, pa.string())], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double, spans string")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "spans")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
