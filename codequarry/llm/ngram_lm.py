"""Operator 2: a Katz backoff language model over words, learnt from and applied to whole corpora.

With h' for h without its first word, P(w | h) is d(c) * c(h, w) / c(h) where the gram was seen, else a(h) * P(w | h'), down to single words,
which back off to one class of unknown words. d(r) are Good-Turing discounts for counts up to CUTOFF, by order, and a(h)
is what makes all words' probabilities sum to exactly 1. A history whose grams were all seen too
often to be discounted counts one time more. Histories are words, or one start before each text's first.

Nothing is exploded into a row per token. Texts are cut into chunks of some thousand; a chunk asks
once for each of its distinct words, then for each of its distinct grams of two words, of three and so on, in blocks of packed
arrays. Blocks are dealt by word, then by history, to buckets, which sum the training counts of
all chunks and answer each chunk in its own order. What a history gives away rests on the counts of the order
below, which the chunks send along. Histories that make up more than 1 / HOT of the
corpus (at most HOT of them) are dealt by gram instead, and their sums are put together from the
buckets' partial sums. Buckets grow in number, not in size, with the corpus. Chunks' tokens stay in
a table bucketed by chunk, which is read once an order and never shuffled.

Nulls: null text is the empty text (one end token). A null doc_id is not held out. Repeated ids and
rows are learnt and scored each; very long texts make chunks of their own. Without training tokens every token is unknown, at probability 1.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm._common import Words, bucketed, discard, documents, fold, materialise, mix

FOLDS, HELD_OUT = 7, 2
#: Words of the longest grams, unless a caller asks for more.
ORDER = 3
CUTOFF = 5
#: Texts and about bytes of text in a chunk.
CHUNK, CHUNK_BYTES = 2_000, 4 << 20
#: Entries that a bucket gets from all chunks, about.
BUCKET_ENTRIES = 1_000_000
HOT = 1_000
END_HASH = np.uint64(0)
START = np.uint64(1 << 62)
#: Bits of a word's id beside the number of its history in a bucket.
WORD_BITS = np.uint64(40)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
HALF, LOW = np.uint64(32), np.uint64((1 << 32) - 1)
#: Words' ids from here on are hashed in codes of two words; smaller ids make codes below this bit.
HASHED = np.uint64(1 << 63)


def packed(values: np.ndarray, delta: bool = False, upper: bool = False) -> bytes:
    """An array as bytes: of neighbours' differences (or those of their upper 32 bits) if asked for, byte planes apart, compressed."""
    values = np.ascontiguousarray(values)
    if upper and len(values):
        values = (np.diff(values >> HALF, prepend=np.uint64(0)) << HALF) | (values & LOW)
    elif delta and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    if values.dtype == np.uint64 and len(values) and values.max() <= LOW:
        values = values.astype(np.uint32)
    return values.dtype.str.encode() + pa.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), codec="zstd", asbytes=True) + len(values).to_bytes(4, "little") if len(values) else b""


def unpacked(blob: bytes, kind: type, delta: bool = False, upper: bool = False) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    n, sent = int.from_bytes(blob[-4:], "little"), np.dtype(blob[:3].decode())
    planes = np.frombuffer(pa.decompress(blob[3:-4], n * sent.itemsize, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(sent.itemsize, n).T).view(sent).ravel().astype(kind, copy=False)
    if upper:
        return (np.cumsum(values >> HALF, dtype=kind) << HALF) | (values & LOW)
    return np.cumsum(values, dtype=kind) if delta else values


def discounts(n: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    """d(0..cutoff + 1) by Good-Turing (Katz), from n[r], how many have count r; d of all larger counts is the last.

    Where the counts of counts give no discount in (0, 1), 1 - 1 / (2 r) stands in."""
    d = np.ones(cutoff + 2)
    common = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    for r in range(1, cutoff + 1):
        made = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = made if 0 < made < 1 else 1 - 0.5 / r
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, CUTOFF + 1)] * counts


def chunks(docs: DataFrame, n_buckets: int) -> DataFrame:
    """chunk, doc_ids, held (bytes), lens, tokens (places in the chunk's words by hash), words (hashes), counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(batch.column("size").to_numpy())
            at = 0
            while at < batch.num_rows:
                end = min(at + CHUNK, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES))), batch.num_rows)
                some = batch.slice(at, end - at)
                at = end
                words = Words(some.column("text"))
                held = some.column("held").to_numpy(zero_copy_only=False).astype(np.uint8)
                hashes = np.append(words.hashes() if len(words.words) else np.zeros(0, np.uint64), END_HASH)
                order = np.argsort(hashes)
                lens = np.diff(words.bounds) + 1
                tokens = np.insert(words.codes.astype(np.int64), words.bounds[1:], len(hashes) - 1)
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order))
                tokens = rank[tokens]
                counts = np.bincount(tokens[np.repeat(held == 0, lens)], minlength=len(hashes)).astype(np.uint32)
                row = {"chunk": number, "doc_ids": some.column("doc_id").to_pylist(), "held": held.tobytes(), "lens": packed(lens.astype(np.uint32)), "tokens": packed(tokens), "words": packed(hashes[order], True), "counts": packed(counts), "n_words": len(hashes)}
                number += 1
                yield pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("held", "lens", "tokens", "words", "counts")), ("n_words", pa.int64())]))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held"))
    cut_up = own.withColumn("size", F.octet_length("text")).mapInArrow(cut, "chunk long, doc_ids array<long>, held binary, lens binary, tokens binary, words binary, counts binary, n_words long")
    return bucketed(cut_up, "lm_chunks", "chunk", n_buckets)


def sliced(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of values by bucket, in order; empty buckets are passed over."""
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by radix
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = heads_of(bucket)
    for b, x, y in zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield b, order[x:y]


def word_bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes + GOLDEN) % np.uint64(n)).astype(np.int64)


def vocabulary(table: DataFrame, n: int) -> DataFrame:
    """Answers to chunks' words, by bucket: each word's id and training count; and stats: how many
    words were seen r times (r = 1 .. CUTOFF + 1), words seen, tokens, count of the end."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts")), strict=True):
                words, counts = unpacked(words, np.uint64, True), unpacked(counts, np.uint32)
                rows = [(b, chunk, packed(words[at], True), packed(counts[at])) for b, at in sliced(word_bucket(words, n))]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "words", "counts"])

    def answered(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = np.uint64(key[0].as_py())
        words = [unpacked(x, np.uint64, True) for x in rows["words"].to_pylist()]
        every, back = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(back, np.concatenate([unpacked(x, np.uint32) for x in rows["counts"].to_pylist()]), len(every)).astype(np.uint64)
        ids = np.empty(len(every), np.uint64)
        ids[np.lexsort((every, np.iinfo(np.int64).max - counts.astype(np.int64)))] = np.arange(len(every), dtype=np.uint64) * np.uint64(n) + bucket
        stats = [*np.bincount(np.minimum(counts, CUTOFF + 2).astype(int), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist(), int((counts > 0).sum()), int(counts.sum()), int(counts[every == END_HASH].sum())]
        cuts = np.cumsum([0, *map(len, words)])
        out = [{"chunk": c, "bucket": int(bucket), "ids": packed(ids[back[a:b]]), "counts": packed(counts[back[a:b]]), "stats": None} for c, a, b in zip(rows["chunk"].to_pylist(), cuts[:-1], cuts[1:], strict=True)]
        out.append({"chunk": None, "bucket": int(bucket), "ids": None, "counts": None, "stats": stats})
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))]))

    requests = table.select("chunk", "words", "counts").mapInArrow(asked, "bucket int, chunk long, words binary, counts binary")
    return materialise(requests.groupBy("bucket").applyInArrow(answered, "chunk long, bucket int, ids binary, counts binary, stats array<long>"), "lm-words", cleanup=True)


def heads_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)


def two_words(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Codes of grams of two words: both ids side by side, the second above, or a hash with the top bit where they are too large."""
    codes = (second << HALF) | first
    large = np.flatnonzero((second >= HASHED >> HALF) | (first > LOW))
    with np.errstate(over="ignore"):
        codes[large] = mix(mix(first[large]) * GOLDEN + second[large]) | HASHED
    return codes


class Grams:
    """A chunk's distinct grams of one order, in order of history and word, with what is known of them.

    back: for each token, the gram that ends there, or -1 where a text has too few words before it;
    lower: the gram of the order below without the first word; hashes: of grams, as histories of the
    order above; whole, count: of a gram's history and of the gram itself, in training.
    """

    def __init__(self, hashes, count, back, word=None):
        self.hashes, self.count, self.back, self.word = hashes, count, back, word

    @classmethod
    def words(cls, row: dict, known: dict) -> tuple[Grams, np.ndarray]:
        """The words of a chunk (a row with its answers), and the lengths of its texts; the start is the last word."""
        lens, tokens = unpacked(row["lens"], np.uint32).astype(np.int64), unpacked(row["tokens"], np.uint32)
        words = unpacked(row["words"], np.uint64, True)
        ids, counts = np.empty(len(words), np.uint64), np.empty(len(words), np.int64)
        answers = {x["bucket"]: x for x in row["answers1"]}
        for b, at in sliced(word_bucket(words, known["n_words"])):
            ids[at], counts[at] = unpacked(answers[b]["ids"], np.uint64), unpacked(answers[b]["counts"], np.uint64).astype(np.int64)
        end = int(counts[words == END_HASH][0])
        order = np.argsort(ids)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own = cls(np.append(ids[order], START), np.append(counts[order], end), rank[tokens], np.arange(len(order) + 1))  # the start is seen once a text
        d, n = known["d"][1], own.count
        own.chance = np.where(n > 0, discounted(n, d) / known["whole"], known["unknown"])
        own.after = np.full(len(n), known["whole"])  # by word, what its count is divided by
        own.seen = own.count[:-1]
        return own, lens

    def longer(self, words: Grams, lens: np.ndarray, last: bool = False) -> Grams:
        """The distinct grams of one word more; the last ones need no hashes."""
        first = np.cumsum(lens) - lens
        before = np.roll(self.back, 1)
        before[first] = len(words.hashes) - 1 if self is words else -1  # the start, which is no history of two words
        at = np.flatnonzero(before >= 0)
        size = len(words.hashes)
        if self is words:
            keys = before[at] * size + words.back[at]
        else:  # histories in order of their codes, by which those of two words are sent in fewer bytes
            by_code = np.argsort(self.hashes)
            rank = np.empty(len(by_code), np.int64)
            rank[by_code] = np.arange(len(by_code))
            keys = rank[before[at]] * size + words.back[at]
        order = np.argsort(keys)
        keys = keys[order]
        heads = heads_of(keys)
        back = np.full(len(before), -1)
        back[at[order]] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
        keys, places = keys[heads], at[order[heads]]
        history = keys // size
        word = keys - history * size
        if self is not words:
            history = by_code[history]
        of_history, hashes = self.hashes[history], None
        if not last and self is words:
            hashes = two_words(of_history, words.hashes[word])
        elif not last:
            with np.errstate(over="ignore"):
                hashes = mix(mix(of_history) * GOLDEN + words.hashes[word])
        own = Grams(hashes, np.zeros(len(keys), np.int64), back, word)
        own.history, own.lower = history, self.back[places]
        own.whole, own.of_history = self.count[history], of_history
        own.lower_count, own.lower_whole = self.count[own.lower], self.after[own.lower]
        return own

    def dealt(self, n: int, hot: int, words: Grams) -> np.ndarray:
        """The bucket of each gram: that of its history, or its own if the history is hot."""
        self.hot = self.whole >= hot
        own, at = mix(self.of_history), np.flatnonzero(self.hot)
        with np.errstate(over="ignore"):
            own[at] = mix(own[at] * GOLDEN + words.hashes[self.word[at]])
        return (own % np.uint64(n)).astype(np.int64)

    def answer(self, answers: list[dict], k: int, known: dict, words: Grams, lower: Grams, chances: bool = True) -> None:
        """Take what the buckets say: counts, what they are divided by, and the chance of each gram (the order above asks without)."""
        d, by = known["d"][k], {x["bucket"]: x for x in answers}
        full, alpha = np.zeros(len(self.count), bool), np.ones(len(self.count))
        for b, at in sliced(self.dealt(known["n"][k], known["hot"], words)):
            x = by[b]
            counts = unpacked(x["counts"], np.uint32)
            self.count[at] = counts
            heads = heads_of(self.history[at])
            sizes = np.diff(np.append(heads, len(at)))
            full[at] = np.repeat(unpacked(x["full"], np.uint8), sizes)
            if not chances:
                continue
            new = np.logical_or.reduceat(counts == 0, heads)
            if not new.any():
                continue
            made = np.ones(len(heads))
            made[new] = backoff(unpacked(x["small"], np.uint32).reshape(CUTOFF, -1).T, unpacked(x["large"], np.uint64).astype(np.int64), unpacked(x["share"], np.float64), self.whole[at[heads]][new], d)
            alpha[at] = np.repeat(made, sizes)
        for history in np.unique(self.of_history[self.hot]):
            small, large, share = known["histories"][k][int(history.view(np.int64))]
            at = np.flatnonzero(self.of_history == history)
            full[at] = small.sum() == 0
            alpha[at] = backoff(small[None, :], np.array([large]), np.array([share]), self.whole[at[:1]], d)[0]
        self.after = (self.whole + full).astype(np.float64)
        self.chance = chances and np.where(self.count > 0, discounted(self.count, d) / np.maximum(self.after, 1), alpha * lower.chance[self.lower])


def asked_of(row: dict, order: int, known: dict) -> tuple[Grams, Grams, np.ndarray]:
    """A chunk's words, its grams of an order (not yet answered) and its texts' lengths."""
    words, lens = Grams.words(row, known)
    own = words
    for k in range(2, order):
        above = own.longer(words, lens)
        above.answer(row[f"answers{k}"], k, known, words, own, chances=False)
        own = above
    return words, own.longer(words, lens, last=True), lens


REQUEST = ["bucket", "chunk", "histories", "sizes", "words", "lower", "wholes", "counts", "hot"]
HOT_TYPE = pa.struct([("history", pa.int64()), ("small", pa.list_(pa.int64())), ("large", pa.int64()), ("share", pa.float64())])
ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("counts", "full", "small", "large", "share")), ("stats", pa.list_(pa.int64())), ("hot", pa.list_(HOT_TYPE))])
ANSWER_SQL = "chunk long, bucket int, counts binary, full binary, small binary, large binary, share binary, stats array<long>, hot array<struct<history:long,small:array<long>,large:long,share:double>>"


def gram_answers(joined: DataFrame, k: int, known: dict) -> DataFrame:
    """Answers to chunks' grams of k words, by bucket."""
    n, d_lower = known["n"][k], known["d"][k - 1]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(batch.num_rows):
                row = batch.slice(at_row, 1).to_pylist()[0]
                words, p, lens = asked_of(row, k, known)
                held = np.repeat(np.frombuffer(row["held"], np.uint8), lens)
                train = np.bincount(p.back[(held == 0) & (p.back >= 0)], minlength=len(p.word)).astype(np.uint32)
                rows = []
                for b, at in sliced(p.dealt(n, known["hot"], words)):
                    heads = heads_of(p.history[at])
                    first = at[heads]
                    rows.append((b, row["chunk"], packed(p.of_history[first], k == 2, k == 3), packed(np.diff(np.append(heads, len(at))).astype(np.uint32)), packed(words.hashes[p.word[at]]), packed(p.lower_count[at].astype(np.uint32)), packed(p.lower_whole[first].astype(np.uint64)), packed(train[at]), packed(p.hot[first].astype(np.uint8))))
                columns = zip(*rows, strict=True) if rows else [[]] * len(REQUEST)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 7), strict=True)], REQUEST)

    def answered(key: tuple, rows: pa.Table) -> pa.Table:
        kinds = (np.uint64, np.uint32, np.uint64, np.uint32, np.uint64, np.uint32, np.uint8)
        columns = {c: [unpacked(x, kind, c == "histories" and k == 2, c == "histories" and k == 3) for x in rows[c].to_pylist()] for c, kind in zip(REQUEST[2:], kinds, strict=True)}
        flat = {c: np.concatenate(x) for c, x in columns.items()}
        sizes = flat["sizes"].astype(np.int64)
        own, place = np.unique(flat["histories"], return_inverse=True)
        code = (np.repeat(place, sizes).astype(np.uint64) << WORD_BITS) | flat["words"]
        order = np.argsort(code)
        code = code[order]
        heads = heads_of(code)
        total = np.add.reduceat(flat["counts"][order].astype(np.int64), heads)
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        # by history: grams seen 1 .. CUTOFF times, tokens of others, and what their words make without its first word
        which = (code[heads] >> WORD_BITS).astype(np.int64)
        small = np.stack([np.bincount(which[total == r], minlength=len(own)) for r in range(1, CUTOFF + 1)], axis=1)
        large = np.bincount(which, np.where(total > CUTOFF, total, 0), len(own)).astype(np.int64)
        whole = np.repeat(flat["wholes"], sizes)[order][heads].astype(np.float64) if k > 2 else known["whole"]
        below = discounted(flat["lower"][order][heads].astype(np.int64), d_lower) / np.maximum(whole, 1)
        share = np.bincount(which, np.where(total > 0, below, 0.0), len(own))
        stats = [int((total == r).sum()) for r in range(1, CUTOFF + 2)]
        out, a, f = [], 0, 0
        for chunk, hs, ss in zip(rows["chunk"].to_pylist(), columns["histories"], columns["sizes"], strict=True):
            size = int(ss.sum())
            mine = total[back[a : a + size]]
            at = place[f : f + len(hs)]
            new = np.bincount(np.repeat(np.arange(len(hs)), ss)[mine == 0], minlength=len(hs)) > 0  # backs off somewhere
            out.append({"chunk": chunk, "bucket": key[0].as_py(), "counts": packed(mine.astype(np.uint32)), "full": packed((small[at].sum(axis=1) == 0).astype(np.uint8)), "small": packed(small[at][new].astype(np.uint32).T.ravel()), "large": packed(large[at][new].astype(np.uint64)), "share": packed(share[at][new])})
            a, f = a + size, f + len(hs)
        burning = np.unique(flat["histories"][flat["hot"] > 0])
        at = np.searchsorted(own, burning)
        out.append({"chunk": None, "stats": stats, "hot": [{"history": int(x), "small": small[i].tolist(), "large": int(large[i]), "share": float(share[i])} for x, i in zip(burning.view(np.int64), at, strict=True)]})
        return pa.Table.from_pylist(out, ANSWER)

    requests = joined.mapInArrow(asked, "bucket int, chunk long, " + ", ".join(f"{c} binary" for c in REQUEST[2:]))
    return materialise(requests.groupBy("bucket").applyInArrow(answered, ANSWER_SQL), f"lm-grams{k}", cleanup=True)


def summed(answers: DataFrame) -> list[int]:
    """The buckets' stats, added up by place."""
    rows = answers.where("stats IS NOT NULL").select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["k"])]


def with_answers(table: DataFrame, answers: DataFrame, k: int, n_tables: int) -> DataFrame:
    """Chunks with their answers of one order, which are as many as their grams. The answers move once, to buckets like the chunks', which stay where they are; the buckets' own copy goes."""
    columns = [c for c in answers.columns if c not in ("chunk", "stats", "hot")]
    own = answers.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias(f"answers{k}"))
    own = bucketed(own, f"lm_answers{k}", "chunk", n_tables)
    discard(answers)
    return table.join(own, "chunk")


def learnt(docs: DataFrame, order: int = ORDER, n_tables: int | None = None) -> tuple[DataFrame, dict]:
    """Chunks with answers of all orders, and what scores need to know."""
    spark = docs.sparkSession
    n_tables = n_tables or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = chunks(docs, n_tables)
    total = table.agg(F.sum("n_words")).first()[0] or 0
    n_words = max(8, -(-total // BUCKET_ENTRIES))
    answers = vocabulary(table, n_words)
    stats = np.array([0, *(summed(answers) or [0] * (CUTOFF + 4))], np.int64)
    seen, tokens = int(stats[CUTOFF + 2]), int(stats[CUTOFF + 3])
    d_words, r = discounts(stats), np.arange(1, CUTOFF + 1)
    mass = float((d_words[1 : CUTOFF + 1] * r * stats[1 : CUTOFF + 1]).sum() + (tokens - (r * stats[1 : CUTOFF + 1]).sum()))
    whole = tokens + 1.0 if tokens and tokens - mass < 1e-9 else float(max(tokens, 1))
    n_grams = max(8, -(-tokens * FOLDS // ((FOLDS - 1) * BUCKET_ENTRIES)))
    known = {"n_words": n_words, "hot": max(1, tokens // HOT), "seen": seen, "tokens": tokens, "whole": whole, "unknown": 1 - mass / whole, "d": {1: d_words}, "n": {}, "histories": {}}
    joined = with_answers(table.select("chunk", "doc_ids", "held", "lens", "tokens", "words"), answers, 1, n_tables)
    for k in range(2, order + 1):
        known["n"][k] = n_grams
        answers = gram_answers(joined, k, known)
        known["d"][k] = discounts(np.array([0, *(summed(answers) or [0] * (CUTOFF + 1))]))
        rows = answers.where("hot IS NOT NULL").select(F.inline("hot")).groupBy("history").agg(*(F.sum(F.get("small", F.lit(x))).alias(f"s{x}") for x in range(CUTOFF)), F.sum("large").alias("large"), F.sum("share").alias("share"))
        known["histories"][k] = {x["history"]: (np.array([x[f"s{i}"] for i in range(CUTOFF)]), x["large"], x["share"]) for x in rows.collect()}  # HOT + 1 at most
        joined = with_answers(joined, answers, k, n_tables)
    return joined, known


def backoff(small: np.ndarray, large: np.ndarray, share: np.ndarray, count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """a(h), from what was seen after h; 1 for a history never seen."""
    kept = (small * (d[1 : CUTOFF + 1] * np.arange(1, CUTOFF + 1))).sum(axis=1) + large
    whole = np.where(small.sum(axis=1) == 0, count + 1, count)
    return np.where(count > 0, (1 - kept / np.maximum(whole, 1)) / (1 - share), 1.0)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    joined, known = learnt(docs, order)
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(batch.num_rows):
                row = batch.slice(at_row, 1).to_pylist()[0]
                words, lens = Grams.words(row, known)
                own, chance = words, words.chance[words.back]
                for k in range(2, order + 1):
                    above = own.longer(words, lens, last=k == order)
                    above.answer(row[f"answers{k}"], k, known, words, own)
                    there = above.back >= 0
                    chance[there] = above.chance[above.back[there]]
                    own = above
                base = np.log10((words.seen + 1) / (known["tokens"] + known["seen"] + 1))[words.back]
                text = np.repeat(np.arange(len(lens)), lens)
                add = lambda x, text=text, n=len(lens): np.bincount(text, x, n)
                columns = [row["doc_ids"], np.frombuffer(row["held"], np.uint8).astype(bool), lens, add(words.seen[words.back] > 0).astype(np.int64), np.full(len(lens), known["tokens"]), add(base), add(np.log10(chance))]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(columns, fields, strict=True)], [c for c, _ in fields])

    return joined.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


QUERIES = {"op2_ngram_lm": op2_ngram_lm}
ORACLE_SQL: dict[str, str] = {}
