"""Packing and token files against the tokenizer itself, one text at a time."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("codequarry.llm")

from tokenizers import Tokenizer  # noqa: E402

from codequarry.llm import packing, token_files  # noqa: E402
from codequarry.llm._tokenizer import PieceEncoder, tokenizer_path  # noqa: E402

TEXTS = [
    None, "", " ", "\n", "a", " lead", "trail ", "two  spaces", "tab\there", "line\nbreak\n\nblank", "x <|endoftext|> y", "<|endoftext|>", "don't can't. we'll!", "O'Neil's.",
    "nul\0byte", "emoji 😀. x", "日本語 テキスト。", "× ÷ x×. ªµº. ok", "İstanbul! ß. ǅ", "1.5 2,3 (x) [y]. \"q\"", "w" * 5000 + ".", "wide space", "a b c\nd! e? f.", "the same words again the same words again",
]
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: (doc_id, text); ids repeat, are null or negative, and rows are equal.
ROWS = [*enumerate(TEXTS), (100, LONG), (100, LONG), (100, "other"), (None, "no id"), (None, "no id"), (-5, "below"), *[(7, "equal rows")] * 40]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, part string, ids long")


def ids_of(text):
    own = ids_of.__dict__.setdefault("own", Tokenizer.from_file(tokenizer_path()))
    return [*own.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("limit", [4, 300_000])
def test_pieces_are_the_tokenizers(limit):
    own = PieceEncoder(tokenizer_path(), limit)
    for _ in range(2):
        assert [[*x.tolist(), 2] for x in own.encode(pa.array(TEXTS), 64)] == list(map(ids_of, TEXTS))


@pytest.mark.parametrize("shard_ids", [1, 50, 4_000_000])
def test_token_files_against_the_tokenizer(docs, shard_ids):
    rows = sorted(token_files.read_shards(token_files.write_shards(docs, shard_ids=shard_ids)).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((i, len(x := ids_of(t)), crc(x)) for i, t in ROWS)
    assert [r["start"] for r in rows] == [0, *itertools.accumulate(r["n_tokens"] for r in rows[:-1])]
    order = [-(10**9) if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert order == sorted(order)


@pytest.mark.parametrize("salt_pieces", [3, 250_000])
def test_packing_against_the_tokenizer(docs, salt_pieces):
    rows = packing.pack(docs, salt_pieces=salt_pieces).collect()
    expected = Counter()
    for i, t in ROWS:
        x = ids_of(t)
        first = len(x) % 1024 or 1024
        for k, (a, n) in enumerate([(0, len(x))] if len(x) <= 1024 else [(0, first), *((a, 1024) for a in range(first, len(x), 1024))]):
            expected[i, k, a, n, crc(x[a : a + n])] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024
    assert len(filled) <= -(-sum(filled.values()) // 1024) + 1  # as few as can be, or one more


def test_empty_tables(docs):
    assert packing.pack(docs.limit(0)).count() == 0
    assert token_files.read_shards(token_files.write_shards(docs.limit(0))).count() == 0
