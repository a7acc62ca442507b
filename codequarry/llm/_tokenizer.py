"""Public tokenizers over whole texts, with a bounded cache of pieces.

A byte-level BPE vocabulary never joins what its pre-tokenizer separates. Where a text has only
single spaces and line ends between words, every space starts a piece and every line end is one
of its own, so a piece's ids don't depend on its neighbours: each distinct piece of a batch is
encoded once and the texts are put together from them. Any other text goes to the tokenizer whole,
as does a text that holds one of the tokenizer's added tokens.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Punctuation that ends a piece and never joins letters; the apostrophe may.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters in every version of Unicode.
LATIN = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
TAILED = rf"[{LATIN}][{re.escape(TAIL)}]+\z"
WORD = rf"\A ?[{LATIN}]+\z"
#: White space other than single spaces and line ends inside a text, or the mark used to split.
IRREGULAR = (
    r"[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n][ \n]|\A[ \n]|[ \n]\z"
)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(store: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """store[first[i]:first[i] + size[i]] of every i, one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(store)) < 1 << 31 else np.int64
    return store[np.repeat((first - ends + size).astype(kind), size) + np.arange(total, dtype=kind)]


class Pieces:
    """Distinct strings with their ids, as flat arrays."""

    def __init__(self, strings: pa.Array, size: np.ndarray, store: np.ndarray):
        self.strings, self.size, self.store = strings, size, store
        self.first = np.cumsum(size, dtype=np.int64) - size

    def places(self, strings: pa.Array) -> np.ndarray:
        """Where each string stands; -1 where it does not."""
        return pc.fill_null(pc.index_in(strings, value_set=self.strings), -1).to_numpy(zero_copy_only=False)

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(self.strings.take(pa.array(at)), self.size[at], ragged(self.store, self.first[at], self.size[at]))

    def with_more(self, other: Pieces) -> Pieces:
        return Pieces(pa.concat_arrays([self.strings, other.strings]), np.concatenate([self.size, other.size]), np.concatenate([self.store, other.store]))


class PieceEncoder:
    """Texts to token ids. The cache holds `limit` pieces, those used last, in flat arrays of some tens of
    bytes a piece, so that memory is bounded whatever the vocabulary of the corpus."""

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [x["content"] for x in spec["added_tokens"] or ()]
        self.limit, self.letters = limit, None
        self.cache = Pieces(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        self.used, self.turn = np.zeros(0, np.int64), 0
        if (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel":  # the same merges, for words cut already
            self.letters = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
            shown = {b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
            hidden = [b for b in range(256) if b not in shown]
            self.shown = np.array([b if b in shown else 256 + hidden.index(b) for b in range(256)], "<u4")

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _ids(self, texts: list[str], block: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids."""
        size, store = [], [np.zeros(0, np.uint32)]
        for at in range(0, len(texts), block):
            made = self.tokenizer.encode_batch_fast(texts[at : at + block], add_special_tokens=False)
            size += [len(e) for e in made]
            store += [np.frombuffer(array("I", e.ids), np.uint32) for e in made]
        return np.array(size, np.int64), np.concatenate(store)

    def _words(self, words: pa.Array, block: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """As _ids, of strings that are one word of Latin letters, with or without a space before it."""
        raw, lens = b"".join(words.cast(pa.large_binary()).to_pylist()), pc.binary_length(words).to_numpy()
        shown, ends = self.shown[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le"), np.cumsum(lens).tolist()
        mapped = [shown[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        size, store = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        lists = [mapped[i : i + block] for i in range(0, len(mapped), block)]
        for own, e in zip(lists, self.letters.encode_batch(lists, is_pretokenized=True, add_special_tokens=False), strict=True):
            size.append(np.bincount(e.word_ids, minlength=len(own)))
            store.append(np.frombuffer(array("I", e.ids), np.uint32))
        return np.concatenate(size), np.concatenate(store)

    def _made(self, strings: pa.Array) -> Pieces:
        """Distinct strings, encoded."""
        easy = pc.match_substring_regex(strings, WORD).to_numpy(zero_copy_only=False) if self.letters else np.zeros(len(strings), bool)
        words, others = strings.filter(pa.array(easy)), strings.filter(pa.array(~easy))
        made = [self._words(words) if len(words) else self._ids([]), self._ids(others.to_pylist())]
        return Pieces(pa.concat_arrays([words, others]), *(np.concatenate(x) for x in zip(*made, strict=True)))

    def _keep(self, strings: pa.Array) -> np.ndarray:
        """Places in the cache of distinct strings, all of which are in it then."""
        self.turn += 1
        at = self.cache.places(strings)
        fresh = strings.filter(pa.array(at < 0))
        if len(fresh):
            tailed = pc.match_substring_regex(fresh, TAILED)  # a word's closing punctuation is encoded apart
            whole, plain = fresh.filter(tailed), fresh.filter(pc.invert(tailed))
            stems = pc.utf8_rtrim(whole, characters=TAIL)
            tails = pa.array([w[n:] for w, n in zip(whole.to_pylist(), pc.utf8_length(stems).to_pylist(), strict=True)], pa.large_string())
            parts = pa.concat_arrays([plain, stems, tails]).unique()
            there = self.cache.places(parts)
            self._add(self._made(parts.filter(pa.array(there < 0))))
            ends = np.stack([self.cache.places(stems), self.cache.places(tails)], axis=1).ravel()
            size = self.cache.size[ends]
            self._add(Pieces(whole, size.reshape(-1, 2).sum(axis=1), ragged(self.cache.store, self.cache.first[ends], size)))
            at = self.cache.places(strings)
        self.used[at] = self.turn
        return at

    def _add(self, more: Pieces) -> None:
        self.cache = self.cache.with_more(more)
        self.used = np.concatenate([self.used, np.full(len(more.size), self.turn)])

    def _trim(self) -> None:
        if len(self.used) > self.limit:
            at = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
            self.cache, self.used = self.cache.take(at), self.used[at]

    def _regular(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's end."""
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        base, raw = offsets[0], column.buffers()[2]
        flat = np.frombuffer(raw, np.uint8)[base : offsets[-1]] if raw else np.zeros(0, np.uint8)
        begins = np.zeros(len(flat) + 1, bool)
        begins[:-1] = (flat == 32) | (flat == 10)
        begins[1:] |= flat == 10
        begins[offsets - base] = True
        cuts = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer((cuts + base).astype(np.int64)), raw]) if len(cuts) > 1 else pa.array([], pa.large_string())
        coded = pieces.dictionary_encode()
        codes, at = coded.indices.to_numpy(), self._keep(coded.dictionary)
        each = self.cache.size[at][codes]
        ids = ragged(self.cache.store, self.cache.first[at][codes], each)
        ends = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(cuts, offsets - base)]
        self._trim()
        return ids, ends

    def encode(self, column: pa.Array, block: int = 8 << 20) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text; none for null. Takes about `block` bytes of texts at a time."""
        column = pc.fill_null((column.take(pa.array(np.arange(len(column)))) if column.offset else column).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        cuts = np.flatnonzero(np.diff(ends // block, prepend=0)).tolist() if len(column) else []
        for a, b in zip([0, *cuts], [*cuts, len(column)], strict=True):
            yield from self._encode(column.slice(a, b - a))

    def _encode(self, column: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(column, IRREGULAR).to_numpy(zero_copy_only=False)
        for token in self.added:
            odd = odd | pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        out: list = [None] * len(column)
        if len(at := np.flatnonzero(~odd)):
            ids, bounds = self._regular(column.take(pa.array(at)))
            for k, i in enumerate(at):
                out[i] = ids[bounds[k] : bounds[k + 1]]
        if len(at := np.flatnonzero(odd)):
            size, ids = self._ids(column.take(pa.array(at)).to_pylist())
            for i, x in zip(at, np.split(ids, np.cumsum(size)[:-1]), strict=True):
                out[i] = x
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker, which keeps its pieces from task to task."""
    return PieceEncoder(path)
