"""Token ids of whole texts by a public byte-level BPE vocabulary.

The pre-tokenizer of the vocabulary never joins text across the end of a run of non-space characters, so a text is encoded chunk by chunk,
a chunk being a run of spaces with the run of other characters after it, split further where an ASCII letter meets an ASCII mark other than the apostrophe. Each distinct chunk is encoded once per worker by ``tokenizers``
and looked up by its hash afterwards; the bytes of every chunk are compared with those that the store encoded, and should two chunks ever share a hash, the store starts anew with another key. A chunk that ends in a space beyond ASCII stays joined to the next one, as the pre-tokenizer
may join those. The store of a worker holds at most ``STORED`` chunks and starts anew when full.

By default the vocabulary's special tokens are text like any other. With ``added`` the ids are those of the file's own tokenizer: each literal string of an added token
is a chunk of its own with that token's id, and texts are cut there first, as the tokenizer does.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from finrecon.llm import textarrays as ta

STORED, AT_ONCE = 1 << 20, 4096


class ChunkStore:
    """Ids of chunks by hash; encode turns a list of chunks (bytes) into their ids end to end and the number of each.
    added finds the literal strings of added tokens, None if there are none to find."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], added: re.Pattern[bytes] | None = None):
        self.encode, self.added, self.key = encode, added, 0
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.known = KnownBytes()

    def look_up(self, found: ta.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first position in ids, number of ids) for each chunk; the chunks cover their texts."""
        while True:
            which, distinct = pd.factorize(found.hashes(self.key))
            if len(self.keys) + len(distinct) > STORED:
                self.clear()
            place = np.searchsorted(self.keys, distinct)
            new = np.ones(len(distinct), bool)
            there = place < len(self.keys)
            new[there] = self.keys[place[there]] != distinct[there]
            if new.any():
                self.add(distinct, place, np.flatnonzero(new), first_of(which, len(distinct)), found)
                place = np.searchsorted(self.keys, distinct)
            row = place[which]
            if self.known.equal(row, found):
                return self.at[row], self.size[row]
            self.key += 1
            self.clear()

    def add(self, distinct: np.ndarray, place: np.ndarray, fresh: np.ndarray, first: np.ndarray, found: ta.Words) -> None:
        fresh = fresh[np.argsort(distinct[fresh])]
        ids, size = [], []
        for k in range(0, len(fresh), AT_ONCE):
            got, own = self.encode([found.bytes_of(i) for i in first[fresh[k : k + AT_ONCE]].tolist()])
            ids.append(got)
            size.append(own)
        size = np.concatenate(size)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *ids])
        self.at, self.size, self.keys = (np.insert(old, place[fresh], own) for old, own in ((self.at, at), (self.size, size), (self.keys, distinct[fresh])))
        self.known.add(place[fresh], first[fresh], found)


def first_of(which: np.ndarray, n: int) -> np.ndarray:
    """The first place at which each of n numbers stands in which."""
    first = np.zeros(n, np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return first


class KnownBytes:
    """The bytes of a store's entries, end to end, in the order of the store's rows."""

    def __init__(self):
        self.at, self.size, self.data = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def add(self, rows: np.ndarray, words: np.ndarray, found: ta.Words) -> None:
        """Put words of found at the rows, as numpy.insert does."""
        size = found.stop[words] - found.start[words]
        at = len(self.data) + np.cumsum(size) - size
        self.data = np.concatenate([self.data, found.texts.data[gathered(found.start[words], size)]])
        self.at, self.size = np.insert(self.at, rows, at), np.insert(self.size, rows, size)

    def equal(self, rows: np.ndarray, found: ta.Words) -> bool:
        """Whether the rows hold the bytes of the words of found, which cover their texts."""
        if not np.array_equal(self.size[rows], found.stop - found.start):
            return False
        return np.array_equal(self.data[gathered(self.at[rows], self.size[rows])], found.texts.data)


def gathered(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions at[i] .. at[i] + size[i] - 1 of all i, one after another."""
    return np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)


_stores: dict[tuple[str, bool], ChunkStore] = {}


def store_of(path: str, added: bool = False) -> ChunkStore:
    """The store for a vocabulary, with its added tokens or with these as plain text; a Python worker keeps it from task to task."""
    if (path, added) not in _stores:
        _stores[path, added] = ChunkStore(byte_level(path, added), added_tokens(path) if added else None)
    return _stores[path, added]


def added_tokens(path: str) -> re.Pattern[bytes] | None:
    """Matches the literal strings of the added tokens, the longest first."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens of {path} that take more or less than their literal string")
    strings = sorted((t["content"].encode() for t in tokens), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, strings))) if strings else None


def byte_level(path: str, added: bool = False) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    line_end = tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        size, plain, other = np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            word = t[1:] if t[:1] == " " else t
            (plain if word and word.split() == [word] else other).append(i)
        # Plain chunks are lines of one text: a line end is a token of its own there, so it parts their ids.
        lines = np.array(tokenizer.encode("\n".join([texts[i] for i in plain] + [""]), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(lines == line_end)
        size[plain] = np.diff(ends, prepend=-1) - 1
        rest = [e.ids for e in tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)]
        size[other] = list(map(len, rest))
        ids = np.zeros(size.sum(), np.uint32)
        at = np.cumsum(size) - size
        ids[gathered(at[plain], size[plain])] = lines[lines != line_end]
        for i, own in zip(other, rest, strict=True):
            ids[at[i] : at[i] + len(own)] = own
        return ids, size

    return encode


def _wide_space(data: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether the character before each stop is a space beyond ASCII."""
    at = [np.where(stop >= k, data[np.maximum(stop - k, 0)], 0) for k in (1, 2, 3)]
    last, second, third = at
    two = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    ogham = (third == 0xE1) & (second == 0x9A) & (last == 0x80)
    general = (third == 0xE2) & (second == 0x80) & (((last >= 0x80) & (last <= 0x8A)) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    mathematical = (third == 0xE2) & (second == 0x81) & (last == 0x9F)
    return two | ogham | general | mathematical | ((third == 0xE3) & (second == 0x80) & (last == 0x80))


#: Classes of ASCII bytes: letters 1, marks other than the apostrophe 2, all else 0.
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 2
CLASS[48:58] = 0
CLASS[39] = 0
CLASS[[*range(65, 91), *range(97, 123)]] = 1


def _found(texts: ta.Texts, added: re.Pattern[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after of each added token in the texts."""
    spans = []
    if added and added.search(texts.data.tobytes()):
        for i, base in enumerate(texts.offsets[:-1].tolist()):
            spans += [(base + m.start(), base + m.end()) for m in added.finditer(texts.bytes_of(i))]
    return tuple(np.array(spans, np.int64).reshape(-1, 2).T)


def chunks(texts: ta.Texts, added: re.Pattern[bytes] | None = None) -> ta.Words:
    """The chunks of the texts; see the module."""
    found = texts.words(lead=True)
    stop = found.stop
    stop = stop[~_wide_space(texts.data, stop)]
    kind = CLASS[texts.data]
    turns = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    stop = ta.marked(len(texts.data), stop, turns, texts.offsets[1:][texts.offsets[1:] > texts.offsets[:-1]])
    first, last = _found(texts, added)
    if len(first):
        within = np.searchsorted(first, stop, side="left") > np.searchsorted(last, stop, side="right")
        stop = ta.marked(len(texts.data), stop[~within], first[first > 0], last)
    start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    return ta.Words(texts, start, stop, np.searchsorted(texts.offsets, start, side="right") - 1, found.table, found.n)


def encoded(column: pa.Array, store: ChunkStore) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids end to end, ids per text) for a few texts of the column at a time."""
    for first, texts in ta.pieces(column):
        found = chunks(texts, store.added)
        at, size = store.look_up(found)
        yield first, store.ids[gathered(at, size)], np.bincount(found.text, weights=size, minlength=len(texts)).astype(np.int64)


def encoded_sizes(column: pa.Array, store: ChunkStore) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, ids per text), without the ids."""
    for first, texts in ta.pieces(column):
        found = chunks(texts, store.added)
        _, size = store.look_up(found)
        yield first, np.bincount(found.text, weights=size, minlength=len(texts)).astype(np.int64)
