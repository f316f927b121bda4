"""Words, shingles and hashes of many texts at once, as numpy arrays inside a Spark task.

A ``Texts`` holds the UTF-8 bytes of a few texts end to end. Words are found and hashed with vector operations, so that no Python code runs per word. A task takes an Arrow batch in pieces of at most
``PIECE_BYTES`` (one text, if a text is longer): memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

#: The bytes that separate words, 0x20 and 0x09-0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

#: Longer words are hashed one by one.
LONG_WORD = 64
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in [0, 1) from 64-bit keys."""
    return (mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def marked(n: int, *places: np.ndarray) -> np.ndarray:
    """The places in 0..n that are in any of the arrays, in order."""
    marks = np.zeros(n + 1, bool)
    for p in places:
        marks[p] = True
    return np.flatnonzero(marks)


class Texts:
    """Bytes of texts end to end; offsets has one more entry than there are texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, fold: bool = False, separators: np.ndarray = SPACES, lead: bool = False) -> Words:
        """Maximal runs of bytes that are not separators. With lead, a word also takes the separators before it, and
        separators that end a text form a word of their own, so that the words of a text spell it."""
        data, offsets = self.data, self.offsets
        n = len(data)
        inside = ~separators[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[full] = inside[full]
        ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = inside[offsets[1:][offsets[1:] > offsets[:-1]] - 1]
        stop = np.flatnonzero(ends) + 1
        if lead:
            stop = marked(n, stop, offsets[1:][offsets[1:] > offsets[:-1]])
            start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        else:
            start = np.flatnonzero(begins)
        text = np.searchsorted(offsets, start, side="right") - 1
        return Words(self, start, stop, text, LOWER if fold else SAME, n)


class Words:
    """Spans [start, stop) of a Texts with the index of the text that each lies in, in order."""

    def __init__(self, texts: Texts, start: np.ndarray, stop: np.ndarray, text: np.ndarray, table: np.ndarray, n: int):
        self.texts, self.start, self.stop, self.text, self.table, self.n = texts, start, stop, text, table, n

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, key: int = 0) -> np.ndarray:
        """64-bit hashes of the words' bytes under the key: eight bytes at a time go through ``mix``, all words at once; a digest for long words.

        Words of up to eight bytes and of one length never collide; a caller to whom any collision matters compares bytes and changes the key."""
        size = self.stop - self.start
        folded = np.concatenate([self.table[self.texts.data], np.zeros(8, np.uint8)])
        eight = np.ndarray(len(folded) - 7, "<u8", folded, strides=(1,))
        seed = mix(np.array([key], np.uint64))
        out = mix(seed + size.astype(np.uint64))
        live, at = np.flatnonzero(size <= LONG_WORD), 0
        while len(live):
            left = size[live] - at
            out[live] = mix(out[live] ^ (eight[self.start[live] + at] & _HEAD[np.minimum(left, 8)]))
            live, at = live[left > 8], at + 8
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            digest = blake2b(folded[self.start[i] : self.stop[i]], digest_size=8, key=seed.tobytes()).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.text, minlength=len(self.texts))

    def bytes_of(self, i: int) -> bytes:
        return self.table[self.texts.data[self.start[i] : self.stop[i]]].tobytes()


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words in one text; all words as one run if there are fewer; none if there are none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < size:
        size = n
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = mix(out + hashes[k : n - size + 1 + k] * np.uint64(0xD6E8FEB86659FD93)) if k else hashes[: n - size + 1].copy()
    return mix(out + np.uint64(size))


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, Texts) over an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
