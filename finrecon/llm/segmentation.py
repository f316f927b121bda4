"""SentencePiece encoding by sampled segmentations, and lossless decoding.

All segmentations of a text into pieces form a lattice. Forward filtering sums the weights of the paths that reach each place; backward sampling then draws
a path from the end, each step in proportion to the sums, so a path has exactly its share of the total weight. The random numbers are a hash of the
seed, the row's key, the place of the segment and the step: a row gives the same ids in any batch, partition or retry.

Pieces do not reach over the start of a run of spaces, so the lattice falls into segments, a run of spaces with the other characters after it, split further between ASCII characters
that no piece holds side by side. The sums of each distinct
segment are computed once per worker; a sampling step then tries the edges of one node for each segment, all segments of a batch at once. A piece of rank r weighs
(1 + r) ** -alpha, since the vocabulary gives merge ranks; alpha sets how far samples stray from frequent pieces. Characters without a piece, and the space mark itself, become
byte pieces, so decoding gives back every text exactly.

Ids are integers. Defined cases: null and empty texts have no pieces and decode to the empty text; a null key has a seed of its own, unlike that of any number; repeated rows get equal ids; other columns are not read; an
empty table gives an empty result. A segment of any length is sampled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from finrecon.llm import textarrays as ta
from finrecon.llm.frames import in_arrow, own
from finrecon.llm.tokens import KnownBytes, first_of, gathered

MARK = "▁"
ALPHA, STORED_EDGES = 1.0, 6_000_000
#: Bits of a hash that are looked at before it is sought among those of the pieces.
LEADING = 20
NO_KEY = np.uint64(0xA0761D6478BD642F)
ONLY_SPACE = np.zeros(256, bool)
ONLY_SPACE[0x20] = True


class Lattices:
    """Backward edges of the lattices of distinct segments, end to end.

    Node numbers run over all segments. threshold holds v plus the cumulative
    probability of its edges, and first its first edge, from which the few thresholds of the node are tried in turn. Edge e takes its node back to before[e] and emits piece emit[e], or the bytes of a character."""

    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.pieces = p.get_piece_size()
        names = [p.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.byte_id = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_weight = -alpha * np.log(1.0 + n)
        self.longest = max(len(names[i]) for i in plain)
        spelt = [b""] * n
        for i in plain:
            spelt[i] = names[i].encode()
        for b, i in enumerate(self.byte_id):
            spelt[i] = bytes([b])
        size = np.array([len(b) for b in spelt])
        self.piece_size, self.piece_at = size, np.cumsum(size) - size
        self.piece_bytes = np.frombuffer(b"".join(spelt), np.uint8)
        #: Hashes of the pieces in order, with their ids and logarithmic weights.
        all_ = ta.Texts(np.frombuffer(b"".join(spelt[i] for i in plain), np.uint8), np.concatenate([[0], np.cumsum([len(spelt[i]) for i in plain])]))
        hashes = ta.Words(all_, all_.offsets[:-1], all_.offsets[1:], np.arange(len(plain)), ta.SAME, len(all_.data)).hashes()
        order = np.argsort(hashes)
        self.piece_hash, self.piece_id = hashes[order], np.array(plain)[order]
        #: The leading bits that hashes of pieces have; most substrings are no pieces, and their hashes are not sought.
        self.leading = np.zeros(1 << LEADING, bool)
        self.leading[self.piece_hash >> np.uint64(64 - LEADING)] = True
        self.piece_weight = -alpha * np.log(1.0 + np.array([max(min(-p.get_score(int(i)), n), 0) for i in self.piece_id]))
        #: Whether two ASCII bytes ever stand next to each other in a piece; other bytes always may.
        self.joined = np.ones((256, 256), bool)
        self.joined[:128, :128] = False
        for i in plain:
            raw = np.frombuffer(spelt[i], np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.key = 0
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.known = KnownBytes()
        self.end = np.zeros(0, np.int64)
        self.nodes = 0
        self.threshold, self.before, self.emit = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int32)
        self.spelt_out: list[list[int]] = []
        self.spelt_of: dict[bytes, int] = {}

    def add(self, segments: list[bytes]) -> np.ndarray:
        """Add the lattices of the segments; the end node of each."""
        sizes = np.array(list(map(len, segments)), np.int64)
        data = np.frombuffer(b"".join(segments), np.uint8)
        texts = ta.Texts(data, np.concatenate([[0], np.cumsum(sizes)]))
        char = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        of = np.searchsorted(texts.offsets, char[:-1], side="right") - 1
        first = np.searchsorted(char, texts.offsets)
        # A segment of n characters has n + 1 nodes, so the node before character u of segment s is u + s.
        before, after, weight, piece = [], [], [], []
        for k in range(1, self.longest + 1):
            u = np.flatnonzero(np.arange(len(of)) + k <= first[of + 1])
            if not len(u):
                break
            h = ta.Words(texts, char[u], char[u + k], of[u], ta.SAME, len(data)).hashes()
            may = np.flatnonzero(self.leading[h >> np.uint64(64 - LEADING)])
            place, found = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            place[may] = np.minimum(np.searchsorted(self.piece_hash, h[may]), len(self.piece_hash) - 1)
            found[may] = self.piece_hash[place[may]] == h[may]
            hit, ids = np.flatnonzero(found), self.piece_id[place[found]]
            size = char[u[hit] + k] - char[u[hit]]
            right = size == self.piece_size[ids]
            found[hit[~right]] = False
            hit, ids, size = hit[right], ids[right], size[right]
            same = data[gathered(char[u[hit]], size)] == self.piece_bytes[gathered(self.piece_at[ids], size)]
            found[hit[np.bincount(np.repeat(np.arange(len(hit)), size), weights=~same, minlength=len(hit)) > 0]] = False
            if k == 1:
                lone = u[~found]
                size = char[lone + 1] - char[lone]
                before.append(lone + of[lone])
                after.append(lone + of[lone] + 1)
                weight.append(size * self.byte_weight)
                piece.append(self.pieces + self.spelt_place(data, char[lone], size))
            u, place = u[found], place[found]
            before.append(u + of[u])
            after.append(u + of[u] + k)
            weight.append(self.piece_weight[place])
            piece.append(self.piece_id[place])
        before, after, weight, piece = (np.concatenate(x) for x in (before, after, weight, piece))
        nodes = len(of) + len(segments)
        start = first[:-1] + np.arange(len(segments))
        level = after - start[np.searchsorted(start, after, side="right") - 1]
        order = np.lexsort((before, after, level))
        total = np.zeros(nodes)
        b, a, w = before[order], after[order], weight[order]
        cuts = np.flatnonzero(np.diff(level[order], prepend=0))
        for low, high in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            x, node = w[low:high] + total[b[low:high]], a[low:high]
            group = np.flatnonzero(np.diff(node, prepend=-1))
            most = np.maximum.reduceat(x, group)
            sum_ = np.add.reduceat(np.exp(x - np.repeat(most, np.diff(np.append(group, len(x))))), group)
            total[node[group]] = most + np.log(sum_)
        order = np.lexsort((before, after))
        before, after, weight, piece = before[order], after[order], weight[order], piece[order]
        share = np.exp(weight + total[before] - total[after])
        run = np.cumsum(share)
        group = np.flatnonzero(np.diff(after, prepend=-1))
        inside = run - np.repeat(run[group] - share[group], np.diff(np.append(group, len(after))))
        last = np.append(group[1:], len(after)) - 1
        inside[last] = 1.0
        edges = np.bincount(after, minlength=nodes)
        self.first = np.concatenate([self.first, (len(self.threshold) + np.cumsum(edges) - edges).astype(np.int32)])
        self.threshold = np.concatenate([self.threshold, self.nodes + after + np.minimum(inside, 1.0)])
        self.before = np.concatenate([self.before, (self.nodes + before).astype(np.int32)])
        self.emit = np.concatenate([self.emit, piece.astype(np.uint32)])
        ends = self.nodes + first[1:] + np.arange(len(segments))
        self.nodes += nodes
        return ends

    def spelt_place(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places in spelt_out of the characters at those bytes."""
        out = np.zeros(len(at), np.int64)
        for i, (a, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
            raw = data[a : a + n].tobytes()
            if raw not in self.spelt_of:
                self.spelt_of[raw] = len(self.spelt_out)
                self.spelt_out.append([self.byte_id[b] for b in raw])
            out[i] = self.spelt_of[raw]
        return out

    def look_up(self, found: ta.Words) -> np.ndarray:
        """The end node of the lattice of each segment; the segments cover their texts. Bytes are compared, and a hash that two segments share gets another key."""
        while True:
            which, distinct = pd.factorize(found.hashes(self.key))
            if len(self.threshold) > STORED_EDGES:
                self.clear()
            place = np.searchsorted(self.keys, distinct)
            new = np.ones(len(distinct), bool)
            there = place < len(self.keys)
            new[there] = self.keys[place[there]] != distinct[there]
            fresh = np.flatnonzero(new)
            if len(fresh):
                fresh = fresh[np.argsort(distinct[fresh])]
                first = first_of(which, len(distinct))[fresh]
                ends = self.add([found.bytes_of(i) for i in first.tolist()])
                self.keys, self.end = np.insert(self.keys, place[fresh], distinct[fresh]), np.insert(self.end, place[fresh], ends)
                self.known.add(place[fresh], first, found)
                place = np.searchsorted(self.keys, distinct)
            row = place[which]
            if self.known.equal(row, found):
                return self.end[row]
            self.key += 1
            self.clear()

    def sampled(self, end: np.ndarray, seed: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per segment) of a drawn path for each segment; length is the segment's number of characters."""
        n = len(end)
        node, start, live = end.copy(), end - length, np.arange(n)
        edges: list[np.ndarray] = []
        of: list[np.ndarray] = []
        step = 0
        while len(live):
            u = ta.uniform(seed[live] + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            e = self.drawn(node[live], u)
            edges.append(e)
            of.append(live)
            node[live] = self.before[e]
            live = live[node[live] > start[live]]
            step += 1
        if not edges:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        edge, which = np.concatenate(edges), np.concatenate(of)
        turn = np.concatenate([np.full(len(o), k) for k, o in enumerate(of)])
        order = np.lexsort((-turn, which))
        ids, which = self.emit[edge[order]], which[order]
        rare = np.flatnonzero(ids >= self.pieces)
        if len(rare):
            spelt = [self.spelt_out[k] for k in (ids[rare] - self.pieces).tolist()]
            size = np.ones(len(ids), np.int64)
            size[rare] = list(map(len, spelt))
            ids, which = np.repeat(ids, size), np.repeat(which, size)
            ids[ids >= self.pieces] = [b for x in spelt for b in x]
        return ids, np.bincount(which, minlength=n).astype(np.int64)

    def drawn(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The first edge whose threshold is above node + u, for each; nodes have few edges."""
        x, e = node + u, self.first[node].astype(np.int64)
        on = np.flatnonzero(self.threshold[e] <= x)
        while len(on):
            e[on] += 1
            on = on[self.threshold[e[on]] <= x[on]]
        return e

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids spell, with the space that encoding puts before a text."""
        return self.piece_bytes[gathered(self.piece_at[ids], self.piece_size[ids])]


_lattices: dict[tuple[str, float], Lattices] = {}


def lattices_of(model: str, alpha: float = ALPHA) -> Lattices:
    """The lattices for a model; a Python worker keeps them from task to task."""
    if (model, alpha) not in _lattices:
        _lattices[model, alpha] = Lattices(model, alpha)
    return _lattices[model, alpha]


def encoded(column: pa.Array, seeds: np.ndarray, lattices: Lattices) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids end to end, ids per text) for a few texts at a time."""
    for first, plain in ta.pieces(column):
        full = np.diff(plain.offsets) > 0
        # A space before each text, as the vocabulary's normalizer puts it.
        shift = np.concatenate([[0], np.cumsum(full)])
        data = np.full(len(plain.data) + shift[-1], 0x20, np.uint8)
        data[np.arange(len(plain.data)) + np.repeat(shift[1:], np.diff(plain.offsets))] = plain.data
        texts = ta.Texts(data, plain.offsets + shift)
        words = texts.words(lead=True, separators=ONLY_SPACE)
        apart = np.flatnonzero(~lattices.joined[data[:-1], data[1:]]) + 1
        stop = ta.marked(len(data), words.stop, apart)
        begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        words = ta.Words(texts, begin, stop, np.searchsorted(texts.offsets, begin, side="right") - 1, words.table, words.n)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        length = heads[words.stop] - heads[words.start]
        end = lattices.look_up(words)
        place = np.arange(len(words)) - np.searchsorted(words.text, words.text)
        row = seeds[first : first + len(texts)]
        ids, size = lattices.sampled(end, ta.mix(row[words.text] + place.astype(np.uint64)), length)
        yield first, ids, np.bincount(words.text, weights=size, minlength=len(texts)).astype(np.int64)


def decoded_texts(ids: np.ndarray, size: np.ndarray, lattices: Lattices) -> list[bytes]:
    """The texts that the ids of each spell."""
    raw = lattices.decoded(ids)
    ends = np.concatenate([[0], np.cumsum(lattices.piece_size[ids])])
    stop = np.cumsum(size)
    return [raw[ends[b - n] : ends[b]].tobytes()[1:] if n else b"" for b, n in zip(stop.tolist(), size.tolist(), strict=True)]


def row_seeds(column: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit seed for each row from its key; a null key has one that follows from no number."""
    keys = ta.mix(np.array([0 if v is None else v for v in column.to_pylist()], np.int64).view(np.uint64) + ta.mix(np.array([seed], np.uint64)))
    none = np.array([v is None for v in column.to_pylist()], bool)
    return np.where(none, ta.mix(keys + NO_KEY), keys)


def _encode(model: str, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model, alpha)
        for batch in batches:
            for first, ids, size in encoded(batch.column(1), row_seeds(batch.column(0), seed), lattices):
                offsets = np.concatenate([[0], np.cumsum(size)])
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(size)), column], ["doc_id", "ids"])

    return run


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model)
        for batch in batches:
            column = batch.column(1)
            size = np.array([len(v) if v.is_valid else 0 for v in column], np.int64)
            texts = decoded_texts(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), size, lattices)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())], ["doc_id", "text"])

    return run


def sampled_pieces(docs: DataFrame, model: str, seed: int = 0, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, a sampled segmentation, for each row."""
    return in_arrow(own(docs, id_col, text_col), _encode(model, alpha, seed), "doc_id long, ids array<int>")


def decoded_pieces(encoded_docs: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for each row of doc_id and ids."""
    return in_arrow(own(encoded_docs, id_col, ids_col), _decode(model), "doc_id long, text string")
