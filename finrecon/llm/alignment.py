"""Alignment of two tokenizers over the same texts, with the number of documents in which each pair of their tokens is linked.

A is a byte-level BPE vocabulary, B a piece vocabulary with byte fallback that puts a space before a text; both spell the bytes of a space and the text. Tokens of A and B that share a byte are linked; bytes at which tokens of
both end cut a text into groups.

Documents per pair come from an inverted index of bitmaps. Documents are numbered, 65,536 numbers to a block. A map task gives, for each pair and block, a compressed bitmap of the documents that have the pair
(16-bit places, or plain bits where these are shorter) and, where a document has the pair several times, planes: bitmap k holds the documents of whose further links bit k is set. Bitmaps of one pair and block are OR-merged and
popcounted; documents and links of a pair are sums over blocks. For the way back, postings go by block: each adds its pair's count to the documents in it, so no row per document and pair is ever shuffled, a pair that is in every document is one row for each block, and a task holds one block of sums.

Both tokenizers join no bytes over certain places (where the pre-tokenizer of A cuts and no piece of B holds the two bytes side by side), so texts are cut there into chunks; ids, groups and links of each distinct chunk are
computed once per worker by the vocabularies' own libraries, and bytes are compared as in ``tokens``.

Defined cases: null and empty texts, and those that either vocabulary does not spell exactly (B does not tell its space mark U+2581 from a space), have no tokens; strings of special tokens are plain text; repeated rows count as documents each; other columns are not read; an
empty table gives an empty result. A text of any length is taken whole. Ids of documents may be of any type and repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from finrecon.llm import textarrays as ta
from finrecon.llm.frames import Scratch, in_arrow, own
from finrecon.llm.tokens import AT_ONCE, KnownBytes, byte_level, chunks, first_of, gathered

BLOCK_BITS = 16
STORED, FLUSH_LINKS = 1 << 19, 3_000_000
#: The table of counts is sent to all tasks up to so many pairs, some 20 bytes each.
BROADCAST_PAIRS = 1_000_000
MARK = "▁"


def _spelt_a(path: str) -> list[bytes]:
    """The bytes of each entry of a byte-level vocabulary: its characters stand for bytes, printable ones for themselves, others in order from U+0100 on."""
    from tokenizers import Tokenizer

    own_ = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own_} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own_))}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocabulary.values()) + 1)
    for name, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in name)
    return out


class Table:
    """Byte strings by number, end to end."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array(list(map(len, strings)), np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[gathered(self.at[ids], self.size[ids])]


class Aligner:
    """Ids, groups and links of distinct chunks; a worker keeps it from task to task."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = byte_level(a_path)
        self.a_bytes = Table(_spelt_a(a_path))
        self.b = p = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = p.get_piece_size()
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        spelt = [b""] * n
        for i in plain:
            spelt[i] = p.id_to_piece(i).replace(MARK, " ").encode()
        self.line_end = p.piece_to_id("<0x0A>")
        for b in range(256):
            spelt[p.piece_to_id(f"<0x{b:02X}>")] = bytes([b])
        self.b_bytes = Table(spelt)
        #: Whether a piece holds two bytes side by side.
        self.side = np.zeros((256, 256), bool)
        for i in plain:
            raw = np.frombuffer(spelt[i], np.uint8)
            self.side[raw[:-1], raw[1:]] = True
        if self.side[10].any() or self.side[:, 10].any():
            raise ValueError("a piece vocabulary with line ends inside pieces")
        #: Decimal numbers of ids with room for a mark after them.
        self.digits = Table([str(i).encode() + b"," for i in range(max(len(self.a_bytes.size), n))])
        self.key = 0
        self.clear()

    def clear(self) -> None:
        self.keys, self.known = np.zeros(0, np.uint64), KnownBytes()
        self.good = np.zeros(0, bool)
        self.n_a, self.n_b, self.n_groups = (np.zeros(0, np.int64) for _ in range(3))
        self.link_at, self.link_n, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.text_at, self.text_n, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def chunks(self, texts: ta.Texts) -> ta.Words:
        """Parts of the texts over whose ends neither vocabulary joins bytes."""
        found = chunks(texts)
        stop, data = found.stop, texts.data
        end = np.zeros(len(data) + 1, bool)
        end[texts.offsets] = True
        after = np.minimum(stop, len(data) - 1)
        stop = stop[end[stop] | (((data[after] & 0xC0) != 0x80) & ~self.side[data[stop - 1], data[after]])]
        start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        return ta.Words(texts, start, stop, np.searchsorted(texts.offsets, start, side="right") - 1, found.table, found.n)

    def look_up(self, found: ta.Words) -> np.ndarray:
        """The store's row of each chunk; the chunks cover their texts."""
        while True:
            which, distinct = pd.factorize(found.hashes(self.key))
            if len(self.keys) + len(distinct) > STORED:
                self.clear()
            place = np.searchsorted(self.keys, distinct)
            new = np.ones(len(distinct), bool)
            there = place < len(self.keys)
            new[there] = self.keys[place[there]] != distinct[there]
            if new.any():
                fresh = np.flatnonzero(new)
                fresh = fresh[np.argsort(distinct[fresh])]
                first = first_of(which, len(distinct))[fresh]
                self.add(place[fresh], [found.bytes_of(i) for i in first.tolist()])
                self.keys = np.insert(self.keys, place[fresh], distinct[fresh])
                self.known.add(place[fresh], first, found)
                place = np.searchsorted(self.keys, distinct)
            row = place[which]
            if self.known.equal(row, found):
                return row
            self.key += 1
            self.clear()

    def b_ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of B end to end and per part. A line end, which no piece holds, is put before each part, so the space that B puts before a text joins nothing."""
        texts = [c.decode("utf-8", "replace") for c in parts]
        lone = [i for i, t in enumerate(texts) if "\n" in t]
        plain = [i for i, t in enumerate(texts) if "\n" not in t]
        size, own_ = np.zeros(len(parts), np.int64), [np.zeros(0, np.int64)] * len(parts)
        for k in range(0, len(plain), AT_ONCE):
            few = plain[k : k + AT_ONCE]
            ids = np.array(self.b.encode("".join("\n" + texts[i] for i in few)), np.int64)[1:]
            cuts = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            for i, a, b in zip(few, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own_[i] = ids[a + 1 : b]
        for i, ids in zip(lone, self.b.encode(["\n" + texts[i] for i in lone], num_threads=1), strict=True):
            own_[i] = np.array(ids[2:], np.int64)
        size[:] = list(map(len, own_))
        return np.concatenate(own_), size

    def add(self, rows: np.ndarray, parts: list[bytes]) -> None:
        size = np.array(list(map(len, parts)), np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        stop = np.cumsum(size)
        got = [self.a(parts[k : k + AT_ONCE]) for k in range(0, len(parts), AT_ONCE)]
        a, n_a = np.concatenate([x for x, _ in got]).astype(np.int64), np.concatenate([x for _, x in got])
        b, n_b = self.b_ids(parts)
        good = np.ones(len(parts), bool)
        for ids, n, table in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            of = np.repeat(np.arange(len(parts)), n)
            length = np.bincount(of, weights=table.size[ids], minlength=len(parts)).astype(np.int64)
            good &= length == size
            even = length == size
            spelt = table.joined(ids[even[of]])
            wrong = np.repeat(np.flatnonzero(even), size[even])[spelt != data[np.repeat(even, size)]]
            good[wrong] = False
        # Chunks that are not spelt exactly keep no tokens; the rest lie end to end in both vocabularies.
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b, length = n_a * good, n_b * good, np.where(good, size, 0)
        stop = np.cumsum(length)
        end_a, end_b = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        total = int(stop[-1]) if len(stop) else 0
        at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        at_a[end_a], at_b[end_b] = True, True
        either, both = np.flatnonzero(at_a | at_b), np.flatnonzero(at_a & at_b)
        # Between two ends of either lies the share of one token of A and one of B.
        links = (a[np.searchsorted(end_a, either)] << 16 | b[np.searchsorted(end_b, either)]).astype(np.uint32)
        n_links = np.diff(np.searchsorted(either, stop, side="right"), prepend=0)
        n_groups = np.diff(np.searchsorted(both, stop, side="right"), prepend=0)
        text, n_text = self.group_text(a, b, end_a, end_b, both, stop)
        self.good, self.n_a, self.n_b, self.n_groups = (np.insert(old, rows, new) for old, new in ((self.good, good), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)))
        self.link_at, self.link_n = np.insert(self.link_at, rows, len(self.links) + np.cumsum(n_links) - n_links), np.insert(self.link_n, rows, n_links)
        self.text_at, self.text_n = np.insert(self.text_at, rows, len(self.text) + np.cumsum(n_text) - n_text), np.insert(self.text_n, rows, n_text)
        self.links, self.text = np.concatenate([self.links, links]), np.concatenate([self.text, text])

    def group_text(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, both: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a1,a2|b1; of all groups as bytes, and the bytes per chunk."""
        group = np.concatenate([np.searchsorted(both, end_a), np.searchsorted(both, end_b)])
        of_b = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((np.arange(len(group)), of_b, group))
        ids, group, of_b = np.concatenate([a, b])[order], group[order], of_b[order]
        size = self.digits.size[ids]
        out = self.digits.joined(ids)
        end = np.cumsum(size)
        last = np.ones(len(ids), bool)
        last[:-1] = (group[1:] != group[:-1]) | (of_b[1:] != of_b[:-1])
        out[end[last & (of_b == 0)] - 1] = ord("|")
        out[end[last & (of_b == 1)] - 1] = ord(";")
        chunk = np.searchsorted(stop, both[group])
        return out, np.bincount(chunk, weights=size, minlength=len(stop)).astype(np.int64)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def led(plain: ta.Texts) -> ta.Texts:
    """The texts with a space before each that is not empty."""
    full = np.diff(plain.offsets) > 0
    shift = np.concatenate([[0], np.cumsum(full)])
    data = np.full(len(plain.data) + shift[-1], 0x20, np.uint8)
    data[np.arange(len(plain.data)) + np.repeat(shift[1:], np.diff(plain.offsets))] = plain.data
    return ta.Texts(data, plain.offsets + shift)


# Bitmaps of 16-bit places.


def bitmaps(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(key, places, bitmap) of each key in order; (key, place) are sorted and distinct. A bitmap is its places, or plain bits up to the last place with a byte in front where that is shorter."""
    if not len(key):
        return key, key, []
    cuts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    ends = np.append(cuts[1:], len(key))
    raw = place.astype("<u2").tobytes()
    out = []
    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
        # An even number of bytes is places, an odd one bits.
        bits = (int(place[b - 1]) >> 4) * 2 + 2
        if bits + 1 < 2 * (b - a):
            plane = np.zeros(bits * 8, np.uint8)
            plane[place[a:b]] = 1
            out.append(b"\0" + np.packbits(plane, bitorder="little").tobytes())
        else:
            out.append(raw[2 * a : 2 * b])
    return key[cuts], ends - cuts, out


def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places of a column of bitmaps, in order of row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    sparse, dense = np.flatnonzero(size % 2 == 0), np.flatnonzero(size % 2)
    flat = data[gathered(offsets[sparse], size[sparse])].view("<u2").astype(np.int64)
    rows, found = [np.repeat(sparse, size[sparse] // 2)], [flat]
    for r in dense.tolist():
        at = np.flatnonzero(np.unpackbits(data[offsets[r] + 1 : offsets[r + 1]], bitorder="little"))
        rows.append(np.full(len(at), r))
        found.append(at)
    rows, found = np.concatenate(rows), np.concatenate(found)
    if len(dense):
        order = np.argsort(rows, kind="stable")
        rows, found = rows[order], found[order]
    return rows, found


#: Rows of the index: kind -1 documents, k >= 0 plane k.
INDEX = "pair long, block long, plane int, bits binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
DOCS = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _indexed(pair: np.ndarray, number: np.ndarray, many: np.ndarray) -> Iterator[tuple]:
    """Columns (pair, block, plane, bits) for occurrences: pair and document (sorted, distinct) with the number of links."""
    block = number >> BLOCK_BITS
    top = int((many - 1).max()).bit_length() if len(many) else 0
    low = int(block.min()) if len(block) else 0
    wide = int(block.max()) - low + 1 if len(block) else 1
    for plane in range(-1, top):
        own_ = np.ones(len(pair), bool) if plane < 0 else ((many - 1) >> plane) & 1 > 0
        key = pair[own_] * wide + (block[own_] - low)
        k, _, bits = bitmaps(key, number[own_] & ((1 << BLOCK_BITS) - 1))
        yield k // wide, k % wide + low, np.full(len(k), plane), bits


def _map(a_path: str, b_path: str):
    """From batches of (row, text, id): id with the columns of DOCS and INDEX, of which either is null."""
    docs_, index_ = (pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in part.split(", ")]) for part in (DOCS, INDEX))

    def out(ids: pa.Array, docs: list, index: list) -> pa.RecordBatch:
        n = len(ids)
        columns = [pa.array(docs[k], f.type) if docs else pa.nulls(n, f.type) for k, f in enumerate(docs_)] + [pa.array(index[k], f.type) if index else pa.nulls(n, f.type) for k, f in enumerate(index_)]
        return pa.RecordBatch.from_arrays([ids, *columns], ["id", *docs_.names, *index_.names])

    def index_rows(held: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        pair, number = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        order = np.lexsort((number, pair))
        pair, number = pair[order], number[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (number[1:] != number[:-1])
        at = np.flatnonzero(new)
        for columns in _indexed(pair[at], number[at], np.diff(np.append(at, len(pair)))):
            for k in range(0, len(columns[0]), 50_000):
                few = [c[k : k + 50_000] for c in columns]
                yield out(pa.nulls(len(few[0]), kind), [], few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, kind = [], 0, pa.null()
        aligner = aligner_of(a_path, b_path)
        for batch in batches:
            numbers, kind = batch.column(0).to_numpy(), batch.column(2).type
            for first, plain in ta.pieces(batch.column(1)):
                texts = led(plain)
                found = aligner.chunks(texts)
                row = aligner.look_up(found)
                good = np.bincount(found.text, weights=~aligner.good[row], minlength=len(texts)) == 0
                row, of = row[good[found.text]], found.text[good[found.text]]
                sums = [np.bincount(of, weights=c[row], minlength=len(texts)).astype(np.int64) for c in (aligner.n_a, aligner.n_b, aligner.n_groups, aligner.link_n, aligner.text_n)]
                text = aligner.text[gathered(aligner.text_at[row], aligner.text_n[row])]
                digests = [hashlib.sha256(text[b - n : b - 1]).hexdigest() if n else "" for b, n in zip(np.cumsum(sums[4]).tolist(), sums[4].tolist(), strict=True)]
                own_ = numbers[first : first + len(texts)]
                links = aligner.links[gathered(aligner.link_at[row], aligner.link_n[row])].astype(np.int64)
                held.append((links, np.repeat(own_[of], aligner.link_n[row])))
                n_held += len(links)
                yield out(batch.column(2).slice(first, len(texts)), [own_, *sums[:4], digests], [])
                if n_held > FLUSH_LINKS:
                    yield from index_rows(held, kind)
                    held, n_held = [], 0
        if n_held:
            yield from index_rows(held, kind)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of one (pair, block, plane), which lie side by side, OR-merged, with their number of documents. The last key of a batch waits for the next one."""
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table]).combine_chunks()
        keys = [table.column(k).to_numpy() for k in range(3)]
        last = len(keys[0])
        while last and all(k[last - 1] == k[-1] for k in keys):
            last -= 1
        waiting = table.slice(last)
        if last:
            yield _ored(table.slice(0, last), [k[:last] for k in keys])
    if waiting is not None and len(waiting):
        yield _ored(waiting, [waiting.column(k).to_numpy() for k in range(3)])


def _ored(table: pa.Table, keys: list[np.ndarray]) -> pa.RecordBatch:
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    row, place = places(table.column(3))
    both = np.unique(group[row] << BLOCK_BITS | place)
    _, n, bits = bitmaps(both >> BLOCK_BITS, both & ((1 << BLOCK_BITS) - 1))
    return pa.RecordBatch.from_arrays([*(pa.array(k[first]) for k in keys), pa.array(bits, pa.binary()), pa.array(n)], ["pair", "block", "plane", "bits", "n"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_best, count_sum) of the documents of each block, from its postings (block, plane, bits, docs, best), which lie side by side."""
    block, best, total, seen = None, None, None, None

    def out() -> pa.RecordBatch:
        at = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array((block << BLOCK_BITS) + at), pa.array(best[at]), pa.array(total[at])], ["row", "n_best", "count_sum"])

    for batch in batches:
        blocks, plane, docs, is_best = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
        row, place = places(batch.column(2))
        cuts = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1)) if len(blocks) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(blocks)).tolist(), strict=True):
            if block is None or blocks[a] != block:
                if block is not None:
                    yield out()
                block, best, total, seen = int(blocks[a]), np.zeros(1 << BLOCK_BITS, np.int64), np.zeros(1 << BLOCK_BITS, np.int64), np.zeros(1 << BLOCK_BITS, bool)
            low, high = np.searchsorted(row, [a, b])
            r, p = row[low:high], place[low:high]
            links = np.int64(1) << np.maximum(plane[r].astype(np.int64), 0)
            np.add.at(total, p, links * docs[r])
            np.add.at(best, p, links * is_best[r])
            seen[p] = True
    if block is not None:
        yield out()


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, docs, links, best (whether docs is the highest of a) of each pair of the merged index."""
    further = F.when(F.col("plane") >= 0, F.expr("n << plane")).otherwise(F.col("n"))
    counts = index.groupBy("pair").agg(F.sum(F.when(F.col("plane") < 0, F.col("n"))).alias("docs"), F.sum(further).alias("links"))
    counts = counts.select("pair", F.shiftright("pair", 16).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("b"), "docs", "links")
    # Pairs are bounded by the vocabularies' sizes, whatever the corpus.
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(highest, "a").select("pair", "a", "b", "docs", "links", (F.col("docs") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; pairs: a, b, docs, links, best)."""
    scratch = Scratch(docs.sparkSession, "alignment")
    # Rows are numbered and their ids stored, so that every later step sees the same numbers.
    numbered = own(docs, id_col, text_col).toDF("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    kind = numbered.schema["doc_id"].dataType.simpleString()
    both = scratch.kept(in_arrow(numbered.select("row", "text", F.col("doc_id").alias("id")), _map(a_path, b_path), f"id {kind}, {DOCS}, {INDEX}"))
    index = both.where("pair is not null").select("pair", "block", "plane", "bits")
    dealt = index.repartition("pair", "block").sortWithinPartitions("pair", "block", "plane")
    merged = scratch.kept(in_arrow(dealt, _merged, INDEX + ", n long"))
    pairs = scratch.kept(pair_counts(merged))
    sent = F.broadcast if pairs.count() <= BROADCAST_PAIRS else (lambda df: df)
    postings = merged.join(sent(pairs.select("pair", "docs", "best")), "pair").select("block", "plane", "bits", "docs", F.col("best").cast("long").alias("best"))
    sums = in_arrow(postings.repartition("block").sortWithinPartitions("block"), _scores, "row long, n_best long, count_sum long")
    rows = both.where("pair is null").select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    found = rows.join(sums, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256"), pairs.drop("pair")
