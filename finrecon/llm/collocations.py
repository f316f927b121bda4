"""Phrases whose words stand together more often than their parts, by depth-truncated suffix trees built apart for groups of prefixes.

A suffix is the words from one place of a piece on, at most ``words`` of them. As in vertical partitioning of suffix trees that do not fit into memory:

1. Prefixes of one word are counted. A prefix of more than the budget of occurrences is extended by a word, and its extensions are counted, until all fit or are whole suffixes: first by cells of their hash, then
   one by one in the cells that exceed the budget.
2. Prefixes are dealt into groups of about the budget, cell after cell until a group is full.
3. Each group's subtree is built on its own. A map task sends a group one block for every few texts, a subtree of their suffixes in which equal suffixes are one leaf with a count; the
   group's task merges its blocks into one sorted run of leaves. A node's count is the total of its leaves.

A suffix ends before a word that occurs fewer than ``least`` times, since no counted phrase holds it. Such words are told by a bit filter of at most 2^``FILTER_BITS`` bits: a rare word that it
lets through costs a leaf and changes no count. The budget is ``BUDGET`` occurrences, less for a corpus that would give fewer than ``LEAST_GROUPS`` groups, and grows with the corpus once that would need more than ``MOST_GROUPS``, so the prefixes above the budget and the cells, which the driver sees, are
bounded by it. Words go by 64-bit hashes of language and word; all distinct words are compared in the first step, and should two share a hash, mining starts anew with another key, so counts are exact.

Defined cases: a null or empty text has no words; a null language is ``und``, as one named so; repeated rows count each; other columns are not read; an empty table or a language without
candidates gives no rows. A word or piece of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from finrecon.llm import textarrays as ta
from finrecon.llm.frames import Scratch, in_arrow, own
from finrecon.llm.tokens import first_of, gathered

BUDGET, LEAST_GROUPS, MOST_GROUPS, FILTER_BITS = 500_000, 256, 1_000_000, 26
#: Bytes of text whose suffixes are one block for each group.
AT_ONCE = 2 * ta.PIECE_BYTES
NO_LANG = "und"
#: Ranked rows of a language are sought in so many shares first, as a language may hold most phrases.
SHARES = 64

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True


@dataclass
class Suffixes:
    """Words of texts in order: hash, whether a piece begins, and the spans of their bytes."""

    hashes: np.ndarray
    begins: np.ndarray
    words: ta.Words


def suffixes(texts: ta.Texts, langs: np.ndarray, key: int) -> Suffixes:
    """The words of the texts' pieces; langs holds a number for each text. Hashes are never 0, which stands for no word."""
    words = texts.words(fold=True, separators=_BLANK | _BREAK)
    piece = np.cumsum(_BREAK[texts.data], dtype=np.int64)[words.start] if len(words) else np.zeros(0, np.int64)
    begins = np.ones(len(words), bool)
    begins[1:] = (words.text[1:] != words.text[:-1]) | (piece[1:] != piece[:-1])
    h = ta.mix(words.hashes(key) ^ langs[words.text])
    return Suffixes(np.where(h == 0, np.uint64(1), h), begins, words)


def _lang_numbers(column: pa.Array, key: int) -> np.ndarray:
    names = column.dictionary_encode()
    of = [int.from_bytes(blake2b((n or "").encode(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little") for n in names.dictionary.to_pylist()]
    return np.array(of, np.uint64)[names.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(column) else np.zeros(0, np.uint64)


def _word_counts(key: int) -> Callable:
    """(h, lang, word, n) of the distinct words of a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _lang_numbers(batch.column(0), key)
            for first, texts in ta.pieces(batch.column(1), AT_ONCE):
                s = suffixes(texts, numbers[first : first + len(texts)], key)
                which, distinct = pd.factorize(s.hashes)
                if not len(distinct):
                    continue
                at = first_of(which, len(distinct))
                size = s.words.stop[at] - s.words.start[at]
                spelt = s.words.table[texts.data[gathered(s.words.start[at], size)]]
                word = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(spelt))).cast(pa.string())
                lang = batch.column(0).take(pa.array(first + s.words.text[at]))
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), lang, word, pa.array(np.bincount(which))], ["h", "lang", "word", "n"])

    return run


@dataclass
class Plan:
    """What a map task needs to find a suffix's group: the filter of frequent words, the prefixes above the budget by their length, and the group of each cell."""

    words: int
    key: int
    filter: np.ndarray
    heavy: list[np.ndarray] = field(default_factory=list)
    group_of: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))

    def frequent(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(len(self.filter) * 8 - 1)
        return (self.filter[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def prefixes(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, words) of the prefix of each suffix: as many words as it takes to stay in the budget."""
        p, n = columns[0].copy(), np.ones(len(columns[0]), np.int64)
        for k, heavy in enumerate(self.heavy[: len(columns) - 1], 1):
            at = np.flatnonzero((n == k) & _among(p, heavy))
            p[at] = joined(p[at], columns[k][at])
            n[at] += 1
        return p, n

    def cells(self, p: np.ndarray) -> np.ndarray:
        return cell_of(p, len(self.group_of))


def joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a prefix with one more word."""
    return ta.mix(prefix * np.uint64(0xD6E8FEB86659FD93) + word)


def cell_of(p: np.ndarray, cells: int) -> np.ndarray:
    return (p >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64) if cells > 1 else np.zeros(len(p), np.int64)


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _columns(batch: pa.RecordBatch, plan: Plan) -> Iterator[list[np.ndarray]]:
    """The words of all suffixes of a few texts at a time (0 after the end): hash columns, one for each depth."""
    numbers = _lang_numbers(batch.column(0), plan.key)
    for first, texts in ta.pieces(batch.column(1), AT_ONCE):
        s = suffixes(texts, numbers[first : first + len(texts)], plan.key)
        h, good = s.hashes, plan.frequent(s.hashes)
        start = np.flatnonzero(good)
        out, live = [h[start]], np.ones(len(start), bool)
        for k in range(1, plan.words):
            at = np.minimum(start + k, len(h) - 1)
            live = live & (start + k < len(h)) & ~s.begins[at] & good[at]
            out.append(np.where(live, h[at], np.uint64(0)))
        yield out


def leaves(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal suffixes as one leaf: their columns in the order of the tree, and the sum of their counts (1 each without counts)."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    code, distinct = pd.factorize(np.concatenate(columns))
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(distinct)] = np.arange(len(distinct))
    code = rank[code].reshape(len(columns), -1)
    bits = max(int(len(distinct) - 1).bit_length(), 1)
    if bits * len(columns) <= 63:
        whole = code[0]
        for c in code[1:]:
            whole = whole << bits | c
        which, distinct = pd.factorize(whole)
        order = np.argsort(distinct)
    else:
        which = np.zeros(code.shape[1], np.int64)
        for c in code:
            which = pd.factorize(which * len(rank) + c)[0]
        first = first_of(which, which.max() + 1)
        order = np.lexsort(code[::-1, first])
    at = first_of(which, len(order))[order]
    n = np.bincount(which, minlength=len(order)) if counts is None else _sums(which, counts, len(order))
    return [c[at] for c in columns], n[order].astype(np.int64)


def _sums(which: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, which, counts)
    return out


def nodes(columns: list[np.ndarray], counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first leaf, count) of each node of that depth in a sorted run of leaves; leaves that end before it have none."""
    deep = np.flatnonzero(columns[depth - 1] != 0)
    if not len(deep):
        return deep, deep
    new = np.zeros(len(deep), bool)
    new[0] = True
    for c in columns[:depth]:
        new[1:] |= c[deep[1:]] != c[deep[:-1]]
    begin = np.flatnonzero(new)
    return deep[begin], np.add.reduceat(counts[deep], begin)


def packed(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """A subtree as bytes: for each depth the words of its nodes and their numbers of children, then the leaves' counts. columns are sorted, leaves distinct."""
    new = np.ones(len(counts), bool)
    out, before = [len(columns).to_bytes(4, "little")], np.zeros(0, np.int64)
    for k, c in enumerate(columns):
        if k == len(columns) - 1:
            new = np.ones(len(counts), bool)
        else:
            step = np.ones(len(counts), bool)
            step[1:] = c[1:] != c[:-1]
            new = step if k == 0 else new | step
        at = np.flatnonzero(new)
        if k:
            out.append(np.diff(np.searchsorted(at, np.append(before, len(counts)))).astype("<u4").tobytes())
        out.append(len(at).to_bytes(4, "little") + c[at].astype("<u8").tobytes())
        before = at
    return b"".join([*out, counts.astype("<u8").tobytes()])


def unpacked(block: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    depth, at, columns = int.from_bytes(block[:4], "little"), 4, []
    for k in range(depth):
        if k:
            children = np.frombuffer(block, "<u4", len(columns[-1]) if k == 1 else n, at)
            at += 4 * len(children)
            columns = [np.repeat(c, children) for c in columns]
        n = int.from_bytes(block[at : at + 4], "little")
        columns.append(np.frombuffer(block, "<u8", n, at + 4))
        at += 4 + 8 * n
    return columns, np.frombuffer(block, "<u8", len(columns[0]), at).astype(np.int64)


def _blocks(plan: Plan) -> Callable:
    """(group, block): the suffixes of a few texts as one subtree for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, counts in (leaves(c) for batch in batches for c in _columns(batch, plan)):
            if not len(counts):
                continue
            group = plan.group_of[plan.cells(plan.prefixes(columns)[0])]
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
            blocks = [packed([c[order[a:b]] for c in columns], counts[order[a:b]]) for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group[order[cuts]], pa.int32()), pa.array(blocks, pa.binary())], ["group", "block"])

    return run


def _trees(plan: Plan, least: int) -> Callable:
    """(words, n) of the nodes of two words or more with a count of at least least, from blocks in order of group; nodes above a prefix belong to no group."""

    def built(blocks: list[bytes]) -> pa.RecordBatch:
        parts = [unpacked(b) for b in blocks]
        columns, counts = leaves([np.concatenate([c[k] for c, _ in parts]) for k in range(plan.words)], np.concatenate([n for _, n in parts]))
        _, own_depth = plan.prefixes(columns)
        rows, sizes, n = [], [], []
        for depth in range(2, plan.words + 1):
            at, total = nodes(columns, counts, depth)
            keep = (total >= least) & (own_depth[at] <= depth)
            rows.append(np.stack([c[at[keep]] for c in columns[:depth]], axis=1).reshape(-1))
            sizes.append(np.full(keep.sum(), depth))
            n.append(total[keep])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows).view(np.int64)))
        return pa.RecordBatch.from_arrays([words, pa.array(np.concatenate(n).astype(np.int64))], ["words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for g, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if g != group and held:
                    yield built(held)
                    held = []
                group = g
                held.append(block.as_py())
        if held:
            yield built(held)

    return run


def _extensions(plan: Plan, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, hash, cell) of the extensions, by one word, of the longest prefixes above the budget."""
    p, n = plan.prefixes(columns)
    at = np.flatnonzero(n == len(plan.heavy) + 1)
    return at, p[at], plan.cells(p[at])


def _cell_loads(plan: Plan) -> Callable:
    """(cell, n): occurrences of extensions by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            load = np.zeros(len(plan.group_of), np.int64)
            for columns in _columns(batch, plan):
                load += np.bincount(_extensions(plan, columns)[2], minlength=len(load))
            at = np.flatnonzero(load)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(load[at])], ["cell", "n"])

    return run


def _prefix_counts(plan: Plan, open_: np.ndarray) -> Callable:
    """(p, words, n) of the extensions that lie in the open cells."""
    depth = len(plan.heavy) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in (c for batch in batches for c in _columns(batch, plan)):
            at, p, cell = _extensions(plan, columns)
            within = _among(cell, open_)
            if within.any():
                which, distinct = pd.factorize(p[within])
                first = at[within][first_of(which, len(distinct))]
                words = pa.FixedSizeListArray.from_arrays(pa.array(np.stack([c[first] for c in columns[:depth]], axis=1).reshape(-1).view(np.int64)), depth).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), words, pa.array(np.bincount(which))], ["p", "words", "n"])

    return run


def _frequent_filter(words: DataFrame, least: int) -> np.ndarray:
    """One bit for each hash of a frequent word, at most 2^FILTER_BITS bits, 8 MB."""
    frequent = words.where(F.col("n") >= least)
    bits = min(max((8 * frequent.count()).bit_length(), 16), FILTER_BITS)
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    parts = frequent.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(1 << bits >> 3, np.uint8)
    # Place x is bit (x - 1) of part 1 + (x - 1) / 32768, and place 0 of part 0.
    for r in parts.collect():
        at = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))
        first = (r["part"] - 1) * 32768 + 1 if r["part"] > 0 else 0
        spot = at + first if r["part"] > 0 else np.zeros(min(len(at), 1), np.int64)
        np.bitwise_or.at(out, spot >> 3, np.uint8(1) << (spot & 7).astype(np.uint8))
    return out


def planned(texts: DataFrame, words: DataFrame, scratch: Scratch, key: int, depth: int, least: int, budget: int) -> tuple[Plan, list[DataFrame]]:
    """The groups of prefixes, and for each length the table (words, n) of the prefixes above the budget."""
    plan = Plan(depth, key, _frequent_filter(words, least))
    frequent = words.where(F.col("n") >= least)
    total = frequent.agg(F.sum("n")).first()[0] or 0
    budget = max(min(budget, -(-total // LEAST_GROUPS)), -(-total // MOST_GROUPS), 1)
    cells = min(1 << max(4 * -(-total // budget) - 1, 255).bit_length(), 1 << 20)
    plan.group_of = np.zeros(cells, np.int32)
    # Prefixes above the budget are at most total / budget, so at most MOST_GROUPS; loads have a row for each cell.
    counted, upper = frequent.select(F.col("h").alias("p"), F.array("h").alias("words"), "n"), []
    heavy = counted.where(F.col("n") > budget)
    cell = F.shiftrightunsigned("p", 64 - cells.bit_length() + 1).alias("cell")
    load = _loads(counted.where(F.col("n") <= budget).groupBy(cell).agg(F.sum("n").alias("n")), cells)
    while len(plan.heavy) < depth - 1:
        found = heavy.select("p", "n").collect()
        if not found:
            break
        upper.append(heavy.select("words", "n"))
        plan.heavy.append(np.sort(np.array([r["p"] for r in found], np.int64).view(np.uint64)))
        own_load = _loads(in_arrow(texts, _cell_loads(plan), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), cells)
        load += own_load
        # A prefix above the budget can only lie in a cell above it.
        open_ = np.flatnonzero(own_load > budget)
        if len(plan.heavy) == depth - 1 or not len(open_):
            break
        counted = in_arrow(texts, _prefix_counts(plan, open_), "p long, words array<long>, n long").groupBy("p").agg(F.first("words").alias("words"), F.sum("n").alias("n"))
        heavy = scratch.kept(counted.where(F.col("n") > budget))
        for r in heavy.select("p", "n").collect():
            load[cell_of(np.array([r["p"]], np.int64).view(np.uint64), cells)] -= r["n"]
    before = np.cumsum(load) - load
    plan.group_of = (before // budget).astype(np.int32)
    return plan, upper


def _loads(counts: DataFrame, cells: int) -> np.ndarray:
    out, table = np.zeros(cells, np.int64), counts.toArrow()
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out


def phrase_counts(docs: DataFrame, scratch: Scratch, words: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(all words: h, lang, word, n; phrases of one to words words with a count of at least least: words as hashes, n)."""
    texts = own(docs, lang_col, text_col).toDF("lang", "text").withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)))
    key = 0
    while True:
        found = in_arrow(texts, _word_counts(key), "h long, lang string, word string, n long")
        known = scratch.kept(found.groupBy("h", "lang", "word").agg(F.sum("n").alias("n")))
        if known.groupBy("h").count().where("count > 1").isEmpty():
            break
        scratch.done(known)
        key += 1
    plan, upper = planned(texts, known, scratch, key, words, least, budget)
    # The write that feeds the groups is a shuffle by group; blocks of a group arrive in order of group, so a task holds one group.
    dealt = in_arrow(texts, _blocks(plan), "group int, block binary").repartition("group").sortWithinPartitions("group")
    counts = in_arrow(dealt, _trees(plan, least), "words array<long>, n long")
    for table in [known.where(F.col("n") >= least).select(F.array("h").alias("words"), "n"), *(u.where((F.size("words") > 1) & (F.element_at("words", -1) != 0)) for u in upper[1:])]:
        counts = counts.unionByName(table)
    return known, scratch.kept(counts)


def collocations(docs: DataFrame, words: int = 3, least: int = 10, covered: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first top phrases of two to words words with a count a of at least least.

    score is the least over the cuts into two parts of floor(1000000 a a / (l r)), with l and r the counts of the parts (ties go to the first cut), exact in decimals.
    A phrase inside a longer one with at least covered percent of its count is left out. n is the number of words of the language."""
    scratch = Scratch(docs.sparkSession, "collocations")
    known, counts = phrase_counts(docs, scratch, words, least, lang_col, text_col, budget)
    phrases = counts.where(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = phrases.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    left, right = (counts.select(F.col("words").alias(f"{x}_words"), F.col("n").alias(x)) for x in "lr")
    cuts = cuts.join(left, F.slice("words", F.lit(1), F.col("k")) == F.col("l_words")).join(right, F.slice("words", F.col("k") + 1, F.size("words")) == F.col("r_words"))
    wide = {c: f"cast({c} as decimal(14,0))" for c in "alr"}
    cuts = cuts.withColumn("score", F.expr(f"({wide['a']} * {wide['a']} * cast(1000000 as decimal(7,0))) div ({wide['l']} * {wide['r']})"))
    scored = cuts.groupBy("words").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("best")).select("words", "best.*")
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.size("words")), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k)))),
        lambda p: F.size(p) < F.size("words"),
    )
    longest = phrases.where(F.size("words") > 2).select(F.explode(inner).alias("words"), "a").groupBy("words").agg(F.max("a").alias("longer"))
    open_ = scored.join(longest, "words", "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    spelt = open_.select("*", F.posexplode("words").alias("i", "h")).join(known.select("h", "lang", "word"), "h")
    spelt = spelt.groupBy("words", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("ws"), F.first("lang").alias("lang"))
    named = spelt.select("lang", F.concat_ws(" ", F.col("ws.word")).alias("phrase"), "a", "l", "r", "score")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    share = named.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    # One row for each language.
    sizes = known.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
