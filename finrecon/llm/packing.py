"""Packing of documents into sequences of a fixed number of tokens by cutting-stock column generation.

Each text becomes the ids of the vocabulary's own tokenizer, added tokens included, with an end id after them. A document longer than a sequence is cut every ``capacity`` ids; only its last piece is
shorter. The exact histogram of piece lengths, at most ``capacity`` rows however many documents there are, goes to the driver, where column
generation finds patterns of lengths and how often each is used. Pieces of one length are ranked by a salted count:
the number of pieces of each (length, salt) gives every salt its first rank, and pieces are numbered within their salt. So one length may hold any
share of the pieces. The pieces that no full pattern takes are laid end to end and cut where a sequence is full; the last sequence is cut into powers of two, which need no padding.
A rank range of a length belongs to one pattern, or to one stretch of those laid end to end, which gives the sequence and the offset in it.

Defined cases: null and empty texts are one piece with the end id; equal ids (repeated rows) are packed as documents of their own;
a null document id is kept; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.llm import tokens
from finrecon.llm.cuttingstock import Pattern, cutting_stock, powers_of_two
from finrecon.llm.frames import in_arrow, kept, own

SALTS, PIECES_PER_SALT = 64, 100_000
#: Up to so many cut pieces (some 100 bytes each) are sent to all tasks.
BROADCAST_ROWS = 200_000
RESULT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = tokens.store_of(path, added=True)
        for batch in batches:
            for first, ids, size in tokens.encoded(batch.column(1), store):
                ends = np.cumsum(size)
                rows: list[list[int]] = [[], [], [], [], []]
                for i, (stop, n) in enumerate(zip(ends.tolist(), size.tolist(), strict=True)):
                    own_ids = np.append(ids[stop - n : stop], np.uint32(end_id)).astype("<u4")
                    for start in range(0, n + 1, capacity):
                        part = own_ids[start : start + capacity]
                        for column, value in zip(rows, (first + i, start, len(part), zlib.crc32(part.tobytes()), n + 1), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(r, pa.int64()) for r in rows[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _slots(plan: list[tuple[Pattern, int]], rest: dict[int, int]) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]], int]:
    """Rows (length, first rank, rank after, copies in a sequence, first sequence, offset of the first copy) of the patterns,
    rows (length, first rank, rank after, place of the first) of the pieces laid end to end, and the number of sequences of the patterns."""
    whole, ranks, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            first = ranks.get(n, 0)
            whole.append((n, first, first + k * times, k, sequence, offset))
            ranks[n] = first + k * times
            offset += n * k
        sequence += times
    laid, at = [], 0
    for n, k in sorted(rest.items()):
        laid.append((n, ranks.get(n, 0), ranks.get(n, 0) + k, at))
        at += n * k
    return whole, laid, sequence


def _laid(pieces: DataFrame, total: int, first_sequence: int, capacity: int) -> DataFrame:
    """The parts (skip, take, sequence_id, offset) of pieces at their place in one line of total ids, cut where a sequence is full."""
    full = total // capacity
    begins = [0]
    for n in powers_of_two(total % capacity):
        begins.append(begins[-1] + n)
    line_end, tail = full * capacity, F.array(*(F.lit(b).cast("long") for b in begins))

    def sequence_of(p: Column) -> Column:
        return F.when(p < line_end, F.floor(p / capacity)).otherwise(full + F.size(F.filter(tail, lambda b: b <= p - line_end)) - 1)

    def begin_of(s: Column) -> Column:
        return F.when(s < full, s * capacity).otherwise(line_end + F.element_at(tail, F.greatest(s - full + 1, F.lit(1)).cast("int")))

    last = F.col("place") + F.col("length") - 1
    parts = pieces.withColumn("s", F.explode(F.sequence(sequence_of(F.col("place")), sequence_of(last))))
    start = F.greatest("place", begin_of(F.col("s")))
    after = F.least(last + 1, F.when(F.col("s") < full, (F.col("s") + 1) * capacity).otherwise(line_end + F.element_at(tail, F.least(F.greatest(F.col("s") - full + 2, F.lit(1)), F.lit(len(begins))).cast("int"))))
    parts = parts.withColumns({"skip": start - F.col("place"), "take": after - start, "offset": start - begin_of(F.col("s"))})
    return parts.withColumn("sequence_id", F.lit(first_sequence) + F.col("s"))


def _recut(path: str, end_id: int):
    """Checksums of the parts of cut pieces; a text that is not the piece's own (ids given twice) is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = tokens.store_of(path, added=True)
        for batch in batches:
            rows = batch.to_pylist()
            keep, sums = [], []
            for first, ids, size in tokens.encoded(batch.column(0), store):
                for i, (stop, n) in enumerate(zip(np.cumsum(size).tolist(), size.tolist(), strict=True)):
                    r = rows[first + i]
                    piece = np.append(ids[stop - n : stop], np.uint32(end_id)).astype("<u4")[r["start"] : r["start"] + r["length"]]
                    if n + 1 == r["doc_tokens"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]:
                        keep.append(first + i)
                        sums.append(zlib.crc32(piece[r["skip"] : r["skip"] + r["take"]].tobytes()))
            kept_rows = batch.take(pa.array(keep, pa.int64()))
            start = pa.array([rows[i]["start"] + rows[i]["skip"] for i in keep], pa.int64())
            columns = {n: kept_rows.column(n) for n in ("doc_id", "doc_tokens", "sequence_id", "offset", "take")}
            yield pa.RecordBatch.from_arrays([columns["doc_id"], start, columns["take"], pa.array(sums, pa.int64()), columns["doc_tokens"], columns["sequence_id"], columns["offset"]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = kept(in_arrow(own(docs, id_col, text_col), _cut(vocabulary, capacity, end_id), PIECES))
    histogram = {r["length"]: r["pieces"] for r in pieces.groupBy("length").agg(F.count("*").alias("pieces")).collect()}
    plan, rest, _ = cutting_stock(histogram, capacity)
    salts = max(SALTS, math.ceil(max(histogram.values(), default=0) / PIECES_PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("pieces"))
    firsts = counts.withColumn("base", F.sum("pieces").over(Window.partitionBy("length").orderBy("salt")) - F.col("pieces")).drop("pieces")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("place", F.row_number().over(within)).join(firsts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("place") - 1)
    # A row for each pattern and length, of which there are at most a few for each length up to the capacity, whatever the number of documents.
    whole, laid, sequences = _slots(plan, rest)
    names = ("slot_length", "low", "high", "copies", "sequence", "at")
    slots = F.broadcast(spark.createDataFrame(whole, ", ".join(f"{n} long" for n in names)))
    inside = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    turn = F.col("rank") - F.col("low")
    placed = ranked.join(slots, inside).withColumn("sequence_id", F.col("sequence") + F.floor(turn / F.col("copies"))).withColumn("offset", F.col("at") + turn % F.col("copies") * F.col("length"))
    done = placed.select(*RESULT)
    if not rest:
        return done
    line = F.broadcast(spark.createDataFrame(laid, "slot_length long, low long, high long, first long"))
    parts = _laid(ranked.join(line, inside).withColumn("place", F.col("first") + turn * F.col("length")), sum(n * k for n, k in rest.items()), sequences, capacity)
    parts = kept(parts.select(*RESULT, "skip", "take"))
    done = done.unionByName(parts.where("take = length").select(*RESULT))
    cut = parts.where("take < length").withColumnRenamed("doc_id", "id")
    texts = own(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    # Cut pieces are few, unless the lengths do not fit each other; then they are joined by a shuffle.
    small = F.broadcast if cut.count() <= BROADCAST_ROWS else (lambda df: df)
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    texts = texts.join(small(cut.select("id").distinct()), same, "left_semi").dropDuplicates(["doc_id", "text"])
    again = texts.join(small(cut), same).select("text", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "skip", "take")
    return done.unionByName(in_arrow(again, _recut(vocabulary, end_id), f"{PIECES}, sequence_id long, offset long"))
