"""Near-duplicate documents by one-permutation MinHash.

A document's set holds 64-bit hashes of its distinct word shingles. One-permutation hashing splits the hash range into
``BINS`` bins and keeps the least hash of each; an empty bin copies the value of the first full bin in an order drawn
for that bin (optimal densification: every full bin is equally likely, independently for each empty bin). ``ROWS`` values
form the key of a band. Two documents of similarity 0.8 miss each other in all 32 bands with probability 5e-8.

Edges stay star-shaped. Documents with equal sets are one representative first. In each bucket the member that shares most
buckets with others is the centre, and only (centre, member) pairs are checked, on full sets: each member first with its best centre, then with those
centres that this left in another group.

A bucket whose other members are then in more than one component may still hold a link between two of them. These open members go through an exact prefix join.
Only shingles that two open members hold can count towards an overlap; a member's set of those is its core. Members of one core and one size have the same
overlaps, so they are one class, represented once. Shingles are ordered from rare to frequent, and two classes can only be linked if they share one
of the first ``core - least overlap + 1`` shingles of both; sizes and the places of the shared shingle rule out most of the rest. A shingle of many classes is dealt
over a triangle of blocks. What is left is checked on full sets. No link is dropped and no bucket is capped.

Defined cases: null, empty and blank texts have no shingles, and are linked with nothing, kept, and their own component; a text with fewer words
than a shingle is one shingle; equal texts fall into one component under the least id; repeated rows of one doc_id count as one document
and give one row; of different texts under one id the one that comes first by size and print of its set counts; rows with a null id are left out; ids are integers; columns other than the id and the text are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from finrecon.llm import textarrays as ta
from finrecon.llm.components import components
from finrecon.llm.frames import Scratch, in_arrow, own

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Up to so many ids (8 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Classes of one shingle that meet in one task.
BLOCK = 1000
#: For each bin the order in which an empty one looks for a full one.
ORDERS = np.stack([np.random.default_rng((7, b)).permutation(BINS) for b in range(BINS)])
_LOWEST = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in order."""
    for _, texts in ta.pieces(column):
        found = texts.words(fold=True)
        hashes, at = found.hashes(), np.concatenate([[0], np.cumsum(found.counts())])
        for i in range(len(texts)):
            yield np.unique(ta.shingles(hashes[at[i] : at[i + 1]], words))


def signature(ordered: np.ndarray) -> np.ndarray:
    """The BINS densified minima of a non-empty ordered set."""
    at = np.searchsorted(ordered, _LOWEST)
    least = ordered[np.minimum(at, len(ordered) - 1)]
    full = (at < len(ordered)) & ((least >> np.uint64(64 - BINS.bit_length() + 1)) == np.arange(BINS))
    donor = ORDERS[np.arange(BINS), full[ORDERS].argmax(axis=1)]
    return least[np.where(full, np.arange(BINS), donor)]


def band_keys(sign: np.ndarray) -> np.ndarray:
    rows = sign.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = ta.mix(key + rows[:, k])
    return key.view(np.int64)


def _prints(ordered: np.ndarray) -> tuple[int, int, int]:
    """Size and two independent 64-bit sums of a set."""
    if not len(ordered):
        return 0, 0, 0
    one, two = (int(ta.mix(ordered ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0, 0x5BD1E995))
    return len(ordered), one, two


PRINT = ("n", "print1", "print2")


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, keys = [], []
            for s in shingle_sets(batch.column(1), words):
                sets.append(_prints(s))
                keys.append(band_keys(signature(s)) if len(s) else None)
            columns = list(zip(*sets, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(keys, pa.list_(pa.int64()))], ["doc", *PRINT, "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sets = [], []
            for s in shingle_sets(batch.column(1), words):
                prints.append(_prints(s))
                sets.append(s.tobytes())
            columns = list(zip(*prints, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(sets, pa.binary())], ["doc", *PRINT, "shingles"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, left, right = [], [], []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(y, x)
            shared.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
            left.append(len(a.as_buffer()) // 8)
            right.append(len(b.as_buffer()) // 8)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (shared, left, right))], ["a", "b", "shared", "n_a", "n_b"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, shingle) rows, a part of a batch at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), batch.column(0)[i].as_py()), pa.int64()), pa.array(values)], ["doc", "shingle"])


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact overlap of the sets of each pair (a, b); linked tells whether the similarity reaches percent.

    Sets of copies take little room where they are stored and much in memory, so Spark may take them for small; the joins must not send them to all tasks. The centres come first, while the rows of one that has many members are narrow."""
    wide = sets.hint("merge")
    witha = pairs.join(wide.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = witha.join(wide.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    found = in_arrow(both, _overlaps, "a long, b long, shared long, n_a long, n_b long")
    return found.withColumn("linked", F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent)


def _of(docs: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of docs whose key is in few: by broadcast if that is small, else by a shuffle of both."""
    return docs.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, keys, "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, representative_id (least id with an equal set)."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    texts = own(docs, id_col, text_col).toDF("doc", "text").where("doc is not null")
    signed = scratch.kept(in_arrow(texts, _signed(words), "doc long, n long, print1 long, print2 long, bands array<long>"))
    one = scratch.kept(signed.groupBy("doc").agg(F.min(F.struct(*PRINT)).alias("p")).select("doc", "p.*"))
    firsts = one.where("n > 0").groupBy(*PRINT).agg(F.min("doc").alias("doc"))
    # An id given twice has two signatures; those of one print are equal, and of two equal keys the buckets below count one.
    reps = signed.where("n > 0").join(firsts, ["doc", *PRINT], "left_semi").dropDuplicates(["doc"])
    banded = reps.select("doc", "n", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = scratch.kept(banded.join(crowded, "key"))
    scratch.done(signed)

    weight = members.groupBy("doc").agg(F.sum(F.col("members") - 1).alias("weight"))
    centre = members.join(weight, "doc").groupBy("key").agg(F.max(F.struct("weight", -F.col("doc"), "n")).alias("c"))
    centre = centre.select("key", (-F.col("c.col2")).alias("center"), F.col("c.n").alias("n_center"), F.col("c.weight").alias("weight"))
    star = scratch.kept(members.select("key", "doc", "n").join(centre, "key").where("doc <> center"))
    scratch.done(members)
    near = star.where(f"100 * least(n, n_center) >= {percent} * greatest(n, n_center)")
    pairs = near.groupBy(F.col("center").alias("a"), F.col("doc").alias("b")).agg(F.max("weight").alias("weight"))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("weight"), "a"))
    pairs = scratch.kept(pairs.withColumn("turn", best).select("a", "b", "turn"))
    involved = scratch.kept(star.select("doc").union(star.select("center")).distinct().join(one, "doc"))
    sets = scratch.kept(_of(in_arrow(_of(texts, involved.select("doc"), ["doc"]), _sets(words), "doc long, n long, print1 long, print2 long, shingles binary"), involved, ["doc", *PRINT]).dropDuplicates(["doc"]).select("doc", "n", "shingles"))
    first = scratch.kept(overlaps(pairs.where("turn = 1").select("a", "b"), sets, percent).where("linked").select("a", "b"))
    group = first.select(F.col("b").alias("doc"), F.col("a").alias("root"))
    apart = pairs.where("turn > 1").join(group.toDF("a", "root_a"), "a", "left").join(group.toDF("b", "root_b"), "b", "left")
    apart = apart.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    links = scratch.kept(first.union(overlaps(apart, sets, percent).where("linked").select("a", "b")))
    labels = scratch.kept(components(links, scratch))
    scratch.done(pairs, first)

    more = _unresolved(star, labels, sets, percent, scratch)
    if not more.isEmpty():
        # Components of components: only the new links and the labels that they join.
        ends = more.join(labels.toDF("a", "label_a"), "a", "left").join(labels.toDF("b", "label_b"), "b", "left")
        ends = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        joined = scratch.kept(components(ends, scratch))
        every = labels.union(joined.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        labels = every.join(joined.toDF("label", "least"), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    scratch.done(star, involved, sets, links)
    of_set = firsts.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select(*PRINT, F.col("doc").alias("rep"), F.coalesce("label", "doc").alias("component"))
    found = one.join(of_set, [*PRINT], "left")
    component = F.coalesce("component", "doc")
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc") == component).alias("kept"), F.coalesce("rep", "doc").alias("representative_id"))


def _unresolved(star: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between members that share an open bucket, and between the members of one class."""
    labelled = star.select("key", "doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("label", "doc").alias("component"))
    # The centre has met all members, so only a bucket whose other members are in two components is open.
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    docs = scratch.kept(labelled.join(open_keys, "key", "left_semi").select("doc", "component").distinct())
    if docs.isEmpty():
        return docs.select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    held = _of(sets, docs.select("doc"), ["doc"])
    rows = scratch.kept(in_arrow(held.select("doc", "shingles"), _listed, "doc long, shingle long"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    core = rows.join(shared, "shingle").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("core"))
    core = core.join(held.select("doc", "n"), "doc").withColumn("least", F.ceil(F.col("n") * percent / 100)).where("size(core) >= least")
    core = core.withColumn("print", F.sha2(F.to_json("core"), 256)).join(docs, "doc")
    core = scratch.kept(core.select("doc", "n", "print", F.size("core").alias("size"), "component", F.slice("core", F.lit(1), (F.size("core") - F.col("least") + 1).cast("int")).alias("prefix")))
    scratch.done(rows)
    classes = core.groupBy("n", "print", "size").agg(F.min_by(F.struct("doc", "component", "prefix"), "doc").alias("c"), F.min("component").alias("low"), F.max("component").alias("high"))
    # A class whose members are in several components may meet any class, so it has no component of its own.
    of_class = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.col("c.doc"))
    classes = scratch.kept(classes.select("n", "print", "size", "c.doc", "c.prefix", of_class.alias("component")))
    tokens = classes.select("doc", "n", "size", "component", F.posexplode("prefix").alias("place", "token")).withColumn("token", F.col("token.shingle"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    tokens = tokens.join(counts, "token").withColumn("blocks", F.ceil(F.col("k") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    fields = ("doc", "n", "size", "component", "place")
    x = tokens.select("token", F.col("block").alias("own"), other.alias("met"), *(F.col(c).alias(f"{c}_x") for c in fields))
    y = tokens.select("token", F.col("block").alias("met"), other.alias("own"), *(F.col(c).alias(f"{c}_y") for c in fields))
    need = f"{percent} * (n_x + n_y)"
    close = (
        f"doc_x < doc_y and component_x <> component_y and {100 + percent} * least(n_x, n_y) >= {need}"
        f" and {100 + percent} * least(size_x - place_x, size_y - place_y) >= {need}"
    )
    pairs = x.join(y, ["token", "own", "met"]).where(close).select(F.col("doc_x").alias("a"), F.col("doc_y").alias("b")).distinct()
    found = scratch.kept(overlaps(pairs, sets, percent).where("linked").select("a", "b"))
    # Members of a class are linked with each other if their common core suffices, or are all linked with the same other class. Each is held against the class's first member or one of that other class, on full sets.
    ends = found.select(F.col("a").alias("doc"), F.col("b").alias("other")).union(found.select("b", "a")).groupBy("doc").agg(F.min("other").alias("other"))
    classed = classes.select("n", "print", "size", "doc").join(ends, "doc", "left")
    hub = F.when(F.col("size") * 100 >= (2 * F.col("n") - F.col("size")) * percent, F.col("doc")).otherwise(F.col("other"))
    whole = classed.select("n", "print", "size", hub.alias("a"), F.col("doc").alias("first")).where("a is not null")
    inside = core.select("n", "print", "size", F.col("doc").alias("b")).join(whole, ["n", "print", "size"]).where("b <> first").select("a", "b")
    inside = overlaps(inside, sets, percent).where("linked").select("a", "b")
    more = scratch.kept(found.union(inside))
    scratch.done(docs, core, classes, found)
    return more
