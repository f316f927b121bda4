"""Exact token counts from a histogram of encoded lengths.

Documents are aggregated by their encoded length; all answers come from the histogram. Suffix sums over the lengths tell, for every context limit, how many documents
reach it and how many tokens remain when longer documents are cut there. The sums are taken in blocks of ``BLOCK`` lengths: within a block by a window, over the
few block totals (one for each BLOCK tokens of the longest document) by another, so no task sees all lengths of a long-tailed corpus.

Ids are integers. Defined cases: null and empty texts have length 0; repeated rows count each; other columns are not read; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from finrecon.llm import tokens
from finrecon.llm.frames import Scratch, in_arrow, own

BLOCK = 1024


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = tokens.store_of(path, added=True)
        for batch in batches:
            for first, size in tokens.encoded_sizes(batch.column(1), store):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(size)), pa.array(size)], ["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens for each row."""
    return in_arrow(own(docs, id_col, text_col), _sizes(vocabulary), "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and the documents of that length; stored, so the texts are encoded once whatever is asked of it."""
    return Scratch(lengths.sparkSession, "histogram").kept(lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length as a context limit: docs of it, docs and tokens at or above it, docs and tokens below it, and the tokens left when longer documents are cut to it."""
    own_tokens = F.col("n_tokens") * F.col("docs")
    rows = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", own_tokens)
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *(F.coalesce(F.sum(f"b_{c}").over(above), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")), *(F.sum(f"b_{c}").over(total).alias(f"all_{c}") for c in ("docs", "tokens")))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    summed = rows.join(blocks, "block")
    docs_at = F.col("later_docs") + F.sum("docs").over(within)
    tokens_at = F.col("later_tokens") + F.sum("tokens").over(within)
    out = summed.select("n_tokens", "docs", docs_at.alias("docs_reaching"), tokens_at.alias("tokens_reaching"), "all_docs", "all_tokens")
    below = F.col("all_tokens") - F.col("tokens_reaching")
    return out.select(
        "n_tokens", "docs", "docs_reaching", "tokens_reaching",
        (F.col("all_docs") - F.col("docs_reaching")).alias("docs_below"), below.alias("tokens_below"),
        (below + F.col("docs_reaching") * F.col("n_tokens")).alias("tokens_when_cut"),
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The least length that at least that share of the documents does not exceed, as one row."""
    within = sums.where(F.col("docs_below") + F.col("docs") >= F.lit(share) * (F.col("docs_below") + F.col("docs_reaching")))
    return within.agg(F.min("n_tokens").alias("n_tokens"))


def cut_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut to the limit, which need not be a length that occurs, as one row."""
    return sums.agg(
        F.coalesce(F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_tokens") * F.col("docs")).otherwise(limit * F.col("docs"))), F.lit(0)).alias("tokens")
    )
