"""Query op8: the exact length histogram of documents with its sums for every context limit."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from finrecon.llm.frames import table
from finrecon.llm.tokencounts import histogram, suffix_sums, token_lengths


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return suffix_sums(histogram(lengths))
