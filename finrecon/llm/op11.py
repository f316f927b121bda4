"""Query op11: tokens of a byte-level and of a piece vocabulary aligned over all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from finrecon.llm.alignment import aligned
from finrecon.llm.frames import table


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return aligned(table(spark, sf_dir, "documents"), a, b)[0]
