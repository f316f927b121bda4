"""Query op3: documents packed into sequences of 1024 tokens."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from finrecon.llm.frames import table
from finrecon.llm.packing import packed

CAPACITY, END_ID = 1024, 0


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)
