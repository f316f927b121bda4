"""Query op5: toxicity of documents, learned from labels outside the held-out fifth."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from finrecon.llm.frames import table
from finrecon.llm.toxicity import fitted, scored


def held_out(doc_id):
    """Whether crc32 of the id as text is divisible by 5; false for a null id, to which no label belongs."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    found = scored(docs, fitted(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
