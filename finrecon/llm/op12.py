"""Query op12: quality of documents, learned from labels outside the held-out fifth."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from finrecon.llm.classifier import fitted, scored
from finrecon.llm.frames import table
from finrecon.llm.op05 import held_out

THRESHOLD = 0.3


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    found = scored(docs, fitted(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
