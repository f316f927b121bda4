"""Query op9: personal data replaced by format-preserving pseudonyms."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from finrecon.llm.frames import own, table
from finrecon.llm.pseudonyms import KINDS, with_pseudonyms

#: Stands for a secret that a user keeps outside the code.
DEMO_KEY = "demonstration key"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own(table(spark, sf_dir, "documents"), "doc_id", "text")
    done = with_pseudonyms(docs, DEMO_KEY, found_col="found")
    kinds = F.transform("found", lambda p: p["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", "text", *counts)
