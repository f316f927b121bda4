"""A training corpus from documents: toxic and poor documents go, one of each near-duplicate group stays, personal data is replaced, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again for the next one. All but the last return the columns of documents.
Every row is judged by its own text, also one without an id or with an id that another row has: scores and verdicts are columns beside the row, and near-dedup numbers the rows of
its input. Labels of toxicity are by doc_id. Of near copies the row with the least doc_id stays, one without an id only if none has one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from finrecon.llm import minhash, packing, pseudonyms, quality, toxicity
from finrecon.llm.frames import Scratch

SHINGLE_WORDS, PERCENT = 5, 80
CAPACITY = 1024
#: Stands for a secret that a user keeps outside the code.
DEMO_KEY = "demonstration key"
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "toxicity"
    while score in {c.lower() for c in docs.columns}:
        score += "_"
    return toxicity.with_scores(docs, model, name=score).where(F.col(score) < 0.5).drop(score)


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = "row_number"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    # The rows get numbers of their own and are stored, so that every plan reads the same numbers.
    docs = Scratch(spark, "rows").kept(docs.withColumn(row, F.monotonically_increasing_id()))
    found = minhash.near_duplicates(docs, id_col=row, words=SHINGLE_WORDS, percent=PERCENT).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    ids = docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"]
    stay = found.join(ids, "row").groupBy("component").agg(first.alias("stays"), F.count("*").alias("size")).where("size > 1")
    gone = Scratch(spark, "copies").kept(found.join(stay, "component").where("row <> stays").select("row"))
    few = F.broadcast(gone) if gone.count() <= minhash.BROADCAST_ROWS else gone
    return docs.join(few, docs[row] == few["row"], "left_anti").drop(row)


def private_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.with_pseudonyms(docs, DEMO_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES = [
    ("toxicity", toxic_out),
    ("quality_rules", poor_out),
    ("minhash_near_dedup", copies_out),
    ("pii", private_out),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.kept(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.done(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
