"""Plug points (X): scorers, consensus, extractors and rule packs that users give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from finrecon.functions import labels as lb, scorers
from finrecon.operators.checks import compiled
from finrecon.operators.joins import NORMAL_POOL, TOKENS_SQL, candidates, top
from finrecon.operators.pools import CONCEPT_KEYS, WIDE_SQL, rank_of, wide
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query


def retrieved(pairs: DataFrame, keep: Column, score: Callable[[DataFrame], Column], keys: list[str], k: int) -> DataFrame:
    """Top k of each key by a user's scorer, among the rows that the user's predicate keeps; the predicate is applied before k."""
    kept = pairs.where(keep)
    return top(kept.withColumn("score", score(kept)), keys, [F.desc("score"), F.col("raw_label")], k)


@query("x1_user_predicate", oracle(f"with {TOKENS_SQL} select template_label, raw_label, round(jac, 6) as score from (select *, row_number() over (partition by template_label order by jac desc, raw_label) as k from s where not contains({NORMAL_POOL}, 'red')) where k <= 2", "fx_template", "fx_pool_label"))
def x1(spark, sf_dir):
    a = fixture(spark, sf_dir, "fx_template").select("template_label", lb.tokens(F.col("template_label")).alias("tokens"))
    b = fixture(spark, sf_dir, "fx_pool_label").select("raw_label", lb.tokens(F.col("raw_label")).alias("tokens_r"))
    found = retrieved(candidates(a, b), ~lb.normal(F.col("raw_label")).contains("red"), lambda d: lb.jaccard(d["tokens"], d["tokens_r"]), ["template_label"], 2)
    return found.select("template_label", "raw_label", F.round("score", 6).alias("score"))


@query("x2_label_scorers")
def x2(spark, sf_dir):
    names = fixture(spark, sf_dir, "part").select(lb.normal(F.col("p_name")).alias("n")).distinct().withColumn("w", F.explode(F.split("n", " ")))
    pairs = names.select("w", F.col("n").alias("a")).join(names.select("w", F.col("n").alias("b")), "w").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(scorers.char_ratio("a", "b"), 6).alias("ratio"), F.round(scorers.token_set_ratio("a", "b"), 6).alias("token_set"))


def extracted(documents: DataFrame, extract: Callable, schema: str) -> DataFrame:
    """A user's extractor over batches of documents, such as those of the binaryFile source."""
    return documents.mapInPandas(extract, schema)


@query("x3_table_function", "select page_id, len(regexp_extract_all(html, '<p>')) as paragraphs, length(html) as size from pages")
def x3(spark, sf_dir):
    def extract(batches):
        for batch in batches:
            html = batch["html"].fillna("")
            yield batch[["page_id"]].assign(paragraphs=html.str.count("<p>"), size=html.str.len())

    return extracted(fixture(spark, sf_dir, "pages").select("page_id", "html"), extract, "page_id long, paragraphs long, size long")


@query("x4_consensus_aggregate")
def x4(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_obs").where("statement_type = 'consolidated'")
    return rows.groupBy("company_id", "raw_label", "fy", "fq").agg(scorers.consensus_of(F.col("value"), rank_of(F.col("source"))).alias("value"))


def with_rules(w: DataFrame, rules: DataFrame) -> DataFrame:
    """The wide frame with a column for each row (name, formula, ord) of a rule table, in order; later rules may use earlier ones."""
    for r in rules.orderBy("ord").collect():
        w = w.withColumn(r["name"], compiled(r["formula"], w.columns))
    return w


@query("x5_rule_pack", oracle(f"with {WIDE_SQL}, a as (select *, round(revenue_from_operations - cost_of_goods_sold, 4) as gross from wide) select company_id, source, statement_type, fy, fq, gross, round(gross / nullif(revenue_from_operations, 0), 4) as gross_share from a", "fx_concepts"))
def x5(spark, sf_dir):
    rules = spark.createDataFrame([("gross", "revenue_from_operations - cost_of_goods_sold", 1), ("gross_share", "gross / revenue_from_operations", 2)], "name string, formula string, ord int")
    return with_rules(wide(fixture(spark, sf_dir, "fx_concepts")), rules).select(*CONCEPT_KEYS, "gross", "gross_share")
