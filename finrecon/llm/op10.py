"""Query op10: quality rules with robust outliers per language and source."""

from pyspark.sql import DataFrame, SparkSession

from finrecon.llm.frames import table
from finrecon.llm.quality import judged


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
