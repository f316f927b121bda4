"""Fields of labels by section and sector (L5): ordered patterns, each tried only on labels that hold its literal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from finrecon.functions.fields import SECTION_FIELDS, literal_of
from finrecon.plans.fixtures import fixture
from finrecon.plans.registry import query

Fields = Sequence[tuple[str, Sequence[str]]]


def first_field(label: Column, fields: Fields) -> Column:
    """The first field with a pattern that the label matches, case aside. A pattern runs only on labels that hold its literal, so most are never tried."""
    chain = F
    for name, patterns in fields:
        tried = [label.contains(literal_of(p)) & label.rlike(p) if literal_of(p) else label.rlike(p) for p in patterns]
        hit = tried[0]
        for t in tried[1:]:
            hit = hit | t
        chain = chain.when(hit, name)
    return chain.otherwise(F.lit(None).cast("string"))


def labelled_fields(rows: DataFrame, sections: Mapping[str, Fields] = SECTION_FIELDS, sectors: Mapping[str, Mapping[str, Fields]] | None = None) -> DataFrame:
    """rows (label, section, sector, others) with field: by the sector's own fields of the section if it has some, else the section's; null without a match or for an unknown section. Patterns run once for each distinct label of a section and sector."""
    distinct = rows.select("label", "section", "sector").distinct().withColumn("_text", F.lower(F.trim("label")))
    field = F.lit(None).cast("string")
    for section, fields in sections.items():
        own = first_field(F.col("_text"), fields)
        for sector, tables in (sectors or {}).items():
            if section in tables:
                own = F.when(F.col("sector") == sector, first_field(F.col("_text"), tables[section])).otherwise(own)
        field = F.when(F.col("section") == section, own).otherwise(field)
    found = distinct.select(F.col("label").alias("_l"), F.col("section").alias("_s"), F.col("sector").alias("_c"), field.alias("field"))
    same = F.col("label").eqNullSafe(F.col("_l")) & F.col("section").eqNullSafe(F.col("_s")) & F.col("sector").eqNullSafe(F.col("_c"))
    return rows.join(found, same, "left").drop("_l", "_s", "_c")


@query("l5_section_fields")
def l5_sections(spark, sf_dir):
    """Labels of companies in each section. Patterns look ahead, which the SQL engine's cannot, so tests hold them against the standard library's."""
    rows = fixture(spark, sf_dir, "fx_raw_label").select("company_id", "label").distinct()
    rows = rows.withColumn("section", F.explode(F.array(*map(F.lit, SECTION_FIELDS)))).withColumn("sector", F.lit("manufacturing"))
    return labelled_fields(rows).where("field is not null").select("company_id", "label", "section", "field")
