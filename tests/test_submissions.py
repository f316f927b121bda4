"""Submitted labels, component sums and sheet views: literal cases."""

from pyspark.sql import functions as F

from finrecon.operators import submissions as sub


def test_keys(spark):
    texts = [" Less: Tax (net)", "Add: Plus: Other Income", "Minus:x(gross) (net)", "(net)", None]
    got = [r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sub.submitted_key(F.col("t")).alias("k")).collect()]
    assert got == ["tax", "other income", "x", "", None]


def test_tiers(spark):
    template = spark.createDataFrame([("Less: Tax", 1), ("Finance cost", 2), ("Other income", 3), ("Other current assets", 4)], "template_label string, ord int")
    concepts = spark.createDataFrame([("Interest expense", "finance_cost"), ("Finance cost", "finance_cost")], "label string, concept string")
    labels = spark.createDataFrame([(x,) for x in ("Less: Tax", "Tax", "Interest expense", "Current assets other", "Deferred tax items", "Goodwill", "", None, "Other")], "label string")
    got = {r["label"]: (r["template_label"], r["tier"]) for r in sub.resolved_submissions(labels, template, concepts).collect()}
    assert got == {"Less: Tax": ("Less: Tax", 1), "Tax": ("Less: Tax", 2), "Interest expense": ("Finance cost", 3), "Current assets other": ("Other income", 4), "Deferred tax items": ("Less: Tax", 4), "Other": ("Other income", 4)}


def test_sums_take_first_values(spark):
    rows = [(1, "_cogs_materials", 5.0, 2), (1, "_cogs_materials", 3.0, 1), (1, "_cogs_purchases", 4.0, 3), (1, "tax_current", 1.0, 4), (2, "_cogs_materials", 1.0, 1), (2, "_cogs_purchases", 1.0, 2), (2, "Less: Cost of goods sold", 9.0, 3), (2, "tax_current", 1.0, 4), (2, "tax_deferred", -0.5, 5), (3, "tax_deferred", None, 1)]
    got = {tuple(r) for r in sub.component_sums(spark.createDataFrame(rows, "k int, field string, value double, ord int"), ["k"]).collect()}
    assert got == {(1, "Less: Cost of goods sold", 7.0), (2, "Less: Tax", 0.5)}


def test_views_are_newest_first(spark):
    rows = [(1, "EBITDA margin", "F2023", 0.1), (1, "EBITDA margin", "F2024", 0.2), (1, "Sales", "2QF2024", 5.0), (1, "Sales", "3QF2024", 6.0), (2, "Sales", "F2020", 1.0)]
    got = {(r["k"], r["label"]): (r["uom"], [(c["period"], c["value"]) for c in r["cells"]]) for r in sub.wide_view(spark.createDataFrame(rows, "k int, label string, period string, value double"), ["k"]).collect()}
    assert got[1, "EBITDA margin"] == ("%", [("3QF2024", None), ("2QF2024", None), ("F2024", 0.2), ("F2023", 0.1)])
    assert got[1, "Sales"][1][:2] == [("3QF2024", 6.0), ("2QF2024", 5.0)] and got[2, "Sales"] == ("crore", [("F2020", 1.0)])
