"""Choices by tables and bounds: literal cases."""

from pyspark.sql import functions as F

from finrecon.operators import guards, reports, selections as sel


def test_expanded_tokens(spark):
    df = spark.createDataFrame([("Less: Employee costs (net)",), ("PPE",), (None,)], "l string")
    got = [sorted(r["t"]) if r["t"] is not None else None for r in df.select(sel.expanded_tokens(F.col("l")).alias("t")).collect()]
    assert got[0] == ["costs", "employee", "personnel", "staff"] and got[1] == ["equipment", "plant", "ppe", "property"] and got[2] in (None, [])


def test_matches_follow_concepts(spark):
    template = spark.createDataFrame([("staff cost", None), ("net debt total", "d"), ("cash flow", "c")], "label string, concept string")
    pool = spark.createDataFrame([("employee cost", "x"), ("net borrowings total", "other"), ("bank flow", "c"), ("cash flow items", None)], "label string, concept string")
    got = {r["template_label"]: (r["pool_label"], r["score"]) for r in sel.overlap_matches(template, pool).collect()}
    # staff, cost against employee, staff, personnel, cost: 2 of 4, below the bound of a pool label with a concept; concepts d and other never match.
    assert "staff cost" not in got and "net debt total" not in got and got["cash flow"][0] in ("bank flow", "cash flow items")


def test_asked_periods(spark):
    df = spark.createDataFrame([(["F2024", "F2023", "F2022"], ["F2022", "F2020"]), (["F2024"], []), ([], ["F2020"])], "t array<string>, d array<string>")
    years = [r["y"] for r in df.select(sel.asked_periods(F.col("t"), F.col("d"), False, F.lit(True)).alias("y")).collect()]
    quarters = [r["y"] for r in df.select(sel.asked_periods(F.col("t"), F.col("d"), True).alias("y")).collect()]
    assert years == [["F2024", "F2023", "F2022"], ["F2024"], []] and quarters == [["F2022"], ["F2024"], ["F2020"]]


def test_gated_fills(spark):
    rows = [("fill", "Tax", 0.5, 1.0, None), ("fill", "Tax", 0.55, -9.0, None), ("fill", "Net loss", 0.6, -9.0, None), ("fill", "Tax", 0.6, 1.0, 2.0), ("correction", "Tax", 0.8, 2.02, 2.0), ("correction", "Tax", 0.8, 2.005, 2.0), ("cli", "Tax", None, 1.0, None), ("other", "Tax", 0.1, None, None)]
    got = [(r["outcome"], r["written"]) for r in sel.gated(spark.createDataFrame(rows, "use string, label string, confidence double, value double, current double").coalesce(1)).collect()]
    assert got == [("below floor", None), ("written", 9.0), ("written", -9.0), ("cell already filled", None), ("corrected", 2.02), ("no change", None), ("below floor", None), ("value not numeric", None)]


def test_guards_see_what_is_left(spark):
    q = lambda n, v, scope="standalone": (1, "q", scope, "Sales", f"{n}QF2024", v)
    rows = [q(1, 5.0), q(2, 5.0), q(3, 5.0), q(4, 5.001), (1, "q", "standalone", "Sales", "1QF2023", 5.0), q(1, 5.0, "consolidated"), q(2, 90.0, "consolidated"), (1, "y", "consolidated", "sales (net)", "F2024", 50.0), (1, "y", "standalone", "sales (net)", "F2024", 50.0), (1, "y", "standalone", "Other", "F2024", None)]
    got = {(r["scope"], r["label"], r["period"]): r["guard"] for r in guards.write_guards(spark.createDataFrame(rows, "company_id int, sheet string, scope string, label string, period string, value double")).collect()}
    assert [got["standalone", "Sales", f"{n}QF2024"] for n in (1, 2, 3, 4)] == ["duplicate_quarterly"] * 4 and got["standalone", "Sales", "1QF2023"] == "duplicate_quarterly"
    assert got["consolidated", "Sales", "1QF2024"] is None and got["consolidated", "Sales", "2QF2024"] == "magnitude_too_high"
    assert got["standalone", "sales (net)", "F2024"] == "cons_eq_standalone" and got["consolidated", "sales (net)", "F2024"] is None and got["standalone", "Other", "F2024"] is None


def test_guards_share_their_sorts(spark, small):
    """Cells are dealt by company once and sorted twice, whatever the number of guards' windows."""
    plan = guards.v23_guards(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 2


def test_guards_on_odd_cells(spark):
    """Equal quarters count in sheets of three columns only; labels of one name meet over sheets and scopes, those that are null among themselves."""
    four = lambda company, periods, label: [(company, "q", "standalone", label, p, 5.0) for p in periods]
    rows = four(1, ["1QF2024", "1QF2024", "2QF2024", "2QF2024"], "Sales") + four(2, ["1QF2024", "1QF2024", "2QF2024", "2QF2024"], "Sales") + [(2, "q", None, "Other", "3QF2024", 0.0)]
    rows += [(3, "a", "consolidated", "Sales", "1QF2024", 90.0), (3, "a", "standalone", None, "1QF2024", 90.0), (3, "b", "other", "Less: SALES", "F2024", -50.0), (3, "b", "other", None, "F2024", 70.0), (3, "b", "other", "Zero", "F2024", None)]
    df = spark.createDataFrame(rows, "company_id int, sheet string, scope string, label string, period string, value double")
    got = {(r["company_id"], r["label"], r["period"]): r["guard"] for r in guards.write_guards(df).collect()}
    assert {got[1, "Sales", p] for p in ("1QF2024", "2QF2024")} == {None} and {got[2, "Sales", p] for p in ("1QF2024", "2QF2024")} == {"duplicate_quarterly"} and got[2, "Other", "3QF2024"] is None
    assert got[3, "Sales", "1QF2024"] == "magnitude_too_high" and got[3, None, "1QF2024"] is None and got[3, "Less: SALES", "F2024"] is None


def test_report_names(spark):
    df = spark.createDataFrame([("Q4FY25_Financial_Results.pdf",), ("Results for June 2024",), ("August",), ("H1 Oct",), (None,)], "t string")
    assert [r["q"] for r in df.select(reports.result_quarter(F.col("t")).alias("q")).collect()] == [4, 1, None, 2, None]
    cells = spark.createDataFrame([("12",), ("300",), ("301",), ("0",), ("1,2",), ("7.0",), ("x",), (None,)], "t string")
    assert [r["n"] for r in cells.select(reports.note_cell(F.col("t")).alias("n")).collect()] == [True, True, False, False, True, False, False, False]


def test_candidates_are_not_multiplied(spark):
    """Candidates meet the totals of their year as one row each, not one for each word."""
    rows = [(1, "total other income", 2020, 10.0), (1, "other interest income", 2020, 11.0), (1, "other income", 2020, 10.5), (1, "rent", 2020, 1.0), (1, "rent", 2021, 20.0), (1, "rent", 2022, None)]
    df = spark.createDataFrame(rows, "company_id int, label string, fy int, value double")
    found = guards.refused(df, df)
    assert {tuple(r) for r in found.collect()} == {(1, "other interest income", "over_total"), (1, "rent", "swing")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
