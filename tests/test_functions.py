"""Literal cases of the scalar functions and of operators that SQL does not state."""

import os

import pytest
from pyspark.sql import functions as F

from finrecon.functions import labels as lb, numbers as nb, periods as pr, scorers
from finrecon.operators import checks, pools, texts, windows
from finrecon.sources import readers, sinks


def values(spark, items, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_quarters(spark):
    given = ["Mar-25", "Jun-24", "Sep 2024", "Dec 2024", "Q4FY25", "Q1FY24", "1QF2025", "Jun '24", "Jun2024", "TTM", "", None]
    assert values(spark, given, pr.quarter) == ["4QF2025", "1QF2025", "2QF2025", "3QF2025", "4QF2025", "1QF2024", "1QF2025", "1QF2025", "1QF2025", None, None, None]


def test_periods(spark):
    given = ["F2025", "FY25", "FY2024-25", "2024-25", "March 31, 2025", "Mar 2025", "F.Y. 2025", "2025", "1901", "Jun-24", None]
    assert values(spark, given, pr.period) == ["F2025"] * 8 + [None, "1QF2025", None]


def test_headings(spark):
    given = ["Three months ended June 30, 2024", "Year ended March 31, 2024", "March 31, 2025"]
    assert values(spark, given, pr.heading) == ["1QF2025", "F2024", "F2025"]


def test_numbers(spark):
    given = ["(1,234.50)", "₹ 12.5", "10 Mn", "2 Bn", "3 Cr", "-", "Nil", "NA", "nan", "inf", "", None, "6,31,17,250"]
    assert values(spark, given, nb.number) == [-1234.5, 12.5, 1.0, 200.0, 3.0, None, None, None, None, None, None, None, 63117250.0]


def test_units(spark):
    assert values(spark, ["₹ in Thousands", "Rs. in Lakhs", "₹ in Crores", "nothing"], texts.unit_divisor) == [10000.0, 100.0, 1.0, 1.0]


def test_glued_cells(spark):
    assert values(spark, ["2024-252023-24", "F2025F2024", "x"], nb.glued_years) == [["2024-25", "2023-24"], ["F2025", "F2024"], ["x"]]
    assert values(spark, ["3,251.613,079.76", "12.50"], nb.glued_numbers) == [["3,251.61", "3,079.76"], ["12.50"]]


def test_labels(spark):
    assert values(spark, ["Less: Finance  Costs (net)", "• Revenue", None], lb.normal) == ["finance costs", "revenue", None]
    assert values(spark, ["a b c d", "Revenue", "x", "12"], texts.is_fragment) == [True, False, True, True]


def test_scorers(spark):
    df = spark.createDataFrame([("total revenue", "revenue total"), ("abc", "xyz")], "a string, b string")
    assert [tuple(r) for r in df.select(scorers.char_ratio("a", "b") < 1, scorers.token_set_ratio("a", "b")).collect()] == [(True, 1.0), (True, 0.0)]
    scorers.register(spark)
    assert spark.sql("select char_ratio('ab', 'ab')").first()[0] == 1.0


def test_consensus_matches_its_pandas_form(spark, small):
    from finrecon.operators.pools import consensus, rank_of
    from finrecon.plans.fixtures import fixture

    rows = fixture(spark, small, "fx_obs").where("statement_type = 'consolidated'")
    native = consensus(rows, pools.KEYS)
    keyed = rows.groupBy(*pools.KEYS).agg(scorers.consensus_value(F.col("value"), rank_of(F.col("source"))).alias("other"))
    assert native.join(keyed, pools.KEYS).where("abs(value - other) > 1e-9").count() == 0


def test_formulas_are_checked(spark):
    df = spark.createDataFrame([(6.0, 2.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(checks.compiled("( a + b ) / b", ["a", "b"])).collect()] == [4.0, None]
    for bad in ("a; drop", "c + 1", "a + sleep(1)"):
        with pytest.raises(ValueError):
            checks.compiled(bad, ["a", "b"])


def test_routed_write_keeps_what_is_there(spark, tmp_path):
    fills = spark.createDataFrame([(1, 1, 2.345, "HIGH"), (1, 2, 1.0, "HIGH"), (2, 1, 1.0, "FLAG"), (2, 2, 1.0, "HIGH")], "row int, col int, value double, tier string")
    cell = lambda r, c: spark.createDataFrame([(r, c)], "row int, col int")
    out = sinks.disposed(fills, cell(1, 2), cell(2, 2))
    sinks.write_routed(out, str(tmp_path / "out"))
    back = {(r["row"], r["col"]): (r["disposition"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {(1, 1): ("written", 2.35), (1, 2): ("skipped: formula", 1.0), (2, 1): ("review", 1.0), (2, 2): ("skipped: filled", 1.0)}


def test_observations_have_the_schema(spark, tmp_path):
    spark.createDataFrame([(1, "xbrl", "FY25", 2.0)], "company_id long, source string, period string, value double").write.json(str(tmp_path / "obs"))
    row = readers.read_observations(spark, str(tmp_path / "obs"), "json").first()
    assert (row["period"], row["raw_label"]) == ("F2025", None)


def test_gap_groups_and_fill(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, None), ("a", 9.0, None), ("b", 1.0, None)], "k string, t double, s string")
    out = windows.gap_groups(df, ["k"], F.col("t"), F.col("t"), 3.0).orderBy("k", "t")
    assert [r["grp"] for r in out.collect()] == [0, 0, 1, 0]
    assert [r["f"] for r in windows.forward_filled(df, ["k"], "t", F.col("s"), "f").orderBy("k", "t").collect()] == ["x", "x", "x", None]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    from pathlib import Path

    package = Path(pools.__file__).parents[1]
    for file in package.rglob("*.py"):
        if "llm" not in file.parts:
            assert "finrecon.llm" not in file.read_text(), file


def test_line_chunks(spark):
    from finrecon.operators.scalars import line_chunks

    texts = ["aa\nbb\ncc\ndd", "x" * 30 + "\nyy", "", "one"]
    rows = values(spark, texts, lambda c: line_chunks(c, 8, 1))
    assert rows == [["aa\nbb\ncc", "cc\ndd"], ["x" * 30, "yy"], [""], ["one"]]


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("f", i, n) for i, n in enumerate([5, 9, 4, 1, 7])], "filing string, page_no long, n_chars long")
    kept = windows.fitting(rows, ["filing"], F.col("page_no"), "n_chars", 10, "page_no").collect()
    assert sorted(r["page_no"] for r in kept) == [0, 2, 3]


def test_joined_numbers(spark):
    rows = [["6,31,17,25", "0", "12"], ["1,234", "5"], [], ["7,12", "3"]]
    assert values(spark, rows, nb.joined_numbers, "array<string>") == [["6,31,17,250", "12"], ["1,234", "5"], [], ["7,123"]]


def test_word_rows(spark):
    words = [("p", "b", 20.0, 11.0), ("p", "a", 5.0, 10.0), ("p", "c", 5.0, 14.9), ("p", "d", 1.0, 15.5), ("q", "e", 1.0, 1.0)]
    found = windows.word_rows(spark.createDataFrame(words, "page string, text string, x0 double, top double"), ["page"]).collect()
    assert {(r["page"], r["row"]): r["line"] for r in found} == {("p", 0): "a c b", ("p", 1): "d", ("q", 0): "e"}


def test_streams_give_the_same_in_several_micro_batches(spark, small, tmp_path, monkeypatch):
    from finrecon.streaming import feeds

    spark.read.parquet(f"{small}/events.parquet").repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/events.parquet")
    for k, file in enumerate(sorted((tmp_path / "events.parquet").glob("part-*"))):  # files are read by their time
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    names = ("s1", "s3", "s4")
    whole = {n: sorted(map(tuple, getattr(feeds, n)(spark, small).collect())) for n in names}
    monkeypatch.setattr(feeds, "FILES", 1)
    assert {n: sorted(map(tuple, getattr(feeds, n)(spark, str(tmp_path)).collect())) for n in names} == whole


def test_assignment_is_greedy_by_tier(spark):
    from finrecon.operators import matching

    rows = [(1, "total assets", 0, "assets", 0.9, 100.0), (1, "assets", 1, "assets", 1.0, 100.0), (1, "assets", 1, "asset", 0.8, 90.0), (1, "current assets", 1, "big", 0.9, 500.0), (2, "sales", 1, "net sales", 0.9, 5.0), (2, "sales", 1, "a sales", 0.9, 5.0)]
    found = {tuple(r) for r in matching.assigned(spark.createDataFrame(rows, "company_id long, template_label string, tier int, pool_label string, score double, value double")).collect()}
    assert found == {(1, "total assets", "assets"), (1, "assets", "asset"), (2, "sales", "a sales")}


def test_unit_phrases(spark):
    from pyspark.sql import functions as F

    phrases = {"(Lakhs)": 100.0, "(₹ lakhs)": 100.0, "Rs. in Crores": 1.0, "(₹ 000)": 10000.0, "'000": 10000.0, "INR in million": 10.0, "nothing": 1.0}
    rows = spark.createDataFrame(list(phrases.items()), "t string, d double").select("t", "d", texts.unit_divisor(F.col("t")).alias("got")).collect()
    assert all(r["d"] == r["got"] for r in rows)


def test_consensus_in_columns(spark):
    """The same values as the fold in Python, without Python in the plan."""
    import random

    draw = random.Random(5)
    rows = [(k, draw.choice([1.0, 100.0, 102.0, 104.9, 107.0, 0.0, -50.0, -51.0]), draw.randrange(3)) for k in range(60) for _ in range(draw.randrange(1, 7))]
    df = spark.createDataFrame(rows, "k int, v double, r int")
    ours = df.groupBy("k").agg(scorers.consensus_of(F.col("v"), F.col("r")).alias("x"))
    assert "Python" not in ours._jdf.queryExecution().toString()
    assert dict(map(tuple, ours.collect())) == dict(map(tuple, df.groupBy("k").agg(scorers.consensus_value(F.col("v"), F.col("r")).alias("x")).collect()))


def test_words_come_from_one_array(spark, small):
    """A branch for each word is code that the JVM does not compile; the fixtures of Spark have none."""
    from finrecon.plans import fixtures, registry

    for name in ("fx_raw_label", "fx_filed_page", "fx_filed_line", "fx_sheet", "fx_cover_page", "fx_company"):
        assert fixtures.fixture(spark, small, name)._jdf.queryExecution().optimizedPlan().toString().count(" WHEN ") <= 1
    joined = registry.queries()["l3_first_phrase"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in joined


def test_statements_are_parsed_once(spark, small):
    """Each text once as an array and once as an object; before, a filter ahead of explode parsed it again."""
    from finrecon.plans import registry

    plan = registry.queries()["src3_statement_json"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 3 and "size(" not in plan
