"""Operators on pages and lines of filings, by literal cases."""

from pyspark.sql import functions as F

from finrecon.operators import filings as fl


def lines(spark, texts, filing=1):
    return spark.createDataFrame([(filing, 1, i, t) for i, t in enumerate(texts)], "filing long, page_no long, line_no int, line string")


def test_year_marks(spark):
    rows = spark.createDataFrame([("Year ended March 31, 2024 and 31st March, 2023",), ("FY24 FY'23 F2022",), ("31 March 2020 31 March 2020",), ("paid 1,234 in 2024",), ("",), (None,)], "t string")
    assert [r["m"] for r in rows.select(fl.year_marks(F.col("t")).alias("m")).collect()] == [["F2024", "F2023"], ["F2024", "F2023", "F2022"], ["F2020"], [], [], None]


def test_prose_pairs(spark):
    text = ["Sales before any header 10.5 11.5", "As at March 31, 2024", "Trade receivables 7 1,200.50 (300.25)", "Particulars FY2023 FY2022", "page [SCOPE=STANDALONE]", "a) Finance costs 40 50 60", "Listed years 2023 2024", "Rates 0.5 0.25", "| Sales | 1 | 2 |", "Abc 5 6", None]
    got = {(r["label"], r["period"], r["scope"], r["value"], r["kind"]) for r in fl.prose_pairs(lines(spark, text)).collect()}
    assert got == {
        ("Trade receivables", "F2024", "unknown", 1200.5, "current"), ("Trade receivables", "F2023", "unknown", -300.25, "prior"),
        ("Finance costs", "F2023", "standalone", 50.0, "current"), ("Finance costs", "F2022", "standalone", 60.0, "prior"),
    }


def test_found_figures(spark):
    text = ["Particulars FY2024 FY2023", "Trade receivables 1,500.5 1,400.5", "Total borrowings, see note 12: 2,500.75 and 2,400.25", "| Provisions | 1 | 2 |"]
    specs = spark.createDataFrame([("Trade receivables", "F2023"), ("Borrowings", "F2023"), ("Provisions", "F2024"), ("Inventories", "F2024")], "label string, period string")
    got = {(r["label"], r["value"], r["confidence"]) for r in fl.found_figures(lines(spark, text), specs).collect()}
    assert got == {("Trade receivables", 1400.5, "HIGH"), ("Borrowings", 2400.25, "MEDIUM")}
    assert fl.found_figures(lines(spark, []), specs).count() == 0


def test_columns_by_gaps(spark):
    heads = spark.createDataFrame([(1, 100.0), (1, 200.0), (1, 160.0), (2, 10.0)], "page long, x double")
    words = spark.createDataFrame([(1, 119.0), (1, 121.0 + 9), (1, 231.0), (1, 189.0), (2, 60.0), (2, 61.0), (3, 1.0)], "page long, x double")
    got = {(r["page"], r["x"], r["center"]) for r in fl.assigned_columns(words, heads).collect()}
    assert got == {(1, 119.0, 100.0), (1, 189.0, 200.0), (2, 60.0, 10.0)}


def test_blocks_and_ranges(spark):
    rows = spark.createDataFrame([("a", "x" * 71 + str(i)) for i in range(4)] + [("a", "short"), ("a", "short")] + [("b", str(i)) for i in range(5)] + [("c", "1")], "block string, label string")
    assert [r["block"] for r in fl.sound_blocks(rows, "block", "label").collect()] == ["b"]
    pages = spark.range(200).select(F.lit(1).alias("filing"), F.col("id").alias("page_no"))
    out = fl.page_ranges(pages).collect()
    assert sorted(r["page_no"] for r in out if r["kept"]) == list(range(50, 195))
    assert sorted(r["page_no"] for r in out if r["probed"]) == [*range(24), *range(70, 86)]
    assert fl.page_ranges(pages.limit(80)).where("not kept").count() == 0


def test_first_periods(spark):
    rows = spark.createDataFrame([("Report 2031\nAs at March 31, 2024 March 31, 2023\nFY2022 FY2021",), ("Particulars | 2024 | 2023",), ("\n" * 50 + "FY2024",), (None,)], "t string")
    assert [r["p"] for r in rows.select(fl.first_periods(F.col("t")).alias("p")).collect()] == [["F2024", "F2023", "F2022"], ["F2024", "F2023"], [], None]


def test_tables_need_a_body(spark):
    text = ["Consolidated Balance Sheet", "| a | FY24 |", "|---|---|", "| b | 1 |", "", "| lone | head |", "|---|---|", "words", "| no | rule |", "| x | y |"]
    got = [(r["tbl"], r["row"], r["col"], r["text"], r["scope"]) for r in fl.markdown_tables(lines(spark, text)).orderBy("tbl", "row", "col").collect()]
    assert got == [(1, 0, 1, "a", "consolidated"), (1, 0, 2, "FY24", "consolidated"), (1, 1, 1, "b", "consolidated"), (1, 1, 2, "1", "consolidated")]


def test_nested_blocks(spark):
    from finrecon.sources import grids as rd

    small, large = '{"a":{"2024":1},"b":{"F2023":2},"c":{"2023-24":3}}', '{"a":{"2024":1},"b":{"2024":2},"c":{"2024":3},"d":{"2024":4,"x":5}}'
    deep = small
    for _ in range(7):
        deep = f'{{"k":{deep}}}'
    bodies = [f"[{small},{large}]", "[" + "0," * 20 + f"{large}]", deep, '{"a":{"2024":1},"b":{"2024":2}}', "no json", None]
    got = rd.nested_blocks(spark.createDataFrame(list(enumerate(bodies)), "doc long, body string"), "doc", "body").collect()
    assert sorted((r["doc"], r["label"], r["period"], r["value"]) for r in got) == [(0, k, "F2024", v) for k, v in zip("abcd", (1.0, 2.0, 3.0, 4.0), strict=True)]


def test_records_in(spark):
    from finrecon.sources import readers as rd

    one = '{"a":"1"}'
    rows = spark.createDataFrame([(f"[{one},{one}]",), (f'{{"results":[{one}]}}',), (one,), ("[]",), ("x",), (None,)], "b string")
    assert [r["n"] for r in rows.select(F.size(F.filter(rd.records_in(F.col("b"), "a: string"), lambda r: r["a"] == "1")).alias("n")).collect()][:4] == [2, 1, 1, 0]


def test_filing_plans_compute_once(spark):
    """One sort of a filing for its carried states; marks, prose and search texts are not computed again for each mention."""
    lines = spark.createDataFrame([(1, 1, 1, "Balance sheet"), (1, 1, 2, "Equity"), (1, 1, 3, "Sales of goods 1,200 1,100"), (1, 1, 4, "Consolidated balance sheet"), (1, 1, 5, "x")], "filing long, page_no long, line_no int, line string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    states = fl.with_statement(lines)
    assert plan(states).count("Window [") == 1
    assert [r["part"] for r in states.orderBy("line_no").collect()] == [None, "equity", "equity", None, None]
    read = fl.prose_lines(lines)
    assert plan(read).count(fl.PROSE) == 1
    assert [(r["label"], r["values"]) for r in read.collect()] == [("Sales of goods", [1200.0, 1100.0])]
    marks = spark.createDataFrame([("Year ended March 31, 2022 and March 31, 2022 and FY21",), ("no mark",), (None,)], "t string").select(fl.year_marks(F.col("t")).alias("m"))
    assert plan(marks).count("regexp_extract_all") == 1 and [r["m"] for r in marks.collect()] == [["F2022", "F2021"], [], None]
    text = lines.select(fl.query_text(F.col("line"), F.lit("s"), F.lit("F2024"), F.lit(""), F.lit("t")).alias("x"))
    assert plan(text).count("less:|add:") == 1
