"""Statement tables of html pages, cell grids and JSON blocks: literal cases."""

from finrecon.sources import grids


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def placed(spark, html):
    rows = grids.placed_cells(grids.html_table_cells(pages(spark, html))).orderBy("tab", "row", "col").collect()
    return [(r["row"], r["col"], r["text"]) for r in rows]


def test_cells_find_free_columns(spark):
    html = "<table><tr><td rowspan=3>a</td><td colspan='2'>b</td><td>c</td></tr><tr><td>d</td><td rowspan=\"2\">e</td><td>f</td></tr><tr><td>g</td><td>h</td></tr><tr><td>i</td></tr></table>"
    assert placed(spark, html) == [(1, 0, "a"), (1, 1, "b"), (1, 3, "c"), (2, 1, "d"), (2, 2, "e"), (2, 3, "f"), (3, 1, "g"), (3, 3, "h"), (4, 0, "i")]


def test_tables_inside_cells_are_their_own(spark):
    html = "<table><tr><td>x<table><tr><td>in 1</td><td>in <b>2</b></td></tr></table> y</td><td>z</td></tr></table><p>out</p><table><tr><td>last</td></tr></table>"
    assert placed(spark, html) == [(1, 0, "x y"), (1, 1, "z"), (1, 0, "in 1"), (1, 1, "in 2"), (1, 0, "last")]


def test_statement_tables(spark):
    head = "<THEAD><tr><th>Figures</th><th>Mar 2024</th><th colspan=2>FY23</th><th>Notes</th></tr></THEAD>"
    body = "<tbody><tr><td><span>Net&nbsp;sales</span> +</td><td>1,234.5</td><td>(7)</td><td>8</td><td>9</td></tr><tr><td>Tax % -</td><td>25%</td><td>—</td><td>N/A</td></tr><tr><td></td><td>1</td></tr></tbody>"
    html = f"<section id='a'><script>'<table><tr><td>1</td></tr></table>'</script><table class=\"t\">{head}{body}</table></section><section id=b><table>{head}</table></section>"
    got = grids.statement_tables(pages(spark, html, "", None, "<table", "no table")).drop("tab").collect()
    rows = {(r["page_id"], r["section"], r["row"], r["label"], r["period"], r["value"]) for r in got}
    assert rows == {(0, "a", 2, "Net sales", "F2024", 1234.5), (0, "a", 2, "Net sales", "F2023", -7.0), (0, "a", 2, "Net sales", "F2023", 8.0), (0, "a", 3, "Tax %", "F2024", 25.0)}
    assert grids.statement_tables(pages(spark, html), ("b",)).count() == 0


def grid(spark, *rows):
    cells = [(1, r, c, t) for r, row in rows for c, t in enumerate(row, 1) if t is not None]
    got = grids.grid_facts(spark.createDataFrame(cells, "sheet long, row int, col int, text string")).collect()
    return {(r["row"], r["label"], r["period"], r["value"]) for r in got}


def test_labels_in_another_column(spark):
    rows = [(1, ["Report", "FY2023 figures"]), (20, ["no", "line", "FY2023", "FY2024"]), (21, ["1", "Sales", "10", "-"]), (22, ["2", "Tax", "0", "20000000000"]), (23, ["x", None, "7", "8"])]
    assert grid(spark, *rows) == {(21, "Sales", "F2023", 10.0), (22, "Tax", "F2024", 2000.0)}


def test_first_row_of_two_periods_is_the_header(spark):
    rows = [(2, ["", "FY2020", "FY2021"]), (3, ["", "FY2022", "FY2023", "FY2024"]), (4, ["a", "1", "2", "3"])]
    assert grid(spark, *rows) == {(4, "a", "F2020", 1.0), (4, "a", "F2021", 2.0)}
    assert grid(spark, (3, ["a", "5"]), (4, ["b", "6"])) == set()
    assert grid(spark, (3, ["", "FY2020"]), (4, ["b", "6"])) == {(4, "b", "F2020", 6.0)}


def test_blocks_inside_blocks_and_plans(spark):
    body = '{"x":{"p":{"2020":1,"q":{"m":{"2021":1},"n":{"2021":2},"o":{"2021":3},"r":{"2021":4}}},"q":{"2020":2.5},"s":{"2019-20":3,"2020":"4"}}}'
    df = spark.createDataFrame([(1, body)], "doc long, body string")
    found = grids.nested_blocks(df, "doc", "body")
    assert {tuple(r) for r in found.collect()} == {(1, "p", "F2020", 1.0), (1, "q", "F2020", 2.5), (1, "s", "F2019-20", 3.0)}
    assert "Python" not in found._jdf.queryExecution().toString() and "InPandas" not in found._jdf.queryExecution().toString()


def test_statements_in_one_pass(spark):
    """No column is computed once for each mention of it: a page is read once, its table is placed once, and no join computes it again."""
    head = "<thead><tr><th rowspan=2></th><th colspan=2>Years</th></tr><tr><th>Mar 2020</th><th>Mar 2019</th></tr></thead>"
    html = f"<table>{head}<tbody><tr><td rowspan=2>a</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr><tr><td>b</td><td colspan=2>5</td><td>6</td></tr><tr><td rowspan=99999999999>c</td><td>7</td></tr></tbody></table>"
    found = grids.statement_tables(pages(spark, html))
    assert {(r["row"], r["label"], r["period"], r["value"]) for r in found.collect()} == {(3, "a", "F2020", 1.0), (3, "a", "F2019", 2.0), (4, "a", "F2020", 3.0), (4, "a", "F2019", 4.0), (5, "b", "F2020", 5.0), (6, "c", "F2020", 7.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    html = "<table><tr><td rowspan=3>a</td><td colspan=2>b</td></tr><tr><td>c</td><td rowspan=2>d</td></tr><tr><td>e</td><td>f</td></tr></table>"
    whole = grids.html_tables(pages(spark, html)).collect()[0]["cs"]
    assert [c["col"] for c in whole] == [r[1] for r in placed(spark, html)] == [0, 1, 1, 2, 1, 3]


def test_blocks_meet_in_their_own_row(spark):
    """A text is unrolled in its row: nothing is shuffled, and texts of one key are blocks of their own."""
    small, other = '{"a":{"2024":1},"b":{"2024":2},"c":{"2024":3}}', '{"d":{"2024":4},"e":{"2024":5},"f":{"2024":6},"g":{"2024":7}}'
    found = grids.nested_blocks(spark.createDataFrame([(1, small), (1, other)], "doc long, body string"), "doc", "body")
    assert sorted(r["label"] for r in found.collect()) == list("abcdefg")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_statements_stay_in_their_own_row(spark):
    """Nothing is shuffled or sorted after a page is read, and cells before the first row of a table have columns."""
    html = "<table><thead><tr><th></th><th>Mar 2020</th></tr></thead><tbody><tr><td>a</td><td>1</td></tr><tr><td>b +</td><td>2</td><td>3</td></tr></tbody></table>"
    found = grids.statement_tables(pages(spark, html, html))
    assert sorted((r["page_id"], r["label"], r["value"]) for r in found.collect()) == [(0, "a", 1.0), (0, "b", 2.0), (1, "a", 1.0), (1, "b", 2.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # Each pattern of a year is tried once for a heading.
    assert plan.count("(?:19|20)") == 1
    loose = grids.html_tables(pages(spark, "<table><td>a<td colspan=2>b<td>c<tr><td>d</table>")).collect()[0]["cs"]
    assert [(c["row"], c["col"], c["text"]) for c in loose] == [(0, 0, "a"), (0, 1, "b"), (0, 3, "c"), (1, 0, "d")]


def test_hidden_parts_and_odd_tags(spark):
    """Comments, scripts and styles hide tags up to their end, or nothing without one; a tag goes on to the next closing bracket."""
    html = "a<!-- <table> --><style><td></style><SCRIPT><td></script ></SCRIPT>x<table><tr><td <b>>1<!---->2</td><!-- ><td>3<script>4<td>5<6"
    cells = grids.html_tables(pages(spark, html)).collect()
    assert [(r["tab"], [c["text"] for c in r["cs"]]) for r in cells] == [(5, [">1 2", "3 4", "5 6"])]


def test_blocks_behind_many_items_and_levels(spark, small):
    """With no bound of items the whole list is looked at, as the query does; depth can be said as well."""
    block = '{"a":{"2024":1},"b":{"2024":2},"c":{"2024":3}}'
    long, deep = "[" + "0," * 50 + f"{block}]", block
    for _ in range(8):
        deep = f'{{"k":{deep}}}'
    df = spark.createDataFrame([(1, long), (2, deep)], "doc long, body string")
    labels = lambda found: sorted((r["doc"], r["label"]) for r in found.collect())
    assert labels(grids.nested_blocks(df, "doc", "body", items=None)) == [(1, k) for k in "abc"]
    assert labels(grids.nested_blocks(df, "doc", "body", items=51, deepest=8)) == [(d, k) for d in (1, 2) for k in "abc"]
    assert labels(grids.nested_blocks(df, "doc", "body")) == []
    assert f", 1, {grids.ITEMS})" not in grids.src9(spark, small)._jdf.queryExecution().analyzed().toString()
