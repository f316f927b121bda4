"""Tables of figures that state their own shape: statement tables in html (SRC5), cell grids (SRC7) and blocks in nested JSON (SRC9), each to long rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from finrecon.functions import numbers as nb, periods as pr
from finrecon.functions.once import once
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query
from finrecon.plans.shipping import shipped

TAG, SECTION_ID, SPAN = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*"), re.compile(r"\bid=[\"']?([^\"'\s>]+)", re.I | re.A), re.compile(r"\b(col|row)span=[\"']?(\d+)", re.I | re.A)
#: What hides all up to its end, and those ends: a comment's stands within a piece between two "<", the others' begin one.
HIDES, ENDS = re.compile(r"!--|(script|style)\b", re.I), {"script": re.compile("/script>", re.I), "style": re.compile("/style>", re.I)}
OPENS, CLOSES = {"td", "th"}, {"/td", "/th", "tr", "tbody", "/thead"}
SHAPES = OPENS | CLOSES | {"table", "/table", "thead", "section"}
#: The named characters that texts of cells hold.
NAMED = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&mdash;", "—"), ("&amp;", "&"))
CELLS = "array<struct<row:bigint,cell:bigint,head:int,tag:string,across:int,down:int,text:string,col:int>>"
LARGEST, BLANKS = 2**31 - 1, re.compile(r"[ \t\n\x0b\f\r]+")


def _plain(parts: list[str]) -> str:
    text = " ".join(parts)
    for name, sign in NAMED if "&" in text else ():
        text = text.replace(name, sign)
    return text.strip(" ") if text.isprintable() and "  " not in text else BLANKS.sub(" ", text).strip(" ")


class _Cell:
    __slots__ = ("row", "head", "tag", "across", "down", "parts", "col")

    def __init__(self, row: int, head: int, tag: str, across: int, down: int):
        self.row, self.head, self.tag, self.across, self.down, self.parts, self.col = row, head, tag, across, down, [], 0


class _Table:
    """An open table: text goes to the parts of its open cell."""

    __slots__ = ("tab", "section", "cells", "row", "head", "parts")

    def __init__(self, tab: int):
        self.tab, self.section, self.cells, self.row, self.head, self.parts = tab, None, [], 0, 0, None


def _place(cells: list[_Cell]) -> None:
    """Gives each cell the first column that neither a cell to the left nor one that reaches down from a row above takes. Only columns that a cell reaches down in are kept."""
    until, row, after = {}, None, 0
    for c in cells:
        col = after if c.row == row else 0
        while until and until.get(col, -1) >= c.row:
            col += 1
        c.col, row, after = col, c.row, col + c.across
        if c.down > 1:
            until.update(dict.fromkeys(range(col, after), c.row + c.down - 1))
        elif until:
            for x in [x for x in until if col <= x < after] if c.across > len(until) else range(col, after):
                until.pop(x, None)


@lru_cache(4096)
def _shape(tag: str) -> tuple[str, int, int]:
    """(name, colspan, rowspan) of a tag without its brackets; the first span of a name counts. A name that shapes no table is empty, and "!" is that of comments, scripts and styles."""
    found = TAG.match(tag)
    name = found[0].lower() if found else ""
    if name not in OPENS:
        return name if name in SHAPES else "!" if HIDES.match(tag) else "", 1, 1
    spans = {k.lower(): int(n.lstrip("0")[:11] or 0) for k, n in reversed(SPAN.findall(tag))}
    across, down = (s if 1 <= (s := spans.get(k, 1)) <= LARGEST else 1 for k in ("col", "row"))
    return name, across, down


def _hidden(pieces: list[str], k: int, endless: set) -> tuple[int, str] | None:
    """The last piece of the comment, script or style that begins with piece k, and the text behind its end; none if it has no end. endless are the kinds that are known to have no end from here on."""
    kind = (HIDES.match(pieces[k])[1] or "!").lower().replace("\u017f", "s")
    for m in range(k, len(pieces)) if kind not in endless else ():
        if kind == "!":
            at = pieces[m].find("-->", 3 if m == k else 0) + 3
        else:
            found = ENDS[kind].match(pieces[m]) if m > k else None
            at = found.end() if found else 2
        if at > 2:
            return m, pieces[m][at:]
    endless.add(kind)
    return None


def _tables(html: str) -> list[_Table]:
    """The tables of a page that have cells, in one pass over its tags: the open table of a depth is the last that was opened at it. Tags, comments, scripts, styles and the texts between them are counted as places.

    A tag goes from a "<" to the next ">", so one piece between two "<" is mostly a tag and the text after it."""
    pieces = html.split("<")
    depth, section, at_depth, tables, table, pos, k, many, endless = 0, None, {}, [], None, int(bool(pieces[0])), 1, len(pieces), set()
    while k < many:
        token, closed, text = pieces[k].partition(">")
        name, across, down = _shape(token) if len(token) < 100 else _shape.__wrapped__(token)
        if name == "!" and (end := _hidden(pieces, k, endless)):
            k, text = end
            closed, name = ">", ""
        elif not closed:
            # A tag that holds a "<", or text after a "<" that no ">" follows.
            rest = next((m for m in range(k + 1, many) if ">" in pieces[m]), None) if ">" not in endless else None
            if rest is None:
                endless.add(">")
                name, text = "", token
            else:
                token, closed, text = "<".join(pieces[k : rest + 1]).partition(">")
                name, across, down = _shape.__wrapped__(token)
                k = rest
        k += 1
        if closed:
            pos += 1
        if not name or name == "!":
            pass
        elif name in OPENS:
            if table is not None:
                cell = _Cell(table.row, table.head, name, across, down)
                table.cells.append(cell)
                table.parts = cell.parts
        elif name in ("table", "/table", "section"):
            if name == "section":
                named = SECTION_ID.search(token)
                section = named[1] if named else ""
            elif name == "table":
                depth += 1
                at_depth[depth] = _Table(pos - 1)
                tables.append(at_depth[depth])
            else:
                depth -= 1
            table = at_depth.get(depth) if depth > 0 else None
            if table is not None and table.section is None:
                table.section = section
        elif table is not None:
            if name in CLOSES:
                table.parts = None
            if name == "tr":
                table.row += 1
            elif name == "thead":
                table.head = 1
            elif name in ("/thead", "tbody"):
                table.head = 0
        if text:
            pos += 1
            if table is not None and table.parts is not None:
                table.parts.append(text)
    return [t for t in tables if t.cells]


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, tab, section, cs): the tables of (page_id, html), each with its cells in order as one array, as ``html_table_cells`` and ``placed_cells`` give them."""
    shipped(pages.sparkSession)
    schema = StructType([pages.schema["page_id"], *StructType.fromDDL(f"tab int, section string, cs {CELLS}").fields])
    columns = to_arrow_schema(schema)

    def placed(cells: list[_Cell]) -> list[dict]:
        _place(cells)
        return [{"row": c.row, "cell": i, "head": c.head, "tag": c.tag, "across": c.across, "down": c.down, "text": _plain(c.parts), "col": c.col} for i, c in enumerate(cells, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"page_id": k, "tab": t.tab, "section": t.section, "cs": placed(t.cells)} for k, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if html for t in _tables(html)]
            yield pa.RecordBatch.from_pylist(rows, schema=columns)

    return pages.select("page_id", "html").mapInArrow(run, schema)


def html_table_cells(pages: DataFrame) -> DataFrame:
    """Cells of all tables of (page_id, html): page_id, tab, section, head, tag, row, cell, across, down, text.

    A table is named by the place of its tag, so one inside a cell of another is a table of its own and its text is not the outer cell's. section is the id of the last section tag before the table."""
    return html_tables(pages).select("page_id", "tab", "section", F.inline("cs")).drop("col")


def placed_cells(cells: DataFrame) -> DataFrame:
    """The cells of each table with col, the first column that neither a cell to the left nor one that reaches down from a row above takes. One fold over a table's cells."""
    table = cells.groupBy("page_id", "tab").agg(F.max("section").alias("section"), F.array_sort(F.collect_list(F.struct("row", "cell", "head", "tag", "across", "down", "text"))).alias("cs"))
    kind = "array<struct<row:bigint,head:int,tag:string,down:int,across:int,text:string,col:int>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).cast("bigint").alias("row"), F.lit(0).alias("next"), F.array().cast("array<bigint>").alias("until"))

    def placed(s: Column, c: Column, col: Column) -> Column:
        until = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(s["until"]), col + c["across"]) - 1), lambda x: F.when(x.between(col, col + c["across"] - 1), c["row"] + c["down"] - 1).otherwise(F.coalesce(F.get(s["until"], x), F.lit(0)))
        )
        cell = F.struct(c["row"].alias("row"), c["head"].alias("head"), c["tag"].alias("tag"), c["down"].alias("down"), c["across"].alias("across"), c["text"].alias("text"), col.alias("col"))
        return F.struct(F.concat(s["out"], F.array(cell)).alias("out"), c["row"].alias("row"), (col + c["across"]).alias("next"), until.alias("until"))

    def put(s: Column, c: Column) -> Column:
        low = F.when(s["row"] == c["row"], s["next"]).otherwise(0)
        free = once(low, lambda n: F.filter(F.sequence(n, n + F.size(s["until"])), lambda x: F.coalesce(F.get(s["until"], x), F.lit(0)) < c["row"]))
        return once(F.element_at(free, 1), lambda col: placed(s, c, col))

    return table.select("page_id", "tab", "section", F.inline(F.aggregate("cs", start, put)["out"]))


def _figures(cells: list[_Cell]) -> tuple[list[list[str]], list[tuple[int, str, int, str]]]:
    """The head texts above each column that has figures, the lowest first, and the cells below a head and beside a label: (row, label, place among the columns, text)."""
    _place(cells)
    # The first of equals is the lowest, as no two cells of a row share a column.
    heads = sorted((-c.row, c.col, c.col + c.across, _plain(c.parts)) for c in cells if c.head and c.tag == "th")
    label, end, places, above, out = None, 0, {}, [], []
    for c in cells:
        if c.head or c.tag != "td":
            continue
        # Two cells of the first column never share a row, so the last one that begins at or above a row is the only one that may reach it.
        if c.col == 0:
            label, end = _plain(c.parts), c.row + c.down
        elif label and c.row < end:
            if c.col not in places:
                over = [text for _, first, after, text in heads if first <= c.col < after]
                places[c.col] = len(above) if over else None
                above += [over] if over else []
            if places[c.col] is not None:
                out.append((c.row, label, places[c.col], _plain(c.parts)))
    return above, out


def _lists(lists: list[list], flat: pa.Array) -> pa.Array:
    """Flat elements as the lists that they came from."""
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32()), flat)


def statement_figures(pages: DataFrame, sections: tuple[str, ...] | None = None) -> DataFrame:
    """(page_id, tab, section, above, figures): one row for each statement table of (page_id, html), as ``_figures`` reads it."""
    shipped(pages.sparkSession)
    schema = StructType([pages.schema["page_id"], *StructType.fromDDL("tab int, section string, above array<array<string>>, figures array<struct<row:bigint,label:string,at:int,text:string>>").fields])
    kind = to_arrow_schema(schema).field("figures").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tabs, named, above, figures = [], [], [], [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                for t in _tables(html) if html else ():
                    if (sections is None or t.section in sections) and any(c.head and c.tag == "th" for c in t.cells):
                        over, found = _figures(t.cells)
                        if found:
                            at.append(i)
                            tabs.append(t.tab)
                            named.append(t.section)
                            above.append(over)
                            figures.append(found)
            flat = list(chain.from_iterable(figures))
            fields = [pa.array([f[j] for f in flat], x.type) for j, x in enumerate(kind)]
            columns = list(chain.from_iterable(above))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(tabs, pa.int32()), pa.array(named, pa.string()),
                    _lists(above, _lists(columns, pa.array(list(chain.from_iterable(columns)), pa.string()))), _lists(figures, pa.StructArray.from_arrays(fields, fields=list(kind))),
                ],
                names=schema.names,
            )

    return pages.select("page_id", "html").mapInArrow(run, schema)


def statement_tables(pages: DataFrame, sections: tuple[str, ...] | None = None) -> DataFrame:
    """Statement tables of (page_id, html) to (page_id, tab, section, row, label, period, value).

    Periods are those of the head's cells after the first column, of the lowest row that has one for the column; a head or label cell stands in all rows and columns that it spans, a figure in its first ones. A table without a head has no figures.
    A sign of an expandable row is cut from its label; figures in brackets are negative, dashes and words none.

    Each page is read in one pass and each table stays one row up to its figures, which come with their label and with the place of their heads; nothing is shuffled."""
    year = lambda text: F.concat(F.lit("F"), pr.site_year(text))
    lowest = F.transform("above", lambda texts: F.get(F.filter(F.transform(texts, year), lambda y: y.isNotNull()), F.lit(0)))
    # Generators keep conditions on their results above them, so years and numbers are read once.
    tables = statement_figures(pages, sections).select("page_id", "tab", "section", "figures", F.explode(F.array(lowest)).alias("periods"))
    dated = F.transform("figures", lambda f: F.struct(f["row"].alias("row"), f["label"].alias("label"), F.get("periods", f["at"]).alias("period"), f["text"].alias("text")))
    found = tables.select("page_id", "tab", "section", F.inline(dated)).where("period is not null")
    found = found.select("page_id", "tab", "section", "row", F.trim(F.regexp_replace("label", r"\s*[+\-]\s*$", "")).alias("label"), "period", nb.site_number(F.col("text")).alias("number"))
    found = found.select("page_id", "tab", "section", "row", "period", F.inline(F.array(F.struct("label", F.col("number").alias("value")))))
    return found.where("label <> '' and value is not null").select("page_id", "tab", "section", "row", "label", "period", "value")


def _statement_pages(spark, sf_dir) -> DataFrame:
    """A page for each order: its lines as rows of a table with prices of one year and quantities of the year before, a table inside the cell of every second line, and rows that span."""
    # One shuffle by order serves both aggregates; its partitions are not joined up by their bytes, as a page is many times as long as its lines.
    dealt = fixture(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    line = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").cast("decimal(18,2)").alias("p"), F.max("l_quantity").cast("int").alias("q"))
    inner = F.when(F.col("l_linenumber") % 2 == 0, "<table><thead><tr><th>x</th><th>Mar 2001</th></tr></thead><tbody><tr><td>inner</td><td>7</td></tr></tbody></table>").otherwise("")
    row = F.concat(F.lit("<tr><td><a href='#'>line "), "l_linenumber", F.lit("</a>&nbsp;+"), inner, F.lit("</td><td class='n'>"), F.format_number("p", 2), F.lit("</td><td>("), "q", F.lit(")</td></tr>"))
    body = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"]), "\n").alias("body"))
    head = "<html><!-- <table> --><section id='profit-loss'><table><thead><tr><th rowspan=2></th><th colspan='2'>Years</th></tr><tr><th>Mar 2020</th><th>Mar 2019</th></tr></thead><tbody>"
    tail = "<tr><td rowspan='2'>spanned</td><td>1</td><td>-</td></tr><tr><td>3</td><td>4 %</td></tr><tr><td>wide</td><td colspan='2'>9</td><td>10</td></tr></tbody></table></section><table><tr><td>no head</td><td>5</td></tr></table></html>"
    return body.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit(head), "body", F.lit(tail)).alias("html"))


SRC5_SQL = """with l as (select l_orderkey as page_id, l_linenumber as n, max(l_extendedprice)::double as p, max(l_quantity)::double as q, count(*) over (partition by l_orderkey) as many, row_number() over (partition by l_orderkey order by l_linenumber) as k
  from lineitem group by 1, 2), m as (select page_id, max(many) as many from l group by 1)
select page_id, 2 + k as row, concat('line ', n) as label, 'F2020' as period, p as value from l union all select page_id, 2 + k, concat('line ', n), 'F2019', -q from l
union all select page_id, 2, 'inner', 'F2001', 7 from l where n % 2 = 0
union all select page_id, many + r, label, period, v from m cross join (values (3, 'spanned', 'F2020', 1), (4, 'spanned', 'F2020', 3), (4, 'spanned', 'F2019', 4), (5, 'wide', 'F2020', 9)) t(r, label, period, v)"""


@query("src5_statement_tables", SRC5_SQL)
def src5_statements(spark, sf_dir):
    return statement_tables(_statement_pages(spark, sf_dir), ("profit-loss",)).select("page_id", "row", "label", "period", "value")


def grid_facts(cells: DataFrame, most_rows: int = 14, low: int = 1990, high: int = 2050) -> DataFrame:
    """Cell grid (sheet, row, col, text) to (sheet, row, label, period, value).

    The header is the first of the top most_rows rows with two periods or more; without one, the row with most periods, the upper of equals. Labels stand in the column without a period that has most text cells below the header, the left one of equals.
    Figures are numbers of a period's column in rows with a label; zeros go, and figures above 1e10 are rupees. A sheet without periods or texts has no rows."""
    sheet, row, col = (Window.partitionBy(*k) for k in (["sheet"], ["sheet", "row"], ["sheet", "col"]))
    # One shuffle by sheet serves all windows; a sheet is one worksheet.
    typed = cells.select("sheet", "row", "col", "text", pr.period(F.col("text"), low, high).alias("period"), nb.number(F.col("text")).alias("number")).repartition("sheet")
    given = F.col("period").isNotNull()
    seen = typed.withColumn("n", F.count("period").over(row))
    top_two = F.min(F.when(given & (F.col("n") >= 2) & (F.col("row") <= most_rows), F.col("row"))).over(sheet)
    seen = seen.withColumn("head", F.coalesce(top_two, F.max_by("row", F.when(given, F.struct("n", -F.col("row")))).over(sheet))).where("row >= head")
    seen = seen.withColumn("of", F.max(F.when(F.col("row") == F.col("head"), F.col("period"))).over(col)).where("row > head")
    word = F.col("number").isNull() & F.col("period").isNull() & F.col("of").isNull() & F.col("text").rlike(r"\p{L}")
    seen = seen.withColumn("word", word).withColumn("votes", F.count_if("word").over(col))
    seen = seen.withColumn("at", F.max_by("col", F.when(F.col("votes") > 0, F.struct("votes", -F.col("col")))).over(sheet))
    seen = seen.withColumn("label", F.max(F.when((F.col("col") == F.col("at")) & F.col("word"), F.trim("text"))).over(row))
    value = F.when(F.abs("number") > 1e10, F.col("number") / 1e7).otherwise(F.col("number"))
    return seen.where("label is not null and of is not null and number <> 0").select("sheet", "row", "label", F.col("of").alias("period"), value.alias("value"))


#: Every third sheet has its header in row 20 below a title, numbers its lines in column 1 and has labels in column 2.
SRC7_SQL = """with g as (select company_id as sheet, raw_label, fy, max(value) as value from fx_obs where source = 'xbrl' group by 1, 2, 3),
 r as (select *, dense_rank() over (partition by sheet order by raw_label) + case when sheet % 3 = 0 then 20 else 2 end as row from g)
 select sheet, cast(row as integer) as row, raw_label as label, concat('F', fy::varchar) as period, value from r"""


@query("src7_grid_facts", oracle(SRC7_SQL, "fx_obs"))
def src7(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_obs").where("source = 'xbrl'").groupBy(F.col("company_id").alias("sheet"), "raw_label", "fy").agg(F.max("value").alias("value"))
    deep = F.col("sheet") % 3 == 0
    head, shift = F.when(deep, 20).otherwise(2), F.when(deep, 1).otherwise(0)
    placed = rows.withColumn("row", F.dense_rank().over(Window.partitionBy("sheet").orderBy("raw_label")) + head)
    at = (F.col("fy") - 1990 + shift).alias("col")
    parts = [
        placed.select("sheet", "row", at, F.col("value").cast("decimal(20,2)").cast("string").alias("text")),
        placed.select("sheet", "row", (shift + 1).alias("col"), F.col("raw_label").alias("text")).distinct(),
        placed.where(deep).select("sheet", "row", F.lit(1).alias("col"), (F.col("row") - 20).cast("string").alias("text")).distinct(),
        placed.where(deep).select("sheet", F.lit(3).alias("row"), F.lit(2).alias("col"), F.lit("Figures FY2001 as filed").alias("text")).distinct(),
        placed.select("sheet", head.alias("row"), at, F.concat(F.lit("FY"), F.col("fy")).alias("text")).distinct(),
        # A second period for sheets that have one.
        placed.select("sheet", head.alias("row"), F.lit(30).alias("col"), F.lit("FY1990").alias("text")).distinct(),
    ]
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.union(p)
    return grid_facts(cells)


#: Depth down to which blocks are sought and items of a list that are looked at, if not said; fixed values: labels of a block, and its year keys.
DEEPEST, ITEMS, LEAST_LABELS, YEAR_KEY = 6, 20, 3, r"^(?:F?\d{4}|20\d{2}-\d{2})$"


def nested_blocks(raw: DataFrame, key: str, body: str, items: int | None = ITEMS, deepest: int = DEEPEST) -> DataFrame:
    """(key, label, period, value): the block {label: {year: number}} with most labels in each JSON text, of LEAST_LABELS or more, the first of equals in the order of the text.

    The text is one variant value, unrolled level by level in arrays of its own row; every number has its path, so a block is the numbers that share a path but for its last two steps. Nothing is shuffled, and a text meets no other.
    Nothing is sought inside a block, below the deepest level or after so many items of a list, all of them if items is None; what is given for both if nothing is said are the rules of the older search. A text that is no JSON gives nothing; keys come in the order that variants keep, by name."""

    def under(e: Column) -> Column:
        """The values one level below e, each with its path, the last name of that and the one before; null if e has none."""
        below = lambda v, i, name: F.struct(v.alias("v"), F.array_append(e["pos"], i).alias("pos"), e["name"].alias("label"), name.alias("name"))
        fields = F.transform(F.map_entries(F.try_variant_get(e["v"], "$", "map<string,variant>")), lambda x, i: below(x["value"], i, x["key"]))
        listed = F.try_variant_get(e["v"], "$", "array<variant>")
        return F.coalesce(fields, F.transform(listed if items is None else F.slice(listed, 1, items), lambda x, i: below(x, i, F.lit(None).cast("string"))))

    def cell(e: Column) -> Column:
        """A value of its own as a list of one cell, an empty one if it is no number under a year."""
        named = (F.size(e["pos"]) >= 2) & e["label"].isNotNull() & F.coalesce(e["name"].rlike(YEAR_KEY), F.lit(False))
        number = F.when(named, F.schema_of_variant(e["v"]).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")).otherwise(F.lit(False))
        at, value = F.slice(e["pos"], F.lit(1), F.size(e["pos"]) - 2), F.variant_get(e["v"], "$", "double")
        return F.filter(F.array(F.when(number, F.struct(at.alias("at"), e["label"].alias("label"), e["name"].alias("year"), value.alias("value")))), lambda c: c.isNotNull())

    def unrolled(e: Column, levels: int) -> Column:
        """The cells of e and of all below it; a value without any below is not looked at again."""
        return cell(e) if levels == 0 else F.coalesce(F.flatten(F.transform(under(e), lambda x: unrolled(x, levels - 1))), cell(e))

    place = "struct<at:array<int>,label:string,n:int>"

    def counted(a: Column, c: Column) -> Column:
        """Blocks of cells in order, the last one open: the labels of each are counted where they change."""
        last = F.try_element_at(a, F.lit(-1))
        one = F.struct(c["at"].alias("at"), c["label"].alias("label"), F.lit(1).alias("n"))
        more = F.struct(c["at"].alias("at"), c["label"].alias("label"), (last["n"] + F.when(last["label"] == c["label"], 0).otherwise(1)).alias("n"))
        closed = F.when(last["n"] >= LEAST_LABELS, a).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
        return F.when(F.size(a) == 0, F.array(one)).when(last["at"] == c["at"], F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(more))).otherwise(F.concat(closed, F.array(one)))

    def best(cells: Column) -> Column:
        """The place of the block: of those in no other one, that with most labels, the first of equals."""
        found = F.filter(F.aggregate(F.array_sort(F.transform(cells, lambda c: F.struct(c["at"].alias("at"), c["label"].alias("label")))), F.array().cast(f"array<{place}>"), counted), lambda b: b["n"] >= LEAST_LABELS)
        within = lambda b, bs: F.exists(bs, lambda p: (F.size(p["at"]) < F.size(b["at"])) & (p["at"] == F.slice(b["at"], F.lit(1), F.size(p["at"]))))
        outer = once(found, lambda bs: F.filter(bs, lambda b: ~within(b, bs)))
        return F.array_min(F.transform(outer, lambda b: F.struct((-b["n"]).alias("n"), b["at"].alias("at"))))["at"]

    texts = raw.select(F.col(key), F.try_parse_json(body).alias("v"))
    whole = F.struct(F.col("v"), F.array().cast("array<int>").alias("pos"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("name"))
    cells = unrolled(whole, deepest + 2)
    block = once(cells, lambda cs: once(best(cs), lambda at: F.filter(cs, lambda c: c["at"] == at)))
    # For a plain inline the optimizer puts a filter on the array before it, which unrolls the text again.
    return texts.select(key, F.inline_outer(block)).where("at is not null").select(key, "label", F.when(F.col("year").startswith("F"), F.col("year")).otherwise(F.concat(F.lit("F"), "year")).alias("period"), "value")


@query("src9_nested_block", "with c as (select l_orderkey, l_linenumber, max(year(l_shipdate)) as y, max(l_quantity) as q from lineitem group by 1, 2), n as (select *, count(*) over (partition by l_orderkey) as n from c) select l_orderkey as doc, concat('line ', l_linenumber) as label, concat('F', y) as period, cast(q as double) as value from n where n >= 3")
def src9(spark, sf_dir):
    rows = fixture(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.year("l_shipdate").alias("y"), F.col("l_quantity").cast("double").alias("q"))).alias("rows"))

    def entry(line: Column) -> Column:
        """A line's label with its last year and largest quantity."""
        same = F.filter("rows", lambda r: r["line"] == line)
        last, most = F.array_max(F.transform(same, lambda r: r["y"])), F.array_max(F.transform(same, lambda r: r["q"]))
        return F.struct(F.concat(F.lit("line "), line), F.create_map(last.cast("string"), most))

    lines = F.array_distinct(F.transform("rows", lambda r: r["line"]))
    block = rows.select("doc", F.to_json(F.map_from_entries(F.transform(lines, entry))).alias("block"))
    body = F.concat(F.lit('{"page":{"meta":[1,{"a":{"2024":1},"b":{"2024":2}}],"tables":[[],{"t":'), F.col("block"), F.lit("}]}}"))
    return nested_blocks(block.select("doc", body.alias("body")), "doc", "body", items=None)
