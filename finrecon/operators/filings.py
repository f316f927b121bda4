"""Pages, lines and sheets of filings: carried periods, scopes and statements (W3-W5, W11), prose figures (FLT23, L19, J26), tables in text (SRC6), page tests (FLT9, FLT15, FLT21, FLT22), routes (J15-J17, J20, J21), cash flow lines (L4), parts of balance sheets (L5), search texts (L17).

Lines are rows (filing, page_no, line_no, line), pages rows (filing, page_no, text). A filing is one document: windows and arrays over one are bounded by its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.functions import labels as lb, patterns as pt, periods as pr
from finrecon.functions.once import once
from finrecon.operators.joins import top
from finrecon.operators.texts import _TITLE_SQL, _first_sql, first_of, holds, page_title, quoted
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

#: A date with its year, or a fiscal year.
YEAR_MARK = rf"(?:(?:{pr.MONTHS})[a-z]*\s+\d{{1,2}},?\s*\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{pr.MONTHS})[a-z]*,?\s*\d{{4}}|\bfy?\s*['’]?(?:\d{{4}}|\d{{2}})\b)"
UP_TO_MARK = f"(?is).*?{YEAR_MARK}"
FIGURE = r"-?\(?\d+(?:,\d{2,3})*(?:\.\d+)?\)?"
PROSE = rf"^([A-Za-z][A-Za-z0-9 ,&/()'\"-]{{3,100}}?)\s+(?:\d{{1,3}}(?:\s*&\s*\d{{1,3}})?\s+)?((?:{FIGURE}\s+){{1,9}}{FIGURE})$"
BULLET = r"(?i)^\s*\(?\s*[a-z0-9]+\s*[).]\s*"
#: Between the groups of a prose line in one text: a sign that no prose line holds.
BETWEEN = "\1"
PLACE = ("page_no", "line_no")


def _carried(filing: str) -> Window:
    return Window.partitionBy(filing).orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)


def _chain(text: Column, rules) -> Column:
    """The first value of (value, pattern) rules that the text matches, or null."""
    out = F
    for value, pattern in rules:
        out = out.when(text.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(None))


def _chain_sql(text: str, rules) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, {quoted(p)}) then {quoted(v)}" for v, p in rules) + " end"


def year_marks(line: Column, low: int = 1990, high: int = 2050) -> Column:
    """Fiscal years of a line's dates and marks from left to right, as F2024; a year equal to the one before and within 30 characters of it is the same column."""
    marks = F.transform(F.regexp_extract_all(line, F.lit(UP_TO_MARK), F.lit(0)), lambda c: F.struct(pr.full_year(F.regexp_extract(c, r"(\d+)$", 1)).alias("y"), F.length(c).alias("n")))
    named = lambda ms: F.transform(F.filter(ms, lambda m, i: m["y"].between(low, high) & ((i == 0) | (m["n"] >= 30) | (F.get(ms, i - 1)["y"] != m["y"]))), lambda m: F.concat(F.lit("F"), m["y"].cast("string")))
    # A line without a digit has no mark; the search for one would try every place of it.
    return F.when(line.rlike("[0-9]"), once(marks, named)).when(line.isNotNull(), F.array().cast("array<string>"))


def with_periods(lines: DataFrame) -> DataFrame:
    """Adds periods, those of the last header: a line with two years or more sets them; one with a single year sets that and the one before, if no line has set any. Table lines, blank ones and those over 300 characters are no headers."""
    t = F.trim("line")
    usable = ~(t.startswith("|") | t.startswith("---") | (t == "")) & (F.length(t) <= 300)
    w = Window.partitionBy("filing").orderBy(*PLACE)
    marked = lines.withColumn("_m", F.when(usable, year_marks(t)))
    first = F.coalesce(F.count_if(F.size("_m") > 0).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    year = F.substring(F.get("_m", F.lit(0)), 2, 4).try_cast("int")
    seed = F.array(F.get("_m", F.lit(0)), F.concat(F.lit("F"), (year - 1).cast("string")))
    head = F.when(F.size("_m") >= 2, F.col("_m")).when((F.size("_m") == 1) & first, seed)
    return marked.withColumn("_h", head).withColumn("periods", F.last("_h", ignorenulls=True).over(_carried("filing"))).drop("_m", "_h")


_YEARS_SQL = f"""u as (select *, trim(line) as t from fx_filed_line), v as (select *, not (t like '|%' or t like '---%' or t = '') and length(t) <= 300 as usable from u),
 c as (select *, case when usable then list_transform(regexp_extract_all(t, {quoted(UP_TO_MARK)}), lambda c: struct_pack(d := regexp_extract(c, '(\\d+)$', 1), n := length(c))) end as ds from v),
 m0 as (select *, list_transform(ds, lambda s: struct_pack(y := case when length(s.d) = 4 then s.d::int when s.d::int < 50 then 2000 + s.d::int else 1900 + s.d::int end, n := s.n)) as ms from c),
 m as (select *, list_transform(list_filter(ms, lambda s, i: s.y between 1990 and 2050 and (i = 1 or s.n >= 30 or ms[i - 1].y <> s.y)), lambda s: concat('F', s.y)) as marks from m0),
 h as (select *, case when len(marks) >= 2 then marks when len(marks) = 1 and coalesce(count(*) filter (where len(marks) > 0) over (partition by filing order by page_no, line_no rows between unbounded preceding and 1 preceding), 0) = 0 then [marks[1], concat('F', marks[1][2:]::int - 1)] end as head from m),
 p as (select *, last_value(head ignore nulls) over (partition by filing order by page_no, line_no rows unbounded preceding) as periods from h)"""


@query("w05_header_fill", oracle(f"with {_YEARS_SQL} select filing, page_no, line_no, array_to_string(periods, ',') as periods from p", "fx_filed_line"))
def w05(spark, sf_dir):
    return with_periods(fixture(spark, sf_dir, "fx_filed_line")).select("filing", "page_no", "line_no", F.array_join("periods", ",").alias("periods"))


def scope_mark(line: Column, headings=pt.SCOPE_HEADINGS) -> Column:
    """The scope that a line puts in force: its mark, else its heading, else null."""
    mark = F.regexp_extract(line, pt.SCOPE_MARK, 1)
    return F.when(mark.isin("STANDALONE", "CONSOLIDATED"), F.lower(mark)).when(mark.startswith("UNKNOWN"), "unknown").when(mark == "", _chain(line, headings))


def with_scope(lines: DataFrame) -> DataFrame:
    """Adds scope, the one in force at the line; unknown before the first."""
    return lines.withColumn("_s", scope_mark(F.col("line"))).withColumn("scope", F.coalesce(F.last("_s", ignorenulls=True).over(_carried("filing")), F.lit("unknown"))).drop("_s")


_SCOPE_SQL = f"""coalesce(last_value(case when regexp_extract(line, {quoted(pt.SCOPE_MARK)}, 1) in ('STANDALONE', 'CONSOLIDATED') then lower(regexp_extract(line, {quoted(pt.SCOPE_MARK)}, 1)) when regexp_extract(line, {quoted(pt.SCOPE_MARK)}, 1) like 'UNKNOWN%' then 'unknown'
 when regexp_extract(line, {quoted(pt.SCOPE_MARK)}, 1) = '' then {_chain_sql('line', pt.SCOPE_HEADINGS)} end ignore nulls) over (partition by filing order by page_no, line_no rows unbounded preceding), 'unknown') as scope"""


def with_statement(lines: DataFrame, starts=pt.STATEMENT_STARTS, parts=pt.BALANCE_PARTS) -> DataFrame:
    """Adds the statement and its scope that a line lies in, and the part of the balance sheet; a new statement ends the part."""
    t, start = F.trim("line"), F
    for scope, kind, pattern in starts:
        start = start.when(t.rlike(pattern), F.struct(F.lit(scope).alias("scope"), F.lit(kind).alias("kind")))
    # A line that begins a statement begins its part anew, with its own mark or none: both states come from one window, which sorts a filing once and holds the marks alone.
    marked = lines.withColumns({"_b": start.otherwise(F.lit(None)), "_p": _chain(t, parts)})
    event = F.when(F.col("_b").isNotNull() | F.col("_p").isNotNull(), F.struct(F.col("_p").alias("part")))
    w = _carried("filing")
    inside = marked.withColumn("_e", event).withColumns({"_in": F.last("_b", ignorenulls=True).over(w), "_at": F.last("_e", ignorenulls=True).over(w)})
    return inside.withColumns({"statement": F.col("_in.kind"), "statement_scope": F.col("_in.scope"), "part": F.col("_at.part")}).drop("_b", "_p", "_e", "_in", "_at")


_STATES_SQL = f"""b as (select *, {_chain_sql('trim(line)', [(f'{s} {k}', p) for s, k, p in pt.STATEMENT_STARTS])} as start, {_chain_sql('trim(line)', pt.BALANCE_PARTS)} as p from fx_filed_line),
 g as (select *, count(start) over w as seg, last_value(start ignore nulls) over w as inside from b window w as (partition by filing order by page_no, line_no rows unbounded preceding)),
 s as (select *, split_part(inside, ' ', 1) as statement_scope, split_part(inside, ' ', 2) as statement, last_value(p ignore nulls) over (partition by filing, seg order by page_no, line_no rows unbounded preceding) as part from g)"""


@query("w04_carried_state", oracle(f"with {_STATES_SQL} select filing, page_no, line_no, statement, statement_scope, part from s", "fx_filed_line"))
def w04(spark, sf_dir):
    return with_statement(fixture(spark, sf_dir, "fx_filed_line")).select("filing", "page_no", "line_no", "statement", "statement_scope", "part")


def field_in_part(label: Column, part: Column, fields=pt.FIELDS_BY_PART) -> Column:
    """Field of a bare label by the part of the balance sheet; the first pattern decides, null where the part has none."""
    out = F
    for pattern, by_part in fields:
        pick = F
        for name, field in by_part.items():
            pick = pick.when(part == name, field)
        out = out.when(F.trim(label).rlike(pattern), pick.otherwise(F.lit(None)))
    return out.otherwise(F.lit(None))


_FIELD_SQL = "case " + " ".join(f"when regexp_matches(trim(line), {quoted(p)}) then case part " + " ".join(f"when '{n}' then '{f}'" for n, f in by.items()) + " end" for p, by in pt.FIELDS_BY_PART) + " end"


@query("l5_field_in_part", oracle(f"with {_STATES_SQL}, f as (select *, {_FIELD_SQL} as field from s) select filing, page_no, line_no, field from f where field is not null", "fx_filed_line"))
def l5_part(spark, sf_dir):
    states = with_statement(fixture(spark, sf_dir, "fx_filed_line"))
    return states.withColumn("field", field_in_part(F.col("line"), F.col("part"))).where("field is not null").select("filing", "page_no", "line_no", "field")


@query("j16_row_section", oracle(f"with {_STATES_SQL}, k as (select filing, trim(line) as label, min(page_no * 1000 + line_no) as at_all, min(case when statement_scope = 'consolidated' then page_no * 1000 + line_no end) as inside from s group by 1, 2) select filing, label, cast(floor(coalesce(inside, at_all) / 1000) as bigint) as page_no, cast(coalesce(inside, at_all) % 1000 as integer) as line_no, inside is not null as in_section from k", "fx_filed_line"))
def j16(spark, sf_dir, wanted: str = "consolidated"):
    """First row of a label in the wanted block of a sheet, else its first row anywhere."""
    place = F.struct(*PLACE)
    rows = with_statement(fixture(spark, sf_dir, "fx_filed_line")).groupBy("filing", F.trim("line").alias("label"))
    found = rows.agg(F.min(F.when(F.col("statement_scope") == wanted, place)).alias("inside"), F.min(place).alias("first"))
    at = F.coalesce("inside", "first")
    return found.select("filing", "label", at["page_no"].alias("page_no"), at["line_no"].alias("line_no"), F.col("inside").isNotNull().alias("in_section"))


def figures(text: Column) -> Column:
    """All figures of a text; brackets are negative."""
    one = F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0))
    plain = F.transform(one, lambda x: F.struct(F.regexp_replace(x, "[(),]", "").try_cast("double").alias("v"), (x.contains("(") & x.contains(")")).alias("minus")))
    return F.filter(F.transform(plain, lambda x: F.when(x["minus"], -x["v"]).otherwise(x["v"])), lambda v: v.isNotNull())


def prose_lines(lines: DataFrame) -> DataFrame:
    """Lines outside tables that hold a label and two to ten figures, perhaps with a note reference between: adds label and values. Left out: lines over 300 characters, labels under 4 after a bullet, values that are all years or all below 1."""
    t = F.trim("line")
    # The pattern is tried once, on lines that begin and end as it does; its two groups come back around a mark that neither can hold.
    usable = ~(t.startswith("|") | t.startswith("---")) & (F.length(t) <= 300) & t.rlike("^[A-Za-z]") & t.rlike(r"[\d)]$")
    split = F.regexp_replace(t, PROSE, f"$1{BETWEEN}$2")
    label = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.substring_index(s, BETWEEN, 1), "[- :]+$", ""), BULLET, ""))
    both = once(split, lambda s: F.when(s != t, F.struct(label(s).alias("label"), figures(F.substring_index(s, BETWEEN, -1)).alias("values"))))
    years = lambda vs: F.forall(vs, lambda v: (F.abs(v) > 1990) & (F.abs(v) < 2100) & (v == F.floor(v)))
    good = lambda x: (F.length(x["label"]) >= 4) & (F.size(x["values"]) >= 2) & ~years(x["values"]) & ~F.forall(x["values"], lambda v: F.abs(v) < 1)
    # A generator: conditions on what it gives are not moved below it, where they would read the line again.
    read = lines.where(usable).select(*lines.columns, F.explode(F.filter(F.array(both), good)).alias("_x"))
    return read.select(*lines.columns, F.col("_x.label").alias("label"), F.col("_x.values").alias("values"))


_PROSE_SQL = f"""r as (select *, trim(line) as tl from fx_filed_line where not (trim(line) like '|%' or trim(line) like '---%') and length(trim(line)) <= 300 and regexp_matches(trim(line), {quoted(PROSE)})),
 l as (select *, trim(regexp_replace(regexp_replace(regexp_extract(tl, {quoted(PROSE)}, 1), '[- :]+$', ''), {quoted(BULLET)}, '')) as label,
  list_transform(regexp_extract_all(regexp_extract(tl, {quoted(PROSE)}, 2), {quoted(FIGURE)}), lambda x: case when contains(x, '(') and contains(x, ')') then -1 else 1 end * regexp_replace(x, '[(),]', '', 'g')::double) as vals from r),
 a as (select * from l where length(label) >= 4 and len(vals) >= 2 and len(list_filter(vals, lambda v: not (abs(v) > 1990 and abs(v) < 2100 and v = floor(v)))) > 0 and len(list_filter(vals, lambda v: abs(v) >= 1)) > 0)"""


@query("flt23_prose_lines", oracle(f"with {_PROSE_SQL} select filing, page_no, line_no, label, cast(len(vals) as integer) as figures from a", "fx_filed_line"))
def flt23(spark, sf_dir):
    return prose_lines(fixture(spark, sf_dir, "fx_filed_line")).select("filing", "page_no", "line_no", "label", F.size("values").alias("figures"))


def prose_pairs(lines: DataFrame) -> DataFrame:
    """Prose lines to (label, period, scope, value, kind): figures from left to right belong to the periods in force from left to right."""
    read = prose_lines(with_scope(with_periods(lines))).where("periods is not null")
    n = F.least(F.size("values"), F.size("periods"))
    cells = read.select("filing", *PLACE, "label", "scope", F.posexplode(F.arrays_zip(F.slice("values", F.lit(1), n).alias("value"), F.slice("periods", F.lit(1), n).alias("period"))).alias("k", "cell"))
    kind = F.when(F.col("k") == 0, "current").when(F.col("k") == 1, "prior").otherwise(F.concat(F.lit("col"), (F.col("k") + 1).cast("string")))
    return cells.select("filing", *PLACE, "label", F.col("cell.period").alias("period"), "scope", F.col("cell.value").alias("value"), kind.alias("kind"))


@query("l19_prose_pairs", oracle(f"with {_YEARS_SQL}, {_PROSE_SQL}, o as (select filing, page_no, line_no, {_SCOPE_SQL} from fx_filed_line), z as (select a.filing, a.page_no, a.line_no, label, scope, vals, periods, unnest(range(1, least(len(vals), len(periods)) + 1)) as k from a join p using (filing, page_no, line_no) join o using (filing, page_no, line_no) where periods is not null) select filing, page_no, line_no, label, periods[k] as period, scope, vals[k] as value, case k when 1 then 'current' when 2 then 'prior' else concat('col', k) end as kind from z", "fx_filed_line"))
def l19(spark, sf_dir):
    return prose_pairs(fixture(spark, sf_dir, "fx_filed_line"))


def found_figures(lines: DataFrame, specs: DataFrame, most_pages: int = 5) -> DataFrame:
    """The figure for each (label, period) of specs, a list written by hand, in each filing. Searched are the pages that hold most words of the label, most_pages of them: first for a prose pair of the period whose label equals, holds or lies in the wanted one,
    lengths at most 25 apart; else for a line that holds the label and has a figure at the period's place among the periods in force. There, years and whole numbers below 1000 are no figures. Ties: better page, then earlier line."""
    wanted = F.broadcast(specs.select("label", "period", lb.normal(F.col("label")).alias("want"), lb.tokens(F.col("label")).alias("words")).where("length(want) >= 4"))
    text = with_periods(lines).withColumn("norm", lb.normal(F.col("line")))
    page_words = text.groupBy("filing", "page_no").agg(F.array_distinct(F.flatten(F.collect_list(F.split("norm", " ")))).alias("on_page"))
    share = F.size(F.array_intersect("on_page", "words")) / F.size("words")
    pages = top(page_words.join(wanted, F.arrays_overlap("on_page", "words")).withColumn("score", share), ["filing", "label", "period"], [F.desc("score"), F.col("page_no")], most_pages)
    pages = pages.select("filing", "page_no", "label", "period", "want", "score")
    pairs = prose_pairs(lines).select("filing", *PLACE, F.col("period").alias("of"), lb.normal(F.col("label")).alias("norm"), "value")
    met = pages.join(pairs, ["filing", "page_no"]).where("of = period and norm <> '' and (contains(want, norm) or contains(norm, want)) and abs(length(want) - length(norm)) <= 25")
    by_pair = met.select("filing", "label", "period", "score", *PLACE, "value", F.lit(0).alias("step"))
    real = F.filter(figures(F.col("line")), lambda v: ~((v == F.floor(v)) & ((F.abs(v) < 1000) | F.abs(v).between(1991, 2099))))
    lined = pages.join(text.where(~F.trim("line").startswith("|") & ~F.trim("line").startswith("---")), ["filing", "page_no"]).where("contains(norm, want)")
    value = F.when(F.array_position("periods", F.col("period")) > 0, F.get(real, (F.array_position("periods", F.col("period")) - 1).cast("int")))
    by_line = lined.select("filing", "label", "period", "score", *PLACE, value.alias("value"), F.lit(1).alias("step")).where("value is not null")
    best = F.min_by(F.struct("value", "step", "score", "page_no"), F.struct("step", -F.col("score"), *PLACE))
    chosen = by_pair.union(by_line).groupBy("filing", "label", "period").agg(best.alias("b"))
    return chosen.select("filing", "label", "period", "b.value", F.when((F.col("b.step") == 0) & (F.col("b.score") > 0.5), "HIGH").otherwise("MEDIUM").alias("confidence"), "b.page_no")


@query("j26_pattern_from_chunks")
def j26(spark, sf_dir):
    specs = [(label, period) for label in ("Revenue from operations", "Borrowings", "Lease liabilities", "Finance cost", "Provisions") for period in ("F2024", "F2023", "F2021")]
    return found_figures(fixture(spark, sf_dir, "fx_filed_line"), spark.createDataFrame(specs, "label string, period string"))


def markdown_tables(lines: DataFrame) -> DataFrame:
    """Tables between bars to cells (filing, page_no, tbl, row, col, text, scope): a line with bars at both ends and a rule of dashes below begins one, row 0; the lines with a bar in front below are its body; without body it is none. tbl is the line of its head."""
    t = F.trim("line")
    by = Window.partitionBy("filing", "page_no").orderBy("line_no")
    marked = with_scope(lines).withColumns({"_bar": t.startswith("|"), "_head": t.startswith("|") & t.endswith("|") & F.coalesce(F.trim(F.lead("line").over(by)).rlike(r"^\|[\s:|-]+\|"), F.lit(False))})
    island = Window.partitionBy("filing", "page_no", "_run")
    runs = marked.withColumn("_run", F.count_if(~F.col("_bar")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_bar")
    runs = runs.withColumns({"tbl": F.min(F.when(F.col("_head"), F.col("line_no"))).over(island), "_last": F.max("line_no").over(island)})
    rows = runs.where("line_no >= tbl and line_no <> tbl + 1 and _last > tbl + 1").withColumn("row", F.col("line_no") - F.col("tbl") - (F.col("line_no") > F.col("tbl")).cast("int"))
    cells = rows.select("filing", "page_no", "tbl", "row", "scope", F.posexplode(F.split(F.regexp_replace(t, r"^\|+|\|+$", ""), r"\|")).alias("k", "cell"))
    return cells.select("filing", "page_no", "tbl", "row", (F.col("k") + 1).alias("col"), F.trim("cell").alias("text"), "scope")


@query("src6_markdown_tables", oracle(rf"with o as (select *, trim(line) as t, {_SCOPE_SQL}, lead(trim(line)) over (partition by filing, page_no order by line_no) as below from fx_filed_line), m as (select *, t like '|%' and t like '%|' and coalesce(regexp_matches(below, '^\|[\s:|-]+\|'), false) as head, count(*) filter (where t not like '|%') over (partition by filing, page_no order by line_no rows unbounded preceding) as run from o), r as (select *, min(case when head then line_no end) over w as tbl, max(line_no) over w as last from m where t like '|%' window w as (partition by filing, page_no, run)), c as (select *, string_split(regexp_replace(t, '^\|+|\|+$', '', 'g'), '|') as cs from r where line_no >= tbl and line_no <> tbl + 1 and last > tbl + 1), x as (select *, unnest(range(1, len(cs) + 1)) as k from c) select filing, page_no, tbl, line_no - tbl - (line_no > tbl)::int as row, k::int as col, trim(cs[k]) as text, scope from x", "fx_filed_line"))
def src6(spark, sf_dir):
    return markdown_tables(fixture(spark, sf_dir, "fx_filed_line"))


def filing_bounds(pages: DataFrame, starts=pt.SCOPE_STARTS, end: str = pt.FILING_END) -> DataFrame:
    """First page of each scope by the first 3000 characters of its pages, and the first end mark after the consolidated start."""
    head = F.substring("text", 1, 3000)
    first = [F.min(F.when(head.rlike(p), F.col("page_no"))).alias(scope) for scope, p in starts]
    found = pages.groupBy("filing").agg(*first, F.collect_set(F.when(head.rlike(end), F.col("page_no"))).alias("_ends"))
    return found.withColumn("ends", F.array_min(F.filter("_ends", lambda p: p > F.col("consolidated")))).drop("_ends")


_BOUNDS_SQL = "s as (select *, " + ", ".join(f"min(case when regexp_matches(left(text, 3000), {quoted(p)}) then page_no end) over (partition by filing) as {s}" for s, p in pt.SCOPE_STARTS) + f", regexp_matches(left(text, 3000), {quoted(pt.FILING_END)}) as fin from fx_filed_page), b as (select filing, min(standalone) as standalone, min(consolidated) as consolidated, min(case when fin and page_no > consolidated then page_no end) as ends from s group by 1)"


@query("w03_first_marker_page", oracle(f"with {_BOUNDS_SQL} select * from b", "fx_filed_page"))
def w03(spark, sf_dir):
    return filing_bounds(fixture(spark, sf_dir, "fx_filed_page"))


def page_scopes(pages: DataFrame) -> DataFrame:
    """Adds the scope of the part a page lies in: standalone from its start to the consolidated one, consolidated from there to the end mark, else unknown; with one start only, all from it on."""
    p, s, c, e = (F.col(n) for n in ("page_no", "standalone", "consolidated", "ends"))
    both = F.when(p < s, "unknown").when(p < c, "standalone").when(e.isNotNull() & (p >= e), "unknown").otherwise("consolidated")
    scope = F.when(s.isNotNull() & c.isNotNull(), both).when(p >= s, "standalone").when(p >= c, "consolidated").otherwise("unknown")
    return pages.join(filing_bounds(pages), "filing").withColumn("scope", scope).drop("standalone", "consolidated", "ends")


_PAGE_SCOPE_SQL = _BOUNDS_SQL + ", ps as (select f.*, case when standalone is not null and consolidated is not null then case when page_no < standalone then 'unknown' when page_no < consolidated then 'standalone' when page_no >= ends then 'unknown' else 'consolidated' end when page_no >= standalone then 'standalone' when page_no >= consolidated then 'consolidated' else 'unknown' end as scope from fx_filed_page f join b using (filing))"


@query("j15_page_scope", oracle(f"with {_PAGE_SCOPE_SQL} select filing, page_no, scope from ps", "fx_filed_page"))
def j15(spark, sf_dir):
    return page_scopes(fixture(spark, sf_dir, "fx_filed_page")).select("filing", "page_no", "scope")


def sheet_section(sheet: Column, needs=pt.SHEET_NEEDS) -> Column:
    """What a sheet needs by its name; profit and loss if nothing else."""
    low = F.lower(sheet)
    return F.coalesce(F.when(low.rlike(r"\bbs\b") & ~holds(low, needs[0][1]), "balance_sheet"), first_of(low, needs), F.lit("p_and_l"))


@query(
    "j20_page_routes",
    oracle(
        f"with {_PAGE_SCOPE_SQL}, t0 as (select *, lower(left(text, 1500)) as head from ps), t1 as (select *, lower({_TITLE_SQL}) as title from t0), t as (select *, {_first_sql('title', pt.TITLE_NEEDS)} as section from t1), n as (select distinct sheet, unnest(['consolidated', 'standalone']) as wanted from fx_sheet), k as (select *, coalesce(case when regexp_matches(lower(sheet), '\\bbs\\b') and not {_first_sql('lower(sheet)', pt.SHEET_NEEDS[:1])} is not null then 'balance_sheet' end, {_first_sql('lower(sheet)', pt.SHEET_NEEDS)}, 'p_and_l') as section from n), j as (select sheet, wanted, filing, page_no, row_number() over (partition by sheet, wanted, filing order by page_no) as r from k join t using (section) where scope in (wanted, 'unknown')) select sheet, wanted, filing, page_no from j where r <= 3",
        "fx_filed_page",
        "fx_sheet",
    ),
)
def j20(spark, sf_dir):
    """The first three pages for each sheet, scope and filing: the title fits the sheet, the scope is the wanted one or unknown."""
    pages = page_scopes(fixture(spark, sf_dir, "fx_filed_page"))
    titled = pages.withColumn("title", F.lower(page_title(F.col("text")))).withColumn("section", first_of(F.col("title"), pt.TITLE_NEEDS)).drop("text", "title")
    sheets = fixture(spark, sf_dir, "fx_sheet").select("sheet").distinct().select("sheet", F.explode(F.array(F.lit("consolidated"), F.lit("standalone"))).alias("wanted"), sheet_section(F.col("sheet")).alias("section"))
    met = titled.join(sheets, "section").where("scope in (wanted, 'unknown')")
    return top(met, ["sheet", "wanted", "filing"], [F.col("page_no")], 3).select("sheet", "wanted", "filing", "page_no")


@query("j21_first_route", oracle(f"select id, sheet, coalesce({_first_sql('lower(sheet)', pt.SHEET_ROUTES)}, 'all') as kinds from fx_sheet", "fx_sheet"))
def j21(spark, sf_dir):
    """Kinds of source sheets to search for a sheet, best first; the first route with a keyword in the name decides, all kinds if none does."""
    return fixture(spark, sf_dir, "fx_sheet").select("id", "sheet", F.coalesce(first_of(F.lower("sheet"), pt.SHEET_ROUTES), F.lit("all")).alias("kinds"))


def assigned_columns(words: DataFrame, heads: DataFrame, alone: float = 50.0) -> DataFrame:
    """Words (page, x) to the nearest column head of their page, at most half of the smallest gap between heads away (alone, if there is one head). The heads of a page are few."""
    centers = heads.groupBy("page").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("xs") - 1), lambda i: F.get("xs", i) - F.get("xs", i - 1))
    reach = centers.withColumn("reach", F.when(F.size("xs") > 1, F.array_min(gaps) / 2).otherwise(alone))
    near = F.array_min(F.transform("xs", lambda c: F.struct(F.abs(F.col("x") - c).alias("d"), c.alias("center"))))
    return words.join(reach, "page").withColumn("near", near).where("near.d <= reach").select("page", "x", F.col("near.center").alias("center"))


@query("j17_nearest_column", "with w as (select distinct l_orderkey as page, cast(l_quantity as double) * 10 as x, l_returnflag = 'A' as head from lineitem), c as (select page, list_sort(list(x)) as xs from w where head group by 1), r as (select *, case when len(xs) > 1 then list_min(list_transform(range(2, len(xs) + 1), lambda i: xs[i] - xs[i - 1])) / 2 else 50.0 end as reach from c), n as (select page, x, reach, list_min(list_transform(xs, lambda c: [abs(x - c), c])) as near from w join r using (page) where not head) select page, x, near[2] as center from n where near[1] <= reach")
def j17(spark, sf_dir):
    rows = fixture(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity").cast("double") * 10).alias("x"), (F.col("l_returnflag") == "A").alias("head")).distinct()
    return assigned_columns(rows.where("not head"), rows.where("head"))


def sound_blocks(rows: DataFrame, block: str, label: str, least: int = 5, long: int = 70, share: float = 0.6) -> DataFrame:
    """Blocks with least labels or more, at most that share of them longer than long."""
    counts = rows.groupBy(block, label).agg(F.lit(1).alias("one")).groupBy(block).agg(F.count("*").alias("labels"), F.count_if(F.length(label) > long).alias("long_labels"))
    return counts.where((F.col("labels") >= least) & (F.col("long_labels") <= share * F.col("labels")))


@query("flt9_block_quality", oracle("with b as (select id as block, count(distinct label) as labels, count(distinct label) filter (where length(label) > 70) as long_labels from fx_raw_label group by 1) select * from b where labels >= 5 and long_labels <= 0.6 * labels", "fx_raw_label"))
def flt9(spark, sf_dir):
    return sound_blocks(fixture(spark, sf_dir, "fx_raw_label").withColumnRenamed("id", "block"), "block", "label")


#: Pages and characters of a cover that are read, by kind.
COVER_READS = {"annual": (10, 25000), "quarterly": (3, 6000), "presentation": (3, 6000)}


def verified_covers(pages: DataFrame, rejects: str = pt.COVER_REJECTS, needs=pt.COVER_NEEDS) -> DataFrame:
    """Whether the first pages of a filing fit its kind: the first two hold no sign of another document, the first ten of an annual report or three of others hold a sign of the kind; those without text pass, and so do other kinds."""
    ranked = pages.withColumn("_k", F.row_number().over(Window.partitionBy("filing").orderBy("page_no"))).where("_k <= 10")
    read = ranked.groupBy("filing", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "text"))), lambda p: p["text"]).alias("ts"))
    junk = F.substring(F.array_join(F.slice("ts", 1, 2), "\n"), 1, 4000).rlike(rejects)
    fits, blank = F, F
    for kind, pattern in needs.items():
        n, chars = COVER_READS[kind]
        head = F.array_join(F.slice("ts", 1, n), "\n")
        fits = fits.when(F.col("kind") == kind, F.substring(head, 1, chars).rlike(pattern) | (F.trim(F.translate(head, "\n", "")) == ""))
    return read.select("filing", "kind", (~junk & fits.otherwise(F.lit(True))).alias("verified"))


def _cover_sql(kind: str) -> str:
    n, chars = COVER_READS[kind]
    head = f"array_to_string(ts[1:{n}], chr(10))"
    return f"when '{kind}' then regexp_matches(left({head}, {chars}), {quoted(pt.COVER_NEEDS[kind])}) or trim(replace({head}, chr(10), '')) = ''"


@query("flt15_cover_check", oracle("with r as (select *, case filing % 3 when 0 then 'annual' when 1 then 'quarterly' else 'presentation' end as kind, row_number() over (partition by filing order by page_no) as k from fx_cover_page), t as (select filing, kind, list(text order by k) as ts from r where k <= 10 group by 1, 2) " + f"select filing, kind, not regexp_matches(left(array_to_string(ts[1:2], chr(10)), 4000), {quoted(pt.COVER_REJECTS)}) and case kind " + " ".join(map(_cover_sql, pt.COVER_NEEDS)) + " end as verified from t", "fx_cover_page"))
def flt15(spark, sf_dir):
    kind = F.when(F.col("filing") % 3 == 0, "annual").when(F.col("filing") % 3 == 1, "quarterly").otherwise("presentation")
    return verified_covers(fixture(spark, sf_dir, "fx_cover_page").withColumn("kind", kind))


def page_ranges(pages: DataFrame, large: int = 80, probes: int = 40, most: int | None = None) -> DataFrame:
    """Adds kept and probed. Of more than large pages those from a quarter to 97 percent are kept, up to page most if given; probed for the sector are the first probes of those before 12 percent and from 35 to 55 percent."""
    by = Window.partitionBy("filing")
    i, n = F.col("_i"), F.col("_n")
    rows = pages.withColumns({"_i": F.row_number().over(by.orderBy("page_no")) - 1, "_n": F.count("*").over(by)})
    middle = i.between(F.floor(n * 0.35), F.floor(n * 0.55) - 1)
    probe = (i < F.floor(n * 0.12)) | middle
    before = F.when(middle & (i >= F.floor(n * 0.12)), F.floor(n * 0.12) + i - F.floor(n * 0.35)).otherwise(i)
    kept = (n <= large) | i.between(F.floor(n * 0.25), F.floor(n * 0.97))
    return rows.withColumns({"kept": kept & (i < most) if most else kept, "probed": probe & (before < probes)}).drop("_i", "_n")


@query("flt21_page_share", oracle("with r as (select *, row_number() over (partition by filing order by page_no) - 1 as i, count(*) over (partition by filing) as n from fx_pages), p as (select *, i < floor(n * 0.12) or i between floor(n * 0.35) and floor(n * 0.55) - 1 as pr from r), c as (select *, sum(pr::int) over (partition by filing order by i rows unbounded preceding) as k from p) select filing, page_no, n <= 80 or i between floor(n * 0.25) and floor(n * 0.97) as kept, pr and k <= 40 as probed from c", "fx_pages"))
def flt21(spark, sf_dir):
    return page_ranges(fixture(spark, sf_dir, "fx_pages")).select("filing", "page_no", "kept", "probed")


def relevant_pages(pages: DataFrame, few: int = 10, most: int = 30, words=pt.SLIDE_WORDS) -> DataFrame:
    """Pages worth reading: all of filings of few pages and of other kinds than presentations, of presentations the first most with a word of words."""
    counted = pages.withColumn("_all", (F.count("*").over(Window.partitionBy("filing")) <= few) | (F.col("kind") != "presentation"))
    slides = top(counted.where(~F.col("_all") & holds(F.lower("text"), words)), ["filing"], [F.col("page_no")], most)
    return counted.where("_all").select("filing", "page_no").union(slides.select("filing", "page_no"))


_SLIDES = "(" + " or ".join(f"contains(lower(text), {quoted(w)})" for w in pt.SLIDE_WORDS) + ")"


@query("flt22_relevant_pages", oracle(f"with r as (select *, filing % 2 = 1 or count(*) over (partition by filing) <= 10 as everything from fx_cover_page), k as (select *, row_number() over (partition by filing order by page_no) as k from r where everything or {_SLIDES}) select filing, page_no from k where everything or k <= 30", "fx_cover_page"))
def flt22(spark, sf_dir):
    return relevant_pages(fixture(spark, sf_dir, "fx_cover_page").withColumn("kind", F.when(F.col("filing") % 2 == 0, "presentation").otherwise("annual")))


def first_periods(text: Column, most: int = 3, lines: int = 50) -> Column:
    """Fiscal years of the first lines of a text from left to right, each once, most of them; bare years of this century count only where there is no other mark."""
    bare = lambda ls: F.transform(F.regexp_extract_all(F.array_join(ls, "\n"), F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: F.concat(F.lit("F"), y))
    years = lambda ls: once(F.flatten(F.transform(ls, lambda line: year_marks(line))), lambda marks: F.when(F.size(marks) > 0, marks).otherwise(bare(ls)))
    return F.slice(F.array_distinct(once(F.slice(F.split(text, "\n"), 1, lines), years)), 1, most)


@query("w11_period_order")
def w11(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_filed_page").select("filing", "page_no", F.array_join(first_periods(F.col("text")), ",").alias("periods"))


@query("l4_first_pattern", oracle(f"select id, line, label, {_chain_sql('lower(label)', pt.CASH_FLOW_LINES)} as concept from fx_raw_label", "fx_raw_label"))
def l4(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_raw_label").select("id", "line", "label", lb.first_pattern(F.lower("label"), pt.CASH_FLOW_LINES).alias("concept"))


#: Last day of the quarters of a fiscal year, and whether it lies in the year before.
QUARTER_ENDS = {"1": ("June 30", 1), "2": ("September 30", 1), "3": ("December 31", 1), "4": ("March 31", 0)}


def query_text(label: Column, scope: Column, period: Column, section: Column, sheet: Column, wordings=pt.WORDINGS) -> Column:
    """Search text for a row of a sheet: scope, label, other wordings of what the label holds, the period in words, section and sheet."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), "less:|add:", ""), "[^a-z0-9]+", " "))
    more = lambda p: F.flatten(F.array(*(F.when(holds(p, (key, *others)), F.array(*map(F.lit, (key, *others)))).otherwise(F.array().cast("array<string>")) for key, others in wordings.items())))
    year = F.regexp_extract(period, r"F(\d{4})$", 1)
    words = F.when(period.rlike(r"^F\d{4}$"), F.concat(F.lit("year ended March 31, "), year, F.lit(" "), period))
    for q, (day, back) in QUARTER_ENDS.items():
        words = words.when(period.rlike(rf"^{q}QF\d{{4}}$"), F.concat(F.lit(f"three months ended {day}, "), (year.try_cast("int") - back).cast("string"), F.lit(" "), period))
    parts = lambda p: [scope, p, F.array_join(F.array_sort(F.array_distinct(more(p))), " "), words, section, sheet]
    given = lambda p: F.concat_ws(" ", *(once(F.trim(x), lambda v: F.when(v != "", v)) for x in parts(p)))
    return once(plain, given)


_PLAIN_SQL = "trim(regexp_replace(regexp_replace(lower(label), 'less:|add:', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_MORE_SQL = "flatten([" + ", ".join("case when " + " or ".join(f"contains(plain, {quoted(w)})" for w in (k, *o)) + " then [" + ", ".join(map(quoted, (k, *o))) + "] else [] end" for k, o in pt.WORDINGS.items()) + "])"


@query("l17_query_text", oracle(f"with p as (select *, {_PLAIN_SQL} as plain, case id % 2 when 0 then 'F2024' else '2QF2023' end as period from fx_raw_label), m as (select *, nullif(array_to_string(list_sort(list_distinct({_MORE_SQL})), ' '), '') as more from p) select id, line, concat_ws(' ', 'consolidated', nullif(plain, ''), more, case id % 2 when 0 then 'year ended March 31, 2024 F2024' else 'three months ended September 30, 2022 2QF2023' end, 'Annual P&L') as text from m", "fx_raw_label"))
def l17(spark, sf_dir):
    period = F.when(F.col("id") % 2 == 0, "F2024").otherwise("2QF2023")
    return fixture(spark, sf_dir, "fx_raw_label").select("id", "line", query_text(F.col("label"), F.lit("consolidated"), period, F.lit(""), F.lit("Annual P&L")).alias("text"))
