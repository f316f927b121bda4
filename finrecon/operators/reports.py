"""Reports and cells by their form: annual reports by name (FLT14), quarters of results by tag or month (P8), note references in cells (FLT11), and rows whose years swing beyond any scale error (W2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.operators.texts import quoted
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

# Names of documents that are no annual reports, names that confirm one, and names without a meaning.
OTHER_DOCUMENTS = (
    r"transcript|earnings.?call|investor.?present|roadshow|quarterly|q[1-4]fy|fy\d{2}q[1-4]|q[1-4].results?|half.?year|h[12]fy|credit.?rat|rating.?report|prospectus|offer.?document|red.?herring|agm.?notice|postal.?ballot|notice.?agm"
    r"|press.?release|presentation"
)
CONFIRMED = r"annual.?report|annualreport|\bar[_\-]\d|\b_a_\d{8}"
NAMELESS = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.pdf$"
# Quarters by the months in which they end or are reported; other months tell none.
QUARTER_OF_MONTH = {6: 1, 7: 1, 9: 2, 10: 2, 12: 3, 1: 3, 3: 4, 4: 4}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# The largest note number, and the swing of a row that is wrong with the figures that count for it.
LARGEST_NOTE, WRONG_SWING, FIGURE, BASE = 300, 100.0, 0.01, 1.0


def is_annual_report(name: Column, link: Column, fy: Column, today: Column) -> Column:
    """Whether a document looks like an annual report: no year after the one that last ended in March, no name or link of another kind, and a name with a meaning or a link that confirms it. A null year is any; null texts are empty."""
    n, x = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(link, F.lit("")))
    ended = F.year(today) - F.when(F.month(today) >= 4, 0).otherwise(1)
    future = F.coalesce(fy > ended, F.lit(False))
    return ~future & ~F.concat_ws(" ", n, x).rlike(OTHER_DOCUMENTS) & ~(n.rlike(NAMELESS) & ~x.rlike(CONFIRMED))


def result_quarter(text: Column) -> Column:
    """1-4 of a result's name: its quarter tag, else the first month name that ends or reports a quarter; else null."""
    t = F.lower(text)
    tag = F.regexp_extract(t, r"(?:^|[^0-9a-z])q([1-4])(?:[^0-9]|$)", 1).try_cast("int")
    month = F.regexp_extract(t, rf"({'|'.join(MONTHS)})", 1)
    of = F.lit(None).cast("int")
    for k, q in QUARTER_OF_MONTH.items():
        of = F.when(month == MONTHS[k - 1], q).otherwise(of)
    return F.coalesce(tag, of)


def note_cell(text: Column) -> Column:
    """A cell that holds only a note number: whole, from 1 to LARGEST_NOTE, without a point."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    return F.coalesce(plain.rlike(r"^\+?\d+$") & plain.try_cast("double").between(1, LARGEST_NOTE), F.lit(False))


def wrong_rows(years: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) of rows with two neighbouring years that differ by more than WRONG_SWING; figures below FIGURE are skipped, and swings from less than BASE do not count."""
    real = years.where(F.abs("value") > FIGURE)
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy("fy"))
    ratio = F.abs("value") / F.abs("_before")
    return real.withColumn("_before", before).where((F.abs("_before") > BASE) & ((ratio > WRONG_SWING) | (ratio < 1 / WRONG_SWING))).select(*keys).distinct()


NAMES = (
    ("Annual_Report_FY.pdf", ""), ("Q4FY25_results.pdf", ""), ("cc24f889-a466-463e-951a-0c193ee04689.pdf", ""), ("cc24f889-a466-463e-951a-0c193ee04689.pdf", "Annual Report"), ("report.pdf", "Earnings call"), ("AR_2024.pdf", "AGM notice"),
    ("AR-1996.pdf", ""), ("investor_presentation.pdf", ""), ("integrated.pdf", "H1FY24"), ("red-herring.pdf", None), ("accounts.pdf", "credit rating"), (None, "annual report"),
)
_NAME_SQL, _LINK_SQL = (f"case o_orderkey % {len(NAMES)} " + " ".join(f"when {i} then {'null' if x[k] is None else quoted(x[k])}" for i, x in enumerate(NAMES)) + " end" for k in (0, 1))


@query(
    "flt14_annual_reports",
    f"""with d as (select o_orderkey as id, lower(coalesce({_NAME_SQL}, '')) as n, lower(coalesce({_LINK_SQL}, '')) as x, case when o_orderkey % 5 > 0 then year(o_orderdate) end as fy from orders)
 select id, not coalesce(fy > 1996, false) and not regexp_matches(concat(n, ' ', x), {quoted(OTHER_DOCUMENTS)}) and not (regexp_matches(n, {quoted(NAMELESS)}) and not regexp_matches(x, {quoted(CONFIRMED)})) as annual from d""",
)
def flt14_reports(spark, sf_dir):
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in NAMES)), (F.col("o_orderkey") % len(NAMES) + 1).cast("int"))
    fy = F.when(F.col("o_orderkey") % 5 > 0, F.year("o_orderdate"))
    return fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), is_annual_report(pick(0), pick(1), fy, F.lit("1997-02-01").cast("date")).alias("annual"))


@query(
    "p8_result_quarter",
    "select o_orderkey as id, cast(case when o_orderkey % 3 = 0 then o_orderkey % 4 + 1 else case when month(o_orderdate) in (6, 7) then 1 when month(o_orderdate) in (9, 10) then 2 when month(o_orderdate) in (12, 1) then 3 when month(o_orderdate) in (3, 4) then 4 end end as integer) as fq from orders",
)
def p8_result(spark, sf_dir):
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("o_orderdate"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Q"), F.col("o_orderkey") % 4 + 1, F.lit("FY25_Financial_Results.pdf"))).otherwise(F.concat(F.lit("Results for the quarter ended "), F.initcap(month), F.lit(" 30")))
    return fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), result_quarter(text).alias("fq"))


@query("flt11_note_cells", "select l_orderkey as row, l_linenumber as line, l_partkey as part, case when l_linenumber % 3 = 0 then false when l_linenumber % 3 = 1 then l_quantity between 1 and 300 else l_partkey % 600 between 1 and 300 end as note from lineitem")
def flt11_cells(spark, sf_dir):
    whole = F.col("l_quantity").cast("int").cast("string")
    cell = F.when(F.col("l_linenumber") % 3 == 0, F.concat(whole, F.lit(".0"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit(" "), whole)).otherwise((F.col("l_partkey") % 600).cast("string"))
    return fixture(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), note_cell(cell).alias("note"))


@query("w02_wrong_rows", oracle("with r as (select *, lag(value) over (partition by company_id, concept order by fy) as p from fx_lines where abs(value) > 0.01) select distinct company_id, concept from r where abs(p) > 1 and (abs(value) / abs(p) > 100 or abs(value) / abs(p) < 0.01)", "fx_lines"))
def w02_wrong(spark, sf_dir):
    return wrong_rows(fixture(spark, sf_dir, "fx_lines"), ["company_id", "concept"])
