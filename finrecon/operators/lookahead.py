"""Figures of a field that stand on the lines below its label (W14): a state machine over the next lines, as one fold of a bounded window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from finrecon.functions import labels as lb
from finrecon.functions.once import once
from finrecon.plans.fixtures import fixture
from finrecon.plans.registry import query

#: Lines looked at below a label, marks that stand for nothing, the bound of note references, and by how much a sub-total exceeds its part.
AHEAD, NIL, NOTE_BELOW, SUBTOTAL = 17, ("-", "–", "—", "Nil", "nil"), 200, 3.0
NUMBER = r"\(?-?\d[\d,]*(?:\.\d+)?\)?"
PLACE = ("page_no", "line_no")


def numbers_in(line: Column) -> Column:
    """The figures of a line; brackets are negative."""
    sign = lambda x: F.when(x.startswith("("), -1.0).otherwise(1.0)
    return F.transform(F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0)), lambda x: sign(x) * F.regexp_replace(x, r"[(),]", "").cast("double"))


def financial(v: Column) -> Column:
    """Not a note reference or a serial number: 100 or more, or with a fraction."""
    return (v >= 100) | (v != F.floor(v))


def collected(field: Column, ahead: Column, most: Column) -> Column:
    """The figures of the lines ahead (field, nums, nil), up to the next field's line or until most of them are financial; a nil line is 0."""
    start = F.struct(F.array().cast("array<double>").alias("vals"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        stop = s["done"] | (x["field"].isNotNull() & (x["field"] != field))
        vals = F.when(stop, s["vals"]).otherwise(F.concat(s["vals"], F.when(x["nil"], F.array(F.lit(0.0))).otherwise(x["nums"])))
        full = ~x["nil"] & (F.size(F.filter(vals, financial)) >= most)
        return F.struct(vals.alias("vals"), (stop | full).alias("done"))

    return F.aggregate(ahead, start, step)["vals"]


def without_notes(vals: Column) -> Column:
    """Leading whole numbers below NOTE_BELOW go as long as one of the two figures after them is financial."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("stop"))

    def step(s: Column, i: Column) -> Column:
        v = F.get(vals, i)
        note = (v == F.floor(v)) & (v > 0) & (v < NOTE_BELOW) & F.exists(F.slice(vals, i + 2, F.lit(2)), financial)
        go = ~s["stop"] & note
        return F.struct((s["at"] + go.cast("int")).alias("at"), (~go).alias("stop"))

    places = F.when(F.size(vals) > 1, F.sequence(F.lit(0), F.size(vals) - 2)).otherwise(F.array().cast("array<int>"))
    return F.slice(vals, F.aggregate(places, start, step)["at"] + 1, F.greatest(F.size(vals), F.lit(1)))


def chosen(vals: Column, last: Column, years: int) -> Column:
    """One figure for each year: the last financial ones of a field whose total comes last; every other one where each is followed by a sub-total; else the first ones."""
    tail = once(F.filter(vals, financial), lambda real: F.when(F.size(real) >= years, F.slice(real, F.size(real) - (years - 1), F.lit(years))).otherwise(real))
    parts, totals = (F.transform(F.sequence(F.lit(first), F.lit(2 * years - 1), F.lit(2)), lambda i: F.get(vals, i)) for first in (0, 1))
    mixed = (F.size(vals) == 2 * years) & F.forall(F.zip_with(parts, totals, lambda part, total: (part != 0) & (total > SUBTOTAL * F.abs(part))), lambda good: good)
    return F.when(last, tail).when(mixed, parts).otherwise(F.slice(vals, F.lit(1), F.lit(years)))


def field_values(lines: DataFrame, fields: Sequence[tuple[str, str]], last_of: Sequence[str] = (), years: int = 2) -> DataFrame:
    """(filing, field, page_no, line_no, values) of lines (filing, page_no, line_no, line): for each field (name, pattern; the first that matches a line is its field) the figures of its first line in a filing that has some, on it or below it.

    Fields of last_of take the last figures of their block, up to three times as many are read. A filing's lines are one array; each label reads AHEAD of them."""
    text = F.trim("line")
    typed = lines.select("filing", *PLACE, lb.first_pattern(text, fields).alias("field"), numbers_in(text).alias("nums"), text.isin(*NIL).alias("nil"))
    filing = typed.groupBy("filing").agg(F.array_sort(F.collect_list(F.struct(*PLACE, "field", "nums", "nil"))).alias("ls"))
    labelled = F.filter(F.transform("ls", lambda x, i: F.when(x["field"].isNotNull(), F.struct(*(x[c].alias(c) for c in (*PLACE, "field", "nums")), F.slice("ls", i + 2, F.lit(AHEAD)).alias("ahead")))), lambda x: x.isNotNull())
    own = filing.select("filing", F.inline(labelled))
    last, given = F.col("field").isin(*last_of) if last_of else F.lit(False), F.size("nums") > 0
    found = F.when(given, F.col("nums")).otherwise(collected(F.col("field"), F.col("ahead"), F.when(last, 6 * years).otherwise(2 * years)))
    picked = lambda vals: F.when(given, F.slice(vals, F.lit(1), F.lit(years))).otherwise(chosen(vals, last, years))
    read = own.select("filing", "field", *PLACE, once(found, lambda v: once(without_notes(v), picked)).alias("values"))
    # A condition on the values would be moved below them and compute them again, so labels without figures have no place in the order instead.
    place = F.when(F.size("values") > 0, F.struct(*PLACE))
    return read.groupBy("filing", "field").agg(F.min_by(F.struct(*PLACE, "values"), place).alias("b")).where("b is not null").select("filing", "field", "b.*")


#: Fields of the filings' lines in the query.
FIELDS = (("revenue", "(?i)^revenue from operations"), ("finance_costs", "(?i)finance costs"), ("depreciation", "(?i)^depreciation"), ("borrowings", "(?i)^borrowings"), ("investments", "(?i)^investments"), ("leases", "(?i)^lease liabilities"))


@query("w14_field_values")
def w14_fields(spark, sf_dir):
    """Filings whose figures stand on lines of their own below the label."""
    parts = F.split(F.regexp_replace("line", r"\s+(?=\(?\d[\d,.]*\)?(?:\s|$))", "\n"), "\n")
    lines = fixture(spark, sf_dir, "fx_filed_line").select("filing", "page_no", "line_no", F.posexplode(parts).alias("k", "line"))
    lines = lines.select("filing", "page_no", (F.col("line_no") * 100 + F.col("k")).alias("line_no"), "line")
    return field_values(lines, FIELDS, ("depreciation",)).withColumn("values", F.array_join(F.transform("values", lambda v: v.cast("decimal(20,2)").cast("string")), ","))
