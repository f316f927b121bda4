"""Period text to fiscal periods: ``F2025`` is the fiscal year that ends in March 2025, ``1QF2025`` its first quarter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from finrecon.functions.once import once

#: Quarter of the fiscal year by the first letters of a month; the year starts in April.
QUARTER_OF = {"apr": 1, "may": 1, "jun": 1, "jul": 2, "aug": 2, "sep": 2, "oct": 3, "nov": 3, "dec": 3, "jan": 4, "feb": 4, "mar": 4}
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
LOW, HIGH = 2005, 2035


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def _year(text: Column, pattern: str) -> Column:
    """The full year of the pattern's group, null without a match; the pattern is tried once. An empty text is not cast: Spark makes an exception for each cast that fails, also for those it takes as null."""
    return once(F.regexp_extract(text, pattern, 1), lambda d: F.when(d != "", full_year(d)))


def full_year(digits: Column) -> Column:
    """Two digits below 50 are 20xx, others 19xx; four digits stay."""
    n = digits.try_cast("int")
    return F.when(F.length(digits) == 4, n).when(n < 50, n + 2000).otherwise(n + 1900)


def _of_months(month: Column) -> Column:
    pairs = [F.lit(x) for pair in QUARTER_OF.items() for x in pair]
    return F.element_at(F.create_map(*pairs), month)


def quarter(raw: Column) -> Column:
    """Quarter text to nQFyyyy, else null: canonical, Q4 FY25, 4QFY25, Jun-24, Sep 2024, Jun '24."""
    t = F.lower(F.trim(raw))
    canonical = _part(t, r"^([1-4])qf(\d{4})$", 1)
    tagged = F.coalesce(_part(t, r"^q([1-4])[ -]*f\.?y\.?[ -]*'?(\d{4}|\d{2})$", 1), _part(t, r"^([1-4])q[ -]*f\.?y?\.?[ -]*'?(\d{4}|\d{2})$", 1))
    tag_year = full_year(F.regexp_extract(t, r"(\d{4}|\d{2})$", 1))
    month = _part(t, rf"^({MONTHS})[a-z]*[ ,.'-]*(\d{{4}}|\d{{2}})$", 1)
    q = _of_months(month)
    year = tag_year + F.when(q < 4, 1).otherwise(0)
    return F.coalesce(
        F.when(canonical.isNotNull(), F.upper(t)),
        F.concat(tagged, F.lit("QF"), tag_year.cast("string")),
        F.concat(q.cast("string"), F.lit("QF"), year.cast("string")),
    )


def period(raw: Column, low: int = LOW, high: int = HIGH) -> Column:
    """Period text to Fyyyy, else to a quarter, else null. A span of years counts by its last year; a month with four digits is annual for March."""

    def of(t: Column) -> Column:
        direct = _year(t, r"^f\.?\s*y?\.?\s*'?(\d{4}|\d{2})$")
        span = _year(t, r"^(?:f\.?y\.?\s*)?\d{4}\s*[-/]\s*(\d{4}|\d{2})$")
        written = _year(t, r"march\s+31,?\s+(\d{4})")
        march = _year(t, r"^mar(?:ch)?[ ,-]*(\d{4})$")
        plain = once(_year(t, r"^(\d{4})$"), lambda y: F.when(y.between(low, high), y))
        return F.coalesce(direct, span, written, march, plain)

    year = once(F.lower(F.trim(raw)), of)
    return F.coalesce(F.concat(F.lit("F"), year.cast("string")), quarter(raw))


def heading(raw: Column) -> Column:
    """Column heading to a period: canonical, year ended, three months or quarter ended, a bare date in March is annual."""
    t = F.lower(F.trim(raw))
    date_year = full_year(_part(t, rf"(?:{MONTHS})[a-z]*\s+\d{{1,2}},?\s+(\d{{4}})", 1))
    month = _part(t, rf"({MONTHS})[a-z]*\s+\d{{1,2}},?\s+\d{{4}}", 1)
    q = _of_months(month)
    as_year = F.concat(F.lit("F"), (date_year + F.when(q < 4, 1).otherwise(0)).cast("string"))
    as_quarter = F.concat(q.cast("string"), F.lit("QF"), (date_year + F.when(q < 4, 1).otherwise(0)).cast("string"))
    dated = F.when(t.rlike("three months|quarter ended"), as_quarter).when(t.rlike("year ended") | (month == "mar"), as_year).otherwise(as_quarter)
    return F.coalesce(F.when(date_year.isNotNull(), dated), period(raw))


def all_periods(text: Column, low: int = LOW, high: int = HIGH) -> Column:
    """All distinct plausible fiscal years in a text, sorted."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:FY|F)?((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y.between(low, high))))


def fiscal_year(day: Column, start_month: int = 4) -> Column:
    """The fiscal year of a date; with start_month 4 the year that ends in the next March."""
    return F.year(F.add_months(day, (13 - start_month) % 12))


def fiscal_quarter(day: Column) -> Column:
    return F.quarter(F.add_months(day, -3))


def year_from_name(text: Column) -> Column:
    """Fiscal year from a file name or link: a span counts by its end if that follows its start, else a plain year."""
    start = _part(text, r"(20\d{2})\s*[-_]\s*(\d{4}|\d{2})(?:\D|$)", 1).try_cast("int")
    end = full_year(_part(text, r"(20\d{2})\s*[-_]\s*(\d{4}|\d{2})(?:\D|$)", 2))
    return F.coalesce(F.when(end == start + 1, end), _part(text, r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1).try_cast("int"))


def quarter_of_text(text: Column) -> Column:
    """Quarter number from a tag, else from a month name."""
    t = F.lower(text)
    return F.coalesce(_part(t, r"(?:^|[^a-z0-9])q([1-4])(?:[^a-z0-9]|$)", 1).try_cast("int"), _of_months(_part(t, rf"(?:^|[^a-z])({MONTHS})[a-z]*", 1)))


def site_year(head: Column) -> Column:
    """Site headings: first four-digit year, else a trailing two-digit one; trailing twelve months have none."""
    return F.when(~F.lower(head).rlike("ttm|trailing"), F.coalesce(_year(head, r"((?:19|20)\d{2})"), _year(head, r"(\d{2})\s*$")))
