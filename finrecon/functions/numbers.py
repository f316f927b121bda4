"""Number text, units and comparisons of figures. All figures are in crore."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What one unit is in crore.
IN_CRORE = {"crore": 1.0, "lakh": 0.01, "million": 0.1, "billion": 100.0, "thousand": 0.0001, "rupee": 1e-7}


def number(raw: Column) -> Column:
    """Number text to double: brackets negative, currency and commas removed, Cr x1, Mn x0.1, Bn x100; dashes, Nil, NA, nan and inf are null."""
    t = F.trim(raw)
    negative = t.rlike(r"^\(.*\)$")
    suffix = F.lower(F.regexp_extract(t, r"(?i)\b(cr|crore|mn|million|bn|billion)\.?\)?$", 1))
    digits = F.regexp_extract(F.regexp_replace(t, r"[₹$€£,\s]|(?i:rs\.?|inr)", ""), r"^\(?(-?\d*\.?\d+)(?:[eE]([+-]?\d+))?\)?(?i:cr|crore|mn|million|bn|billion)?\.?\)?$", 1)
    value = F.when(digits != "", digits).try_cast("double")
    scaled = value * F.when(suffix.isin("mn", "million"), 0.1).when(suffix.isin("bn", "billion"), 100.0).otherwise(1.0)
    return F.when(negative, -F.abs(scaled)).otherwise(scaled)


def site_number(raw: Column) -> Column:
    """As number, with a percent sign and inner spaces removed."""
    return number(F.translate(raw, "% \t\n\x0b\f\r", ""))


def to_crore(value: Column, unit: Column) -> Column:
    """Value in crore to four places; NaN and unknown units are null."""
    rate = F.lit(None).cast("double")
    for name, factor in IN_CRORE.items():
        rate = F.when(F.lower(unit).startswith(name), factor).otherwise(rate)
    return F.round(F.when(~F.isnan(value), value) * rate, 4)


def scale_guess(value: Column, percent: Column) -> Column:
    """Values above 1e10 are rupees; percent cells above 1 are divided by 100; six places."""
    return F.round(F.when(F.abs(value) > 1e10, value / 1e7).when(percent & (F.abs(value) > 1), value / 100).otherwise(value), 6)


def close(a: Column, b: Column, slack: float) -> Column:
    """Equal within slack of the larger magnitude; two values near zero are equal."""
    most = F.greatest(F.abs(a), F.abs(b))
    return (most < 1e-6) | (F.abs(a - b) <= slack * most)


def relative_difference(a: Column, b: Column) -> Column:
    """Difference against b; against nothing where b is zero."""
    return F.when(b == 0, F.abs(a)).otherwise(F.abs(a - b) / F.abs(b))


def agreement(a: Column, b: Column) -> Column:
    """HIGH within 2 percent, MEDIUM within 10, LOW within 25, else FLAG."""
    d = relative_difference(a, b)
    return F.when(d <= 0.02, "HIGH").when(d <= 0.10, "MEDIUM").when(d <= 0.25, "LOW").otherwise("FLAG")


def glued_years(cell: Column) -> Column:
    """Two years or two canonical periods written without a gap, as an array; else the cell alone."""
    spans = F.regexp_extract_all(cell, F.lit(r"(20\d{2}-\d{2})"), F.lit(1))
    marks = F.regexp_extract_all(cell, F.lit(r"(F20\d{2})"), F.lit(1))
    return F.when(cell.rlike(r"^(20\d{2}-\d{2}){2}$"), spans).when(cell.rlike(r"^(F20\d{2}){2}$"), marks).otherwise(F.array(cell))


def glued_numbers(cell: Column) -> Column:
    """Two numbers of two decimals written without a gap, as an array; else the cell alone."""
    parts = F.regexp_extract_all(cell, F.lit(r"(\d{1,3}(?:,\d{2,3})*\.\d{2})"), F.lit(1))
    return F.when(cell.rlike(r"^(?:\d{1,3}(?:,\d{2,3})*\.\d{2}){2}$"), parts).otherwise(F.array(cell))


def joined_numbers(cells: Column) -> Column:
    """Neighbour cells that hold one number in two parts, such as 6,31,17,25 and 0, put together; a fold over the row."""

    def add(done: Column, cell: Column) -> Column:
        last = F.element_at(done, -1)
        splits = (F.size(done) > 0) & last.rlike(r"^[\d,]*,\d{1,2}$") & cell.rlike(r"^\d{1,2}$") & (F.length(F.regexp_extract(last, r"(\d*)$", 1)) + F.length(cell) == 3)
        return F.when(splits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, cell)))).otherwise(F.concat(done, F.array(cell)))

    # element_at on an empty array is an error in ANSI mode, so the fold starts with a guard cell.
    folded = F.aggregate(cells, F.array(F.lit("")), add)
    return F.slice(folded, 2, F.greatest(F.size(folded) - 1, F.lit(0)))
