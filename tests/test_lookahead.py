"""Figures below labels against a plain loop over the lines."""

import random
import re

from finrecon.operators import lookahead as la

FIELDS = (("sales", "(?i)^sales"), ("tax", "(?i)tax"), ("cash", "(?i)^cash"))


def numbers(line):
    return [(-1 if x.startswith("(") else 1) * float(re.sub("[(),]", "", x)) for x in re.findall(la.NUMBER, line)]


def field_of(line):
    return next((n for n, p in FIELDS if re.search(p, line.strip())), None)


def plain(lines, years, last_of):
    real = lambda v: v >= 100 or v != int(v)
    out = {}
    for i, line in enumerate(lines):
        field = field_of(line)
        if field is None or field in out:
            continue
        vals, inline = numbers(line.strip()), bool(numbers(line.strip()))
        if not inline:
            for below in lines[i + 1 : i + 18]:
                if field_of(below) not in (None, field):
                    break
                if below.strip() in la.NIL:
                    vals.append(0.0)
                    continue
                vals += numbers(below.strip())
                if sum(map(real, vals)) >= years * (6 if field in last_of else 2):
                    break
        while len(vals) >= 2 and vals[0] == int(vals[0]) and 0 < vals[0] < 200 and any(map(real, vals[1:3])):
            vals = vals[1:]
        if not inline and field in last_of:
            vals = [v for v in vals if real(v)][-years:]
        elif not inline and len(vals) == 2 * years and all(a != 0 and b > 3 * abs(a) for a, b in zip(vals[::2], vals[1::2])):
            vals = vals[::2]
        if vals[:years]:
            out[field] = (i, vals[:years])
    return out


def test_fields_equal_a_plain_loop(spark):
    draw = random.Random(7)
    pieces = ["Sales", "Sales of goods", "Income tax", "Cash", "", "note", "-", "Nil", "12", "3 & 43", "(1,234.50)", "150", "99", "7.5", "2,000 2,100", "100 350", "500", "10,000", "words 5"]
    filings = {f: [draw.choice(pieces) if draw.random() < 0.8 else f"Cash {draw.randint(1, 300)} {draw.randint(100, 999)}" for _ in range(draw.randint(1, 45))] for f in range(120)}
    filings[200] = ["Sales", *["x"] * 17, "500 600"]
    filings[201] = ["Tax", "3", "120", "130", "1.5", "2.5", "999", "Sales 7"]
    filings[202] = ["Sales", "100", "350", "90.5", "400", "x"]
    rows = [(f, 1 + i // 10, i % 10, line) for f, lines in filings.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "filing long, page_no int, line_no int, line string")
    for years in (1, 2, 3):
        got = {(r["filing"], r["field"]): ((r["page_no"] - 1) * 10 + r["line_no"], list(r["values"])) for r in la.field_values(lines, FIELDS, ("tax",), years).collect()}
        assert got == {(f, field): v for f, text in filings.items() for field, v in plain(text, years, ("tax",)).items()}


def test_values_are_computed_once(spark):
    """Each label's figures are read once: no expression stands in the plan for every mention of it."""
    lines = spark.createDataFrame([(1, 1, 1, "Depreciation"), (1, 1, 2, "1,000"), (1, 1, 3, "2,000")], "filing long, page_no long, line_no long, line string")
    found = la.field_values(lines, la.FIELDS, ("depreciation",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000 and plan.count("regexp_extract_all") == 1
    assert [tuple(r) for r in found.collect()] == [(1, "depreciation", 1, 1, [1000.0, 2000.0])]
