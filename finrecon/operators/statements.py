"""Derivation (D, A7, A8) and validation (V) of statements: rule tables over concepts, compiled to columns of one wide row per company and year."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from finrecon.functions import rules
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

KEY = ["company_id", "sector", "fy"]
WIDE = "wide as (select company_id, sector, fy, " + ", ".join(f"max(case when concept = '{c}' then value end) as {c}" for c in rules.CONCEPTS) + " from fx_lines group by 1, 2, 3)"
ROUTED = ("bank", "nbfc", "insurance")


def wide_lines(lines: DataFrame, keys: Sequence[str] = KEY, concepts: Sequence[str] = rules.CONCEPTS) -> DataFrame:
    """One row per key with a column for each concept; the concepts are given, so no pass is spent on finding them."""
    return lines.groupBy(*keys).pivot("concept", list(concepts)).agg(F.max("value"))


def _wide(spark, sf_dir) -> DataFrame:
    return wide_lines(fixture(spark, sf_dir, "fx_lines"))


def _totals_sql(totals=rules.TOTALS) -> list[str]:
    return [x for c, e in totals for x in (f"{e} as c_{c}", f"coalesce({c}, c_{c}) as f_{c}")]


def with_totals(wide: DataFrame, totals=rules.TOTALS) -> DataFrame:
    """Adds c_x (computed) and f_x (given, else computed) for each rule. Rules stand in order of dependence, so one select reaches the fixed point."""
    return wide.selectExpr("*", *_totals_sql(totals))


def derivations(wide: DataFrame, keys: Sequence[str] = KEY, totals=rules.TOTALS, slack: float = rules.DISAGREE) -> DataFrame:
    """(keys, concept, given, computed, kind): derived where nothing was given, discrepancy where both differ by more than slack of the larger. Given values stay."""
    kinds = [F.struct(F.lit(c).alias("concept"), F.col(c).alias("given"), F.col(f"c_{c}").alias("computed"), F.expr(_kind(c, slack)).alias("kind")) for c, _ in totals]
    return with_totals(wide, totals).select(*keys, F.inline(F.array(*kinds))).where("kind is not null")


def _kind(c: str, slack: float) -> str:
    return f"case when {c} is null and c_{c} is not null then 'derived' when abs({c} - c_{c}) > {slack} * greatest(abs({c}), abs(c_{c}), 1e-9) then 'discrepancy' end"


TOTALS_CTE = f"{WIDE}, t as (select *, {', '.join(_totals_sql())} from wide)"


@query("a07_derived_totals", oracle(f"with {TOTALS_CTE} select * from (" + " union all ".join(f"select company_id, sector, fy, '{c}' as concept, {c} as given, c_{c} as computed, {_kind(c, rules.DISAGREE)} as kind from t" for c, _ in rules.TOTALS) + ") where kind is not null", "fx_lines"))
def a07(spark, sf_dir):
    return derivations(_wide(spark, sf_dir))


#: Component sums: cost of goods from two or more of its parts, tax from current and deferred tax, here from lines of the fixture that stand for them.
COMPONENTS = (("operating_cost", ("cost_of_goods_sold", "employee_benefits_expense", "other_expenses"), 2), ("charges", ("finance_cost", "tax_expense"), 1))


@query("a08_component_sums", oracle(f"with {WIDE} select company_id, sector, fy, " + ", ".join(f"{rules.summed_sql(p, n)} as {c}" for c, p, n in COMPONENTS) + " from wide", "fx_lines"))
def a08(spark, sf_dir):
    return _wide(spark, sf_dir).selectExpr(*KEY, *(f"{rules.summed_sql(p, n)} as {c}" for c, p, n in COMPONENTS))


# --- identities by label -------------------------------------------------------------------------------------------------

EXTRA_LABELS = ("profit before minority interest", "ebitda %", "pat margin", "net block", "net debt", "free cash flow")
#: Display label of each concept and its place in the statement.
LABELS = tuple((c, (dict(rules.CONCEPT_PHRASES).get(c) or (c.replace("_", " "),))[0]) for c in rules.CONCEPTS)
LABELS_SQL = "labels(concept, label, pos) as (values " + ", ".join(f"('{c}', '{label}', {i})" for i, (c, label) in enumerate(LABELS)) + ")"
NORM_SQL = "' ' || regexp_replace(lower({c}), '[^a-z0-9&%]+', ' '{g}) || ' '"


def pattern_rows(identities=rules.IDENTITIES) -> list[tuple[int, int, str, bool]]:
    """(rule, slot, pattern, whole): slot -1 is the target; a short pattern must be a whole word, a longer one may begin one."""
    out = []
    for k, (target, inputs, _) in enumerate(identities):
        for slot, patterns in enumerate((target, *inputs), -1):
            out += [(k, slot, re.sub("[^a-z0-9&%]+", " ", p).strip(), len(p.strip()) <= 5) for p in patterns]
    return out


def by_identity(filled: DataFrame, template: DataFrame, identities=rules.IDENTITIES) -> DataFrame:
    """(company_id, fy, label, value) for template labels (company_id, label, pos) that filled (company_id, fy, label, pos, value) holds in no year.

    Patterns are matched with the distinct labels, of which there are few, and not with the rows. An input is the first matching label in place, one that begins with the pattern before others;
    the first rule that gives any value in any year fills the label."""
    spark = filled.sparkSession
    patterns = F.broadcast(spark.createDataFrame(pattern_rows(identities), "rule int, slot int, pattern string, whole boolean"))  # written by hand
    vocabulary = filled.select("label").union(template.select("label")).distinct()
    norm = F.expr(NORM_SQL.format(c="label", g=""))
    text = F.when(F.col("whole"), F.concat(F.lit(" "), "pattern", F.lit(" "))).otherwise(F.concat(F.lit(" "), "pattern"))
    met = vocabulary.withColumn("norm", norm).join(patterns, F.contains(F.col("norm"), text)).groupBy("label", "rule", "slot").agg(F.bool_or(F.col("norm").startswith(text)).alias("begins"))
    first = F.struct((~F.col("begins")).cast("int"), "pos")
    inputs = filled.where("value is not null").join(met.where("slot >= 0"), "label").groupBy("company_id", "fy", "rule", "slot").agg(F.min_by("value", first).alias("value"))
    slots = inputs.groupBy("company_id", "fy", "rule").pivot("slot", [0, 1, 2]).agg(F.max("value")).toDF("company_id", "fy", "rule", "v0", "v1", "v2")
    chain = F
    for k, (_, _, expression) in enumerate(identities):
        chain = chain.when(F.col("rule") == k, F.expr(expression))
    values = slots.withColumn("value", chain).where("value is not null")
    empty = template.select("company_id", "label").join(filled.where("value is not null").select("company_id", "label").distinct(), ["company_id", "label"], "left_anti")
    offered = empty.join(met.where("slot = -1").select("label", "rule"), "label").join(values.select("company_id", "rule", "fy", "value"), ["company_id", "rule"])
    chosen = offered.groupBy("company_id", "label").agg(F.min("rule").alias("rule"))
    return offered.join(chosen, ["company_id", "label", "rule"]).select("company_id", "fy", "label", "value")


D2_SQL = f"""with {LABELS_SQL}, filled as (select company_id, fy, label, pos, value from fx_lines join labels using (concept)),
 template as (select company_id, label from (select distinct company_id from filled) cross join (select label from labels union all select unnest({list(EXTRA_LABELS)}))),
 patterns(rule, slot, pattern, whole) as (values {", ".join(f"({a}, {b}, '{c}', {str(d).lower()})" for a, b, c, d in pattern_rows())}),
 words as (select label, {NORM_SQL.format(c="label", g=", 'g'")} as norm from (select distinct label from template)),
 met as (select label, rule, slot, bool_or(starts_with(norm, ' ' || pattern || case when whole then ' ' else '' end)) as begins from words join patterns on contains(norm, ' ' || pattern || case when whole then ' ' else '' end) group by 1, 2, 3),
 inputs as (select company_id, fy, rule, slot, arg_min(value, (not begins)::int * 10000 + pos) as value from filled join met using (label) where slot >= 0 group by 1, 2, 3, 4),
 slots as (select company_id, fy, rule, max(case when slot = 0 then value end) as v0, max(case when slot = 1 then value end) as v1, max(case when slot = 2 then value end) as v2 from inputs group by 1, 2, 3),
 vals as (select * from (select company_id, fy, rule, case rule {" ".join(f"when {k} then {e}" for k, (_, _, e) in enumerate(rules.IDENTITIES))} end as value from slots) where value is not null),
 offered as (select t.company_id, t.label, m.rule, v.fy, v.value from template t join met m on t.label = m.label and m.slot = -1 join vals v on v.company_id = t.company_id and v.rule = m.rule
   where not exists (select 1 from filled f where f.company_id = t.company_id and f.label = t.label))
 select company_id, fy, label, value from (select *, min(rule) over (partition by company_id, label) as best from offered) where rule = best"""


@query("d2_ordered_identities", oracle(D2_SQL, "fx_lines"))
def d2(spark, sf_dir):
    labels = F.broadcast(spark.createDataFrame([(c, label, i) for i, (c, label) in enumerate(LABELS)], "concept string, label string, pos int"))
    filled = fixture(spark, sf_dir, "fx_lines").join(labels, "concept").select("company_id", "fy", "label", "pos", "value")
    every = F.array(*(F.lit(x) for x in (*(label for _, label in LABELS), *EXTRA_LABELS)))
    return by_identity(filled, filled.select("company_id").distinct().withColumn("label", F.explode(every)))


# --- signed sums, margins and ratios by name -----------------------------------------------------------------------------

#: Names of lines in the signed sums, margins and ratios, for the concepts of the fixture.
NAMES = {
    "revenue_from_operations": "Revenue From Operations", "net_sales": "Net Sales", "cost_of_goods_sold": "Cost of Goods Sold", "gross_profit": "Gross Profit", "other_income": "Other Income",
    "employee_benefits_expense": "Employee Benefit Expense", "other_expenses": "Other Expenses", "operating_expenses": "Selling General And Admin Expenses", "ebitda": "EBITDA", "ebit": "EBIT",
    "depreciation_amortization": "Depreciation And Amortization", "finance_cost": "Finance Cost", "interest_expended": "Interest Expense", "pbt": "PBT", "pat": "PAT", "tax_expense": "Tax Expense",
    "cash_flow_from_operations": "Cash Flow From Operations", "capital_expenditure": "Capital Expenditure", "total_c_assets": "Total Current Assets", "total_c_liabilities": "Total Current Liabilities",
    "total_borrowings": "Total Borrowings", "cash_and_equivalents": "Cash And Cash Equivalents", "equity_share_capital": "Share Capital", "other_equity": "Reserves And Surplus", "total_equity": "Total Shareholders Equity",
    "net_worth": "Net Worth", "capital_employed": "Capital Employed", "total_assets": "Total Assets", "enterprise_value": "Enterprise Value", "market_capitalisation": "Market Capitalisation", "total_income": "Total Revenue",
}
NAMED_SQL = "named as (select company_id, fy, name, value from fx_lines join (values " + ", ".join(f"('{c}', '{n}')" for c, n in NAMES.items()) + ") as m(concept, name) using (concept))"


def _named(spark, sf_dir) -> DataFrame:
    names = F.broadcast(spark.createDataFrame(list(NAMES.items()), "concept string, name string"))
    return fixture(spark, sf_dir, "fx_lines").join(names, "concept").select("company_id", "fy", "name", "value")


def signed_sums(named: DataFrame, sums=rules.SIGNED_SUMS) -> DataFrame:
    """(company_id, fy, target, value): the first rule of a target whose components are all there, to 2 places. Names are compared in lower case."""
    rows = [(k, t, c.lower(), s, len(parts)) for k, (t, parts) in enumerate(sums) for c, s in parts]
    parts = F.broadcast(named.sparkSession.createDataFrame(rows, "rule int, target string, name string, sign int, parts int"))
    total = F.sum(F.col("sign") * F.col("value").cast("decimal(30,4)")).cast("double")
    whole = named.withColumn("name", F.lower("name")).join(parts, "name").groupBy("company_id", "fy", "rule", "target", "parts").agg(F.count("*").alias("n"), total.alias("value")).where("n = parts")
    return whole.groupBy("company_id", "fy", "target").agg(F.round(F.min_by("value", "rule"), 2).alias("value"))


_SUM_ROWS = ", ".join(f"({k}, '{t}', '{c.lower()}', {s}, {len(parts)})" for k, (t, parts) in enumerate(rules.SIGNED_SUMS) for c, s in parts)


@query("d3_signed_sums", oracle(f"with {NAMED_SQL}, p(rule, target, name, sign, parts) as (values {_SUM_ROWS}), w as (select company_id, fy, rule, target, cast(sum(sign * cast(value as decimal(30,4))) as double) as value from (select company_id, fy, lower(name) as name, value from named) join p using (name) group by 1, 2, 3, 4, parts having count(*) = parts) select company_id, fy, target, round(arg_min(value, rule), 2) as value from w group by 1, 2, 3", "fx_lines"))
def d3(spark, sf_dir):
    return signed_sums(_named(spark, sf_dir))


def _slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def _ratio_columns() -> list[str]:
    revenue = f"coalesce({', '.join(_slug(r) for r in rules.REVENUE)})"
    share = "case when abs({d}) > 0.001 then round({n} / {d}{by}, {places}) end as {name}"
    margins = [share.format(n=_slug(n), d=_slug(d) if d else revenue, by=" * 100", places=2, name=_slug(m)) for m, n, d in rules.MARGINS]
    return margins + [share.format(n=_slug(n), d=_slug(d), by="", places=4, name=_slug(r)) for r, n, d in rules.RATIOS]


RATIO_NAMES = sorted({*rules.REVENUE, *(x for _, n, d in (*rules.MARGINS, *rules.RATIOS) for x in (n, d) if x)})


def ratios(named: DataFrame) -> DataFrame:
    """Margins in percent to 2 places and ratios to 4 for each company and year; revenue goes by the first of its names that the year has; a denominator within 0.001 of zero gives none."""
    wide = named.groupBy("company_id", "fy").pivot("name", RATIO_NAMES).agg(F.max("value")).toDF("company_id", "fy", *(_slug(n) for n in RATIO_NAMES))
    return wide.selectExpr("company_id", "fy", *_ratio_columns())


@query("d4_margins_ratios", oracle(f"with {NAMED_SQL}, wide as (select company_id, fy, " + ", ".join(f"max(case when name = '{n}' then value end) as {_slug(n)}" for n in RATIO_NAMES) + f" from named group by 1, 2) select company_id, fy, {', '.join(_ratio_columns())} from wide", "fx_lines"))
def d4(spark, sf_dir):
    return ratios(_named(spark, sf_dir))


@query(
    "d5_inject_derived",
    oracle(
        f"with {TOTALS_CTE}, k as (" + " union all ".join(f"select company_id, fy, '{c}' as concept, c_{c} as computed, {_kind(c, rules.DISAGREE)} as kind from t" for c, _ in rules.TOTALS)
        + ") select company_id, fy, concept, value, 'reported' as origin, null as confidence from fx_lines union all select company_id, fy, concept, computed, 'derived', case when exists (select 1 from k d where d.company_id = k.company_id and d.kind = 'discrepancy') then 'MEDIUM' else 'HIGH' end from k where kind = 'derived'",
        "fx_lines",
    ),
)
def d5(spark, sf_dir):
    """Derived values join the pool where it has none; HIGH for a company without any discrepancy, else MEDIUM."""
    given = fixture(spark, sf_dir, "fx_lines").select("company_id", "fy", "concept", "value", F.lit("reported").alias("origin"), F.lit(None).cast("string").alias("confidence"))
    found = derivations(_wide(spark, sf_dir))
    doubt = found.where("kind = 'discrepancy'").select("company_id", F.lit(True).alias("doubt")).distinct()
    new = found.where("kind = 'derived'").join(doubt, "company_id", "left")
    return given.union(new.select("company_id", "fy", "concept", "computed", F.lit("derived"), F.when(F.col("doubt"), "MEDIUM").otherwise("HIGH")))


# --- checks --------------------------------------------------------------------------------------------------------------

#: Sign, range and kind of a concept: sign '+' means never below -1; sections whose lines may be losses are exempt; lo and hi bound the value.
LIMITS = (
    ("revenue_from_operations", "+", "core_revenue", False, 0.0, 60000.0), ("cost_of_goods_sold", "+", "costs", False, 0.0, 60000.0), ("finance_cost", "+", "costs", False, -1.0, 50000.0),
    ("pbt", "+", "pbt", False, -40000.0, 60000.0), ("gross_margin", "+", "margins", True, 0.0, 40.0), ("ebitda_margin", "+", "margins", True, -30.0, 70.0), ("inventories", "+", "assets", False, 0.0, 80000.0),
)
LOSS_PRONE = ("pat", "pbt", "operating_profit", "core_revenue", "totals")
LIMITS_SQL = "l(concept, sign, section, percent, lo, hi) as (values " + ", ".join(f"('{c}', '{s}', '{x}', {str(p).lower()}, {lo}::double, {hi}::double)" for c, s, x, p, lo, hi in LIMITS) + ")"
SIGN = f"sign = '+' and value < -1 and section not in {LOSS_PRONE}"
RANGE = "case when percent and (value < lo - 5 or value > hi + 20) then 'high' else 'medium' end"


def limited(lines: DataFrame, limits=LIMITS) -> DataFrame:
    table = lines.sparkSession.createDataFrame(list(limits), "concept string, sign string, section string, percent boolean, lo double, hi double")
    return lines.join(F.broadcast(table), "concept")  # written by hand


@query("v01_sign_rule", oracle(f"with {LIMITS_SQL} select company_id, fy, concept, value, 'medium' as severity from fx_lines join l using (concept) where {SIGN}", "fx_lines"))
def v01(spark, sf_dir):
    return limited(fixture(spark, sf_dir, "fx_lines")).where(SIGN).select("company_id", "fy", "concept", "value", F.lit("medium").alias("severity"))


@query("v02_range_rule", oracle(f"with {LIMITS_SQL} select company_id, fy, concept, value, {RANGE} as severity from fx_lines join l using (concept) where value < lo or value > hi", "fx_lines"))
def v02(spark, sf_dir):
    return limited(fixture(spark, sf_dir, "fx_lines")).where("value < lo or value > hi").select("company_id", "fy", "concept", "value", F.expr(RANGE).alias("severity"))


EXEMPT = "exception|tax|gain|loss"
HISTORY_SWING = "abs(prior) >= 1 and (abs(value) / abs(prior) > 5 or abs(value) / abs(prior) < 0.2)"


def history_swings(lines: DataFrame, keys: Sequence[str] = ("company_id", "concept"), exempt: str = EXEMPT) -> DataFrame:
    """Values more than five times or less than a fifth of those of the closest earlier year."""
    prior = F.last("value").over(Window.partitionBy(*keys).orderBy("fy").rangeBetween(Window.unboundedPreceding, -1))
    return lines.where(~F.col("concept").rlike(exempt)).withColumn("prior", prior).where(HISTORY_SWING)


@query("v04_history_swing", oracle(f"select company_id, concept, fy, value, prior, 'high' as severity from (select *, lag(value) over (partition by company_id, concept order by fy) as prior from fx_lines where not regexp_matches(concept, '{EXEMPT}')) where {HISTORY_SWING}", "fx_lines"))
def v04(spark, sf_dir):
    return history_swings(fixture(spark, sf_dir, "fx_lines")).select("company_id", "concept", "fy", "value", "prior", F.lit("high").alias("severity"))


def routed(sector: str | None) -> str:
    """The sector's own rules, or the general ones for companies of no routed sector."""
    return f"sector = '{sector}'" if sector else f"sector not in {ROUTED}"


def issues(wide: DataFrame, checks=rules.CHECKS) -> DataFrame:
    """All checks in one pass: (keys, rule, concept, severity, suggested) for each broken one that the sector has."""
    broken = [
        F.when(F.expr(f"{routed(sector)} and {condition}"), F.struct(F.lit(rule).alias("rule"), F.lit(concept).alias("concept"), F.lit(severity).alias("severity"), F.expr(f"cast({fix or 'null'} as double)").alias("suggested")))
        for _, sector, rule, concept, severity, condition, fix in checks
    ]
    return wide.select(*KEY, F.inline(F.array_compact(F.array(*broken))))


def _issue_sql(check: tuple) -> str:
    _, sector, rule, concept, severity, condition, fix = check
    return f"select company_id, sector, fy, '{rule}' as rule, '{concept}' as concept, '{severity}' as severity, cast({fix or 'null'} as double) as suggested from wide where {routed(sector)} and {condition}"


def _register(name: str) -> None:
    own = [c for c in rules.CHECKS if c[0] == name]

    @query(name, oracle(f"with {WIDE} " + " union all ".join(map(_issue_sql, own)), "fx_lines"))
    def check(spark, sf_dir):
        return issues(_wide(spark, sf_dir), own)


for _name in dict.fromkeys(c[0] for c in rules.CHECKS):
    _register(_name)


def _waterfall() -> list[tuple[str, str, str]]:
    """(issue, concept, condition)."""
    out = [(f"{low} over {name}", low, f"{up} > 0 and {low} > 0 and {low} > {up} * 1.15") for up, low, name in rules.WATERFALL]
    out += [(f"{name} negative", name, f"{e} < 0") for name, e in rules.NOT_NEGATIVE]
    low, high = rules.MARGIN_BOUNDS
    revenue = rules.WATERFALL[0][0]
    margin = f"ebitda / nullif({revenue}, 0.0) * 100"
    return [*out, ("margin high", "ebitda", f"{revenue} > 0 and {margin} > {high}"), ("margin low", "ebitda", f"{revenue} > 0 and {margin} < {low}")]


@query("v17_waterfall", oracle(f"with {WIDE} " + " union all ".join(f"select company_id, fy, '{i}' as issue, '{c}' as concept from wide where {w}" for i, c, w in _waterfall()), "fx_lines"))
def v17(spark, sf_dir):
    broken = [F.when(F.expr(w), F.struct(F.lit(i).alias("issue"), F.lit(c).alias("concept"))) for i, c, w in _waterfall()]
    return _wide(spark, sf_dir).select("company_id", "fy", F.inline(F.array_compact(F.array(*broken))))


@query("v18_tool_checks", oracle(f"with {WIDE} " + " union all ".join(f"select company_id, fy, '{label}' as label, '{s}' as severity from wide where {w}" for label, s, w in rules.TOOL_CHECKS), "fx_lines"))
def v18(spark, sf_dir):
    broken = [F.when(F.expr(w), F.struct(F.lit(label).alias("label"), F.lit(s).alias("severity"))) for label, s, w in rules.TOOL_CHECKS]
    return _wide(spark, sf_dir).select("company_id", "fy", F.inline(F.array_compact(F.array(*broken))))


_ROW = "select company_id, sector, fy, '{rule}' as rule, concept, {severity} as severity, cast(null as double) as suggested from {source}"


@query(
    "v19_all_rules",
    oracle(
        f"with {WIDE}, {LIMITS_SQL}, x as (select * from fx_lines join l using (concept)), s as (select *, lag(value) over (partition by company_id, concept order by fy) as prev, lag(fy) over (partition by company_id, concept order by fy) as prev_fy from fx_lines), "
        + f"h as (select *, lag(value) over (partition by company_id, concept order by fy) as prior from fx_lines where not regexp_matches(concept, '{EXEMPT}')) "
        + " union all ".join([*map(_issue_sql, rules.CHECKS), _ROW.format(rule="sign", severity="'medium'", source=f"x where {SIGN}"), _ROW.format(rule="range", severity=RANGE, source="x where value < lo or value > hi"),
                              _ROW.format(rule="yoy_swing", severity="'high'", source="s where prev_fy = fy - 1 and abs(prev) > 1 and (abs(value) / abs(prev) > 5 or abs(value) / abs(prev) < 0.2)"), _ROW.format(rule="historical_swing", severity="'high'", source=f"h where {HISTORY_SWING}")]),
        "fx_lines",
    ),
)
def v19(spark, sf_dir):
    """The issues table: sign, range and swings for all, identities by sector."""
    lines = fixture(spark, sf_dir, "fx_lines")
    row = lambda df, rule, severity: df.select(*KEY, F.lit(rule).alias("rule"), "concept", severity.alias("severity"), F.lit(None).cast("double").alias("suggested"))
    known, high = limited(lines), F.lit("high")
    year = Window.partitionBy("company_id", "concept").orderBy("fy")
    swung = lines.withColumns({"prev": F.lag("value").over(year), "prev_fy": F.lag("fy").over(year)}).where("prev_fy = fy - 1 and abs(prev) > 1 and (abs(value) / abs(prev) > 5 or abs(value) / abs(prev) < 0.2)")
    parts = [row(known.where(SIGN), "sign", F.lit("medium")), row(known.where("value < lo or value > hi"), "range", F.expr(RANGE)), row(swung, "yoy_swing", high), row(history_swings(lines), "historical_swing", high)]
    out = issues(wide_lines(lines))
    for part in parts:
        out = out.unionByName(part)
    return out


def auto_fixed(wide: DataFrame, concept: str, condition: str, fix: str, require_empty: bool = True) -> DataFrame:
    """wide with the suggested value put in the concept's cell: only an empty one, or with require_empty false also one that breaks the check."""
    value, new = F.col(concept), F.expr(fix)
    hit = value.isNull() & new.isNotNull() if require_empty else F.coalesce(F.expr(condition), F.lit(False)) | (value.isNull() & new.isNotNull())
    return wide.withColumns({f"{concept}_fixed": hit, concept: F.when(hit, new).otherwise(value)})


_NII = next(c for c in rules.CHECKS if c[2] == "nii_identity")


@query("v21_auto_fix", oracle(f"with {WIDE}, f as (select *, net_interest_income is null and {_NII[6]} is not null as e, coalesce({_NII[5]}, false) as b from wide where sector = 'bank') select company_id, fy, case when e then {_NII[6]} else net_interest_income end as filled, e as filled_now, case when e or b then {_NII[6]} else net_interest_income end as corrected from f", "fx_lines"))
def v21(spark, sf_dir):
    banks = _wide(spark, sf_dir).where("sector = 'bank'")
    empty = auto_fixed(banks, "net_interest_income", _NII[5], _NII[6]).select("company_id", "fy", F.col("net_interest_income").alias("filled"), F.col("net_interest_income_fixed").alias("filled_now"))
    broken = auto_fixed(banks, "net_interest_income", _NII[5], _NII[6], require_empty=False).select("company_id", "fy", F.col("net_interest_income").alias("corrected"))
    return empty.join(broken, ["company_id", "fy"])
