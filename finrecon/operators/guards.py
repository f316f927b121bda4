"""Guards of written and of proposed values: V23 blanks cells in three ordered steps and counts them, V20 refuses candidates that matched totals or their own years contradict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.functions import labels as lb
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

# Equal quarters of a row that are too many, the difference under which scopes are equal, and how far a quarter may exceed its year. A judged row has three quarters and its sheet three quarter columns at least.
MOST_EQUAL, SAME_SCOPES, OVER_YEAR = 4, 0.01, 1.5
# Slack of a component over its total, the least figure whose swing counts and the swing, words that mark totals and words that tie no labels.
OVER_TOTAL, SWING_FROM, SWING, TOTALS, LOOSE = 1.05, 1.0, 10.0, ("total", "sum"), ("total", "sum", "of", "the")

SHEET = ["company_id", "sheet"]


def write_guards(cells: DataFrame) -> DataFrame:
    """cells (company_id, sheet, scope, label, period, value) with guard, the first that blanks the cell, else null, and value, null where one does.

    1 ``duplicate_quarterly``: a value in MOST_EQUAL quarters of a row or more, of sheets with three quarter columns. 2 ``cons_eq_standalone``: the standalone cell where the consolidated one of its sheet, label and period is the same.
    3 ``magnitude_too_high``: a quarter above OVER_YEAR times the largest year figure of the company's label in any sheet and scope. Each step sees what the ones before left; zeros and nulls take no part.

    All windows lie within companies and share two sorts; cells that are dealt by company are not shuffled."""
    filled = F.col("value").isNotNull() & (F.col("value") != 0)
    rows = cells.withColumn("_quarter", F.when(F.col("period").rlike(r"^[1-4]QF\d{4}$"), F.col("period"))).withColumn("_live", F.when(F.col("_quarter").isNotNull() & filled, F.round("value", 2)))
    by_row = Window.partitionBy(*SHEET).orderBy("scope", "label", "_live")
    sheet, equal = by_row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_row.rangeBetween(Window.currentRow, Window.currentRow)
    spans = rows.withColumns({"_first": F.min("_quarter").over(sheet), "_last": F.max("_quarter").over(sheet), "_same": F.count("_live").over(equal), "_before": F.lag("label").over(by_row)})
    # A quarter between the first and the last makes three columns; a row of MOST_EQUAL quarters has three of them.
    between = F.bool_or((F.col("_quarter") > F.col("_first")) & (F.col("_quarter") < F.col("_last"))).over(sheet)
    # A label is normalised at the first of its rows and carried on over the others.
    named = F.last(F.when(~F.col("label").eqNullSafe(F.col("_before")), lb.normal(F.col("label"))), ignorenulls=True).over(by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = F.col("_live").isNotNull() & (F.col("_same") >= MOST_EQUAL) & F.coalesce("_between", F.lit(False))
    year = F.when(F.col("_quarter").isNotNull(), F.concat(F.lit("F"), F.substring("_quarter", 4, 4))).otherwise(F.col("period"))
    keys = {"_label": F.when(F.col("label").isNotNull(), F.col("_named")), "_year": year, "_live": F.col("_live").isNotNull(), "_one": one}
    first = spans.withColumns({"_between": between, "_named": named}).select(*cells.columns, *(c.alias(k) for k, c in keys.items()))
    left, by_year = F.when(~F.col("_one") & (F.col("value") != 0), F.col("value")), ["company_id", "_label", "_year"]
    other = F.max(F.when(F.col("scope") == "consolidated", left)).over(Window.partitionBy(*by_year, "sheet", "label", "period"))
    second = first.withColumn("_two", ~F.col("_one") & F.coalesce((F.col("scope") == "standalone") & (F.abs(other - left) < SAME_SCOPES), F.lit(False)))
    kept = ~F.col("_one") & ~F.col("_two")
    annual = F.max(F.when(kept & filled & F.col("period").rlike(r"^F\d{4}$"), F.abs("value"))).over(Window.partitionBy(*by_year))
    three = kept & F.col("_live") & F.coalesce(F.abs("value") > OVER_YEAR * annual, F.lit(False))
    guard = F.when(F.col("_one"), "duplicate_quarterly").when(F.col("_two"), "cons_eq_standalone").when(three, "magnitude_too_high")
    return second.select(*cells.columns, guard.alias("guard")).withColumn("value", F.when(F.col("guard").isNull(), F.col("value")))


def guard_counts(guarded: DataFrame) -> DataFrame:
    """(sheet, guard, cells): cells that each guard blanked."""
    return guarded.where("guard is not null").groupBy("sheet", "guard").agg(F.count("*").alias("cells"))


_CELLS_SQL = """q as (select company_id, 'quarters' as sheet, statement_type as scope, raw_label as label, concat(fq, 'QF', fy) as period, fy,
   case when company_id % 3 = 0 then floor(fy / 3) * 1000.0::double when company_id % 3 = 1 and fq = 2 then 70000.0::double else round(value, 2) end as value from fx_obs where source = 'xbrl'),
 y as (select company_id, 'years' as sheet, scope, label, concat('F', fy) as period, fy, cast(sum(cast(value as decimal(20,2))) as double) * case when company_id % 2 = 0 then 0.25::double else 1.0::double end as value from q group by 1, 2, 3, 4, 5, 6),
 c as (select company_id, sheet, scope, label, period, fy, value from q union all select company_id, sheet, scope, label, period, fy, value from y)"""
V23_SQL = f"""with {_CELLS_SQL}, w as (select *, sheet = 'quarters' and value <> 0 as live, (select count(distinct period) from q where q.company_id = c.company_id) as columns from c),
 a as (select *, live and columns >= 3 and count(*) filter (where live) over (partition by company_id, sheet, scope, label) >= 3 and count(*) filter (where live) over (partition by company_id, sheet, scope, label, round(value, 2)) >= 4 as one from w),
 b as (select *, case when not one and value <> 0 then value end as left_ from a), b2 as (select *, max(case when scope = 'consolidated' then left_ end) over (partition by company_id, sheet, label, period) as other from b),
 d as (select *, not one and coalesce(scope = 'standalone' and abs(other - left_) < 0.01, false) as two from b2),
 e as (select *, max(case when not one and not two and value <> 0 and sheet = 'years' then abs(value) end) over (partition by company_id, label, fy) as annual from d),
 g as (select *, case when one then 'duplicate_quarterly' when two then 'cons_eq_standalone' when live and abs(value) > 1.5 * annual then 'magnitude_too_high' end as guard from e)"""


def _cells(spark, sf_dir) -> DataFrame:
    """Quarters of a source with repeated figures for a third of the companies and equal ones of both scopes for another, and years that fall short of their quarters for half of them; dealt by company, in as many parts as shuffles have,
    since the guards take much longer than the bytes of their input tell."""
    obs = fixture(spark, sf_dir, "fx_obs").where("source = 'xbrl'")
    value = F.when(F.col("company_id") % 3 == 0, F.floor(F.col("fy") / 3) * 1000.0).when((F.col("company_id") % 3 == 1) & (F.col("fq") == 2), 70000.0).otherwise(F.round("value", 2))
    quarters = obs.select("company_id", F.col("statement_type").alias("scope"), F.col("raw_label").alias("label"), "fy", "fq", value.alias("value"))
    dealt = quarters.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "company_id")
    total = F.sum(F.col("value").cast("decimal(20,2)")).cast("double") * F.when(F.col("company_id") % 2 == 0, 0.25).otherwise(1.0)
    own = [c for n in range(1, 5) for c in (F.max(F.when(F.col("fq") == n, F.col("value"))).alias(f"value{n}"), F.count_if(F.col("fq") == n).alias(f"n{n}"))]
    years = dealt.groupBy("company_id", "scope", "label", "fy").agg(total.alias("total"), *own)
    cell = lambda sheet, prefix, value: F.struct(F.lit(sheet).alias("sheet"), "scope", "label", F.concat(F.lit(prefix), F.col("fy")).alias("period"), F.col(value).alias("value"))
    cells = F.array(cell("years", "F", "total"), *(F.when(F.col(f"n{n}") > 0, cell("quarters", f"{n}QF", f"value{n}")) for n in range(1, 5)))
    return years.select("company_id", F.inline(cells)).where("sheet is not null")


@query("v23_ordered_guards", oracle(f"{V23_SQL} select company_id, sheet, scope, label, period, case when guard is null then value end as value, guard from g", "fx_obs"))
def v23_guards(spark, sf_dir):
    return write_guards(_cells(spark, sf_dir))


@query("v23_guard_counts", oracle(f"{V23_SQL} select sheet, guard, count(*) as cells from g where guard is not null group by 1, 2", "fx_obs"))
def v23_counts(spark, sf_dir):
    return guard_counts(write_guards(_cells(spark, sf_dir)))


def _words(label: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(label)), r"[^a-z0-9]+"), lambda w: w != ""))


def refused(candidates: DataFrame, filled: DataFrame) -> DataFrame:
    """(company_id, label, reason) of candidate rows (company_id, label, fy, value) that filled ones (the same columns) or their own years contradict; a label is refused whole, for its first reason.

    A label that is no total is refused for ``over_total`` if a year's value exceeds that of a filled total with which it shares a word, and any label for ``swing`` if a year differs from the one before by more than SWING. Labels meet
    totals on shared words within a company and year."""
    is_total = F.lower(F.col("label")).rlike("|".join(TOTALS))
    words = F.array_except(_words(F.col("label")), F.array(*map(F.lit, LOOSE)))
    tied = filled.where(is_total & (F.col("value") > 0)).withColumn("w", F.explode(words)).groupBy("company_id", "fy", "w").agg(F.min("value").alias("total"))
    totals = tied.groupBy("company_id", "fy").agg(F.map_from_entries(F.collect_list(F.struct("w", "total"))).alias("totals"))
    limit = lambda w: F.try_element_at("totals", w) * OVER_TOTAL
    over = F.when(~is_total & F.col("totals").isNotNull(), F.coalesce(F.exists(words, lambda w: F.col("value") > limit(w)), F.lit(False))).otherwise(F.lit(False))
    judged = candidates.join(totals, ["company_id", "fy"], "left").select("company_id", "label", "fy", "value", over.alias("_over"))
    before = F.lag("value").over(Window.partitionBy("company_id", "label").orderBy("fy"))
    ratio = F.abs("value") / F.abs("_before")
    swung = (F.abs("_before") >= SWING_FROM) & ((ratio > SWING) | (ratio < 1 / SWING))
    reason = F.when(F.col("_over"), "over_total").when(swung, "swing")
    return judged.withColumn("_before", before).groupBy("company_id", "label").agg(F.min(reason).alias("reason")).where("reason is not null")


_V20_SQL = """with c as (select company_id, replace(concept, '_', ' ') as label, fy, value from fx_lines),
 w as (select *, unnest(list_distinct(list_filter(string_split_regex(label, '[^a-z0-9]+'), lambda x: x not in ('', 'total', 'sum', 'of', 'the')))) as w, contains(label, 'total') or contains(label, 'sum') as t from c),
 o as (select distinct a.company_id, a.label from w a join w b on a.company_id = b.company_id and a.fy = b.fy and a.w = b.w and b.t and b.value > 0 and a.value > b.value * 1.05 where not a.t),
 l as (select *, lag(value) over (partition by company_id, label order by fy) as p from c), s as (select distinct company_id, label from l where abs(p) >= 1 and (abs(value) / abs(p) > 10 or abs(value) / abs(p) < 0.1))
 select company_id, label, min(reason) as reason from (select *, 'over_total' as reason from o union all select *, 'swing' from s) group by 1, 2"""


@query("v20_refused_candidates", oracle(_V20_SQL, "fx_lines"))
def v20_refused(spark, sf_dir):
    lines = fixture(spark, sf_dir, "fx_lines").select("company_id", F.replace("concept", F.lit("_"), F.lit(" ")).alias("label"), "fy", "value")
    return refused(lines, lines)
