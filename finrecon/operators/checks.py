"""Derivation (D) and validation (V): formulas over concepts, identities, swings, fixes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.operators.pools import CONCEPT_KEYS, WIDE_SQL, wide
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

_TOKEN = re.compile(r"\s*([A-Za-z_]\w*|\d+(?:\.\d+)?|[-+*/()])")


def compiled(formula: str, names: list[str]) -> Column:
    """A formula of concepts, numbers, + - * / and brackets as a Column; null where an input is missing or a divisor is zero.

    The text is checked token by token against the concept names before it becomes a SQL expression."""
    at, out = 0, []
    while at < len(formula.rstrip()):
        m = _TOKEN.match(formula, at)
        if not m or (m[1][0].isalpha() and m[1] not in names):
            raise ValueError(f"not a formula over concepts: {formula!r} at {at}")
        out.append(f"`{m[1]}`" if m[1][0].isalpha() or m[1][0] == "_" else m[1])
        at = m.end()
    text = " ".join(out)
    # Division of x by y becomes x / nullif(y, 0), so a zero divisor gives null.
    text = re.sub(r"/ (`\w+`|\d\S*)", r"/ nullif(\1, 0)", text)
    return F.round(F.expr(text), 4)


FORMULAS = (("net_cost", "cost_of_goods_sold + other_expenses"), ("cost_share", "( cost_of_goods_sold + other_expenses ) / revenue_from_operations"))


@query("d1_concept_formula", oracle(f"with {WIDE_SQL} select company_id, source, statement_type, fy, fq, round(cost_of_goods_sold + other_expenses, 4) as net_cost, round((cost_of_goods_sold + other_expenses) / nullif(revenue_from_operations, 0), 4) as cost_share from wide", "fx_concepts"))
def d1(spark, sf_dir):
    w = wide(fixture(spark, sf_dir, "fx_concepts"))
    return w.select(*CONCEPT_KEYS, *(compiled(f, w.columns).alias(n) for n, f in FORMULAS))


SWING_SQL = "with y as (select company_id, source, concept, fy, cast(sum(cast(value as decimal(18,2))) as double) as value from fx_concepts where statement_type = 'consolidated' group by 1, 2, 3, 4), p as (select *, lag(value) over w as prev, lag(fy) over w as prev_fy from y window w as (partition by company_id, source, concept order by fy))"


def _years(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_concepts").where("statement_type = 'consolidated'")
    return rows.groupBy("company_id", "source", "concept", "fy").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


def swings(years: DataFrame, keys: list[str], high: float, low: float) -> DataFrame:
    """Rows whose value is more than high or less than low times that of the year before; a gap in the years starts anew."""
    w = Window.partitionBy(*keys).orderBy("fy")
    rows = years.withColumns({"prev": F.lag("value").over(w), "prev_fy": F.lag("fy").over(w)})
    ratio = F.abs(F.col("value")) / F.abs(F.col("prev"))
    return rows.where((F.col("prev_fy") == F.col("fy") - 1) & (F.abs("prev") > 1)).withColumn("ratio", ratio).where((F.col("ratio") > high) | (F.col("ratio") < low))


@query("w01_yearly_swing", oracle(f"{SWING_SQL} select company_id, source, concept, fy, round(abs(value) / abs(prev), 6) as ratio from p where prev_fy = fy - 1 and abs(prev) > 1 and (abs(value) / abs(prev) > 5 or abs(value) / abs(prev) < 0.2)", "fx_concepts"))
def w01(spark, sf_dir):
    return swings(_years(spark, sf_dir), ["company_id", "source", "concept"], 5, 0.2).select("company_id", "source", "concept", "fy", F.round("ratio", 6).alias("ratio"))


@query("w02_adjacent_swing", oracle(f"{SWING_SQL} select company_id, source, concept, fy, value, prev from p where prev is not null and (abs(value) > 10 * abs(prev) or abs(prev) > 10 * abs(value))", "fx_concepts"))
def w02(spark, sf_dir):
    prev = F.lag("value").over(Window.partitionBy("company_id", "source", "concept").orderBy("fy"))
    rows = _years(spark, sf_dir).withColumn("prev", prev)
    return rows.where("abs(value) > 10 * abs(prev) or abs(prev) > 10 * abs(value)")


@query("v03_swing_issue", oracle(f"{SWING_SQL} select company_id, source, concept, fy, 'high' as severity from p where prev_fy = fy - 1 and abs(prev) > 1 and (abs(value) / abs(prev) > 5 or abs(value) / abs(prev) < 0.2)", "fx_concepts"))
def v03(spark, sf_dir):
    return swings(_years(spark, sf_dir), ["company_id", "source", "concept"], 5, 0.2).select("company_id", "source", "concept", "fy", F.lit("high").alias("severity"))


@query("v20_match_guard", oracle("with t as (select company_id, fy, max(value) as total from fx_obs where raw_label = 'standard' and source = 'xbrl' group by 1, 2) select o.company_id, o.fy, o.fq, o.source, o.statement_type, o.raw_label, o.value > 1.05 * t.total as refused from fx_obs o join t using (company_id, fy) where raw_label <> 'standard'", "fx_obs"))
def v20(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    totals = obs.where("raw_label = 'standard' and source = 'xbrl'").groupBy("company_id", "fy").agg(F.max("value").alias("total"))
    met = obs.where("raw_label <> 'standard'").join(totals, ["company_id", "fy"])
    return met.select("company_id", "fy", "fq", "source", "statement_type", "raw_label", (F.col("value") > 1.05 * F.col("total")).alias("refused"))


@query("v22_retry", oracle("with c as (select company_id, fy, fq, concept, value, row_number() over (partition by company_id, fy, fq, concept order by case source when 'xbrl' then 0 when 'screener' then 1 else 2 end, statement_type) as k from fx_concepts), e as (select * from c where concept = 'cost_of_goods_sold' and k <= 6), r as (select company_id, fy, fq, value as revenue from c where concept = 'revenue_from_operations' and k = 1), p as (select e.company_id, e.fy, e.fq, e.k, e.value, e.value <= r.revenue as passes from e join r using (company_id, fy, fq)) select company_id, fy, fq, coalesce(arg_min(value, k) filter (where passes), arg_min(value, k)) as value, not bool_or(passes) as flagged from p group by 1, 2, 3", "fx_concepts"))
def v22(spark, sf_dir):
    order = [F.when(F.col("source") == "xbrl", 0).when(F.col("source") == "screener", 1).otherwise(2), F.col("statement_type")]
    ranked = fixture(spark, sf_dir, "fx_concepts").withColumn("k", F.row_number().over(Window.partitionBy("company_id", "fy", "fq", "concept").orderBy(*order)))
    first = ranked.where("concept = 'revenue_from_operations' and k = 1").select("company_id", "fy", "fq", F.col("value").alias("revenue"))
    tried = ranked.where("concept = 'cost_of_goods_sold' and k <= 6").join(first, ["company_id", "fy", "fq"]).withColumn("passes", F.expr("value <= revenue"))
    best = tried.groupBy("company_id", "fy", "fq").agg(F.min_by("value", F.when(F.col("passes"), F.col("k"))).alias("ok"), F.min_by("value", "k").alias("given"), F.bool_or("passes").alias("any"))
    return best.select("company_id", "fy", "fq", F.when(F.col("any"), F.col("ok")).otherwise(F.col("given")).alias("value"), (~F.col("any")).alias("flagged"))


@query("v23_write_guards", oracle("with a as (select *, count(*) over (partition by company_id, source, statement_type, fy, concept) as n, count(*) over (partition by company_id, source, statement_type, fy, concept, round(value / 20000)) as same from fx_concepts), b as (select company_id, source, statement_type, fy, fq, concept, case when same < 3 then value end as value from a), c as (select company_id, source, fy, fq, concept, value as other from b where statement_type = 'consolidated') select b.company_id, b.source, b.statement_type, b.fy, b.fq, b.concept, case when b.statement_type = 'standalone' and abs(round(other / 1000) - round(b.value / 1000)) < 0.01 then null else b.value end as value from b left join c using (company_id, source, fy, fq, concept)", "fx_concepts"))
def v23(spark, sf_dir):
    keys = ["company_id", "source", "fy", "fq", "concept"]
    same = F.count("*").over(Window.partitionBy("company_id", "source", "statement_type", "fy", "concept", F.round(F.col("value") / 20000)))
    kept = fixture(spark, sf_dir, "fx_concepts").select(*keys, "statement_type", F.when(same < 3, F.col("value")).alias("value"))
    other = kept.where("statement_type = 'consolidated'").select(*keys, F.col("value").alias("other"))
    equal = (F.col("statement_type") == "standalone") & F.coalesce(F.abs(F.round(F.col("other") / 1000) - F.round(F.col("value") / 1000)) < 0.01, F.lit(False))
    return kept.join(other, keys, "left").select(*keys, "statement_type", F.when(~equal, F.col("value")).alias("value"))


