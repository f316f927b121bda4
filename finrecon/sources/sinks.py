"""Sinks (SNK): routed writes that never overwrite, wide views, coverage, audit, review and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from finrecon.operators.pools import pool
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query


def disposed(fills: DataFrame, formulas: DataFrame, filled: DataFrame) -> DataFrame:
    """Adds disposition to fills (row, col, value, tier): review for flagged ones, skipped with a reason for taken cells, else written."""
    f = formulas.select("row", "col", F.lit(True).alias("_formula")).distinct()
    g = filled.select("row", "col", F.lit(True).alias("_filled")).distinct()
    met = fills.join(f, ["row", "col"], "left").join(g, ["row", "col"], "left")
    disposition = F.when(F.col("tier") == "FLAG", "review").when(F.col("_formula"), "skipped: formula").when(F.col("_filled"), "skipped: filled").otherwise("written")
    return met.withColumn("disposition", disposition).withColumn("value", F.round("value", 2)).drop("_formula", "_filled")


def write_routed(routed: DataFrame, path: str) -> None:
    """One write, a folder for each disposition."""
    routed.write.partitionBy("disposition").mode("append").parquet(path)


def _fills(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = fixture(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), "l_partkey", F.col("l_extendedprice").alias("value"), "l_returnflag", "l_discount", "l_tax")
    fills = rows.withColumn("tier", F.when(F.col("l_discount") > 0.08, "FLAG").otherwise("HIGH")).select("row", "col", "l_partkey", "value", "tier")
    return fills, rows.where("l_returnflag = 'A' and l_tax > 0.05").select("row", "col"), rows.where("l_returnflag = 'R' and l_tax > 0.05").select("row", "col")


DISPOSED_SQL = """with i as (select l_orderkey as row, l_linenumber as col, l_partkey, round(l_extendedprice, 2) as value, case when l_discount > 0.08 then 'FLAG' else 'HIGH' end as tier from lineitem),
 f as (select distinct l_orderkey as row, l_linenumber as col from lineitem where l_returnflag = 'A' and l_tax > 0.05), g as (select distinct l_orderkey as row, l_linenumber as col from lineitem where l_returnflag = 'R' and l_tax > 0.05),
 d as (select i.*, case when tier = 'FLAG' then 'review' when f.row is not null then 'skipped: formula' when g.row is not null then 'skipped: filled' else 'written' end as disposition from i left join f on i.row = f.row and i.col = f.col left join g on i.row = g.row and i.col = g.col)"""


@query("snk1_routed_write", DISPOSED_SQL + " select * from d")
def snk1(spark, sf_dir):
    return disposed(*_fills(spark, sf_dir))


@query("snk2_confidence", DISPOSED_SQL + " select row, col, l_partkey, case when disposition = 'review' then 'flag' when disposition <> 'written' then 'kept' when l_partkey % 3 = 0 then 'derived' when l_partkey % 3 = 1 then 'consensus' else 'default' end as confidence from d")
def snk2(spark, sf_dir):
    out = disposed(*_fills(spark, sf_dir))
    level = F.when(F.col("disposition") == "review", "flag").when(F.col("disposition") != "written", "kept").when(F.col("l_partkey") % 3 == 0, "derived").when(F.col("l_partkey") % 3 == 1, "consensus").otherwise("default")
    return out.select("row", "col", "l_partkey", level.alias("confidence"))


#: Years of the view, newest first; a parameter of the report, and wider than the years of the tables.
WIDE_YEARS = tuple(range(2009, 1989, -1))


@query("snk3_wide_view", oracle("select company_id, raw_label, case when contains(raw_label, 'promo') then '%' else 'crore' end as uom, " + ", ".join(f"max(case when fy = {y} then value end) as f{y}" for y in WIDE_YEARS) + " from fx_obs where source = 'xbrl' and statement_type = 'consolidated' and fq = 4 group by 1, 2, 3", "fx_obs"))
def snk3(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_obs").where("source = 'xbrl' and statement_type = 'consolidated' and fq = 4")
    uom = F.when(F.col("raw_label").rlike("promo"), "%").otherwise("crore")
    wide = rows.groupBy("company_id", "raw_label", uom.alias("uom")).pivot("fy", list(WIDE_YEARS)).agg(F.max("value"))
    return wide.select("company_id", "raw_label", "uom", *(F.col(str(y)).alias(f"f{y}") for y in WIDE_YEARS))


@query("snk4_coverage", oracle("select source, statement_type, count(distinct raw_label) as labels, string_agg(distinct fy::varchar, ',' order by fy::varchar) as periods from fx_obs group by 1, 2", "fx_obs"))
def snk4(spark, sf_dir):
    years = F.array_join(F.array_sort(F.collect_set(F.col("fy").cast("string"))), ",")
    return fixture(spark, sf_dir, "fx_obs").groupBy("source", "statement_type").agg(F.count_distinct("raw_label").alias("labels"), years.alias("periods"))


@query("snk5_audit_log", DISPOSED_SQL + " select row, col, l_partkey, printf('%.2f', value) as shown, disposition as action from d where disposition <> 'review'")
def snk5(spark, sf_dir):
    out = disposed(*_fills(spark, sf_dir)).where("disposition <> 'review'")
    return out.select("row", "col", "l_partkey", F.format_string("%.2f", "value").alias("shown"), F.col("disposition").alias("action"))


@query("snk6_review", oracle("select a.company_id, a.raw_label, a.fy, a.fq, a.value as ours, b.value as theirs, round(abs(a.value - b.value) / abs(b.value), 4) as difference from fx_obs a join fx_obs b on a.company_id = b.company_id and a.raw_label = b.raw_label and a.fy = b.fy and a.fq = b.fq and a.statement_type = b.statement_type where a.source = 'xbrl' and b.source = 'screener' and a.statement_type = 'standalone' and abs(a.value - b.value) > 0.25 * abs(b.value)", "fx_obs"))
def snk6(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_obs").where("statement_type = 'standalone'")
    keys = ["company_id", "raw_label", "fy", "fq"]
    both = rows.where("source = 'xbrl'").select(*keys, F.col("value").alias("ours")).join(rows.where("source = 'screener'").select(*keys, F.col("value").alias("theirs")), keys)
    return both.where("abs(ours - theirs) > 0.25 * abs(theirs)").withColumn("difference", F.round(F.abs(F.col("ours") - F.col("theirs")) / F.abs("theirs"), 4))


@query("snk7_append_dump", oracle("with s as (select company_id as sheet, bool_or(source = 'xbrl' and fq = 4 and fy = 1996 and raw_label = 'promo') as labelled from fx_obs group by 1) select company_id as sheet, raw_label, fy, fq, source, statement_type, value from fx_obs semi join (select sheet from s where not labelled) n on n.sheet = company_id", "fx_obs"))
def snk7(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    labelled = obs.where("source = 'xbrl' and fq = 4 and fy = 1996 and raw_label = 'promo'").select("company_id").distinct()
    return obs.join(labelled, "company_id", "left_anti").select(F.col("company_id").alias("sheet"), "raw_label", "fy", "fq", "source", "statement_type", "value")


@query("snk8_fallback_block", oracle("with f as (select company_id, count(*) filter (where source = 'xbrl' and fq = 4 and fy = 1996 and statement_type = 'consolidated') as n from fx_obs group by 1) select o.company_id, o.raw_label, o.fy, o.fq, o.statement_type, o.value from fx_obs o join f using (company_id) where n < 2 and o.source = 'screener'", "fx_obs"))
def snk8(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    filled = obs.groupBy("company_id").agg(F.count_if(F.expr("source = 'xbrl' and fq = 4 and fy = 1996 and statement_type = 'consolidated'")).alias("n")).where("n < 2")
    return obs.where("source = 'screener'").join(filled, "company_id", "left_semi").select("company_id", "raw_label", "fy", "fq", "statement_type", "value")


@query("snk9_verbatim_dump", "with t as (select l_orderkey as doc, count(*) as rows, count(*) filter (where l_quantity > 10) as numeric_cells from lineitem group by 1) select doc, l_linenumber as line, l_returnflag as statement, l_linestatus as scope, l_extendedprice as value from lineitem join t on doc = l_orderkey where rows >= 3 and numeric_cells >= 3")
def snk9(spark, sf_dir):
    rows = fixture(spark, sf_dir, "lineitem")
    good = rows.groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.count_if(F.col("l_quantity") > 10).alias("cells")).where("rows >= 3 and cells >= 3")
    return rows.join(good, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("statement"), F.col("l_linestatus").alias("scope"), F.col("l_extendedprice").alias("value"))


def history_additions(new: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append to the store: HIGH ones whose key it does not hold; a stored value is never replaced."""
    return new.where("tier = 'HIGH'").drop("tier").join(history.select(*keys), keys, "left_anti")


@query("snk10_history", oracle("with n as (select company_id, raw_label as concept, fy, max(value) as value from fx_obs where source = 'xbrl' group by 1, 2, 3), h as (select distinct company_id, raw_label as concept, fy from fx_obs where source = 'yfinance' and fq = 2) select n.* from n anti join h using (company_id, concept, fy) where value > 60000", "fx_obs"))
def snk10(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    keys = ["company_id", "concept", "fy"]
    new = obs.where("source = 'xbrl'").groupBy("company_id", F.col("raw_label").alias("concept"), "fy").agg(F.max("value").alias("value"))
    history = obs.where("source = 'yfinance' and fq = 2").select("company_id", F.col("raw_label").alias("concept"), "fy").distinct()
    return history_additions(new.withColumn("tier", F.when(F.col("value") > 60000, "HIGH").otherwise("LOW")), history, keys)


@query("snk11_seed_history", oracle("select company_id, raw_label as concept, fy, arg_max(value, (case source when 'xbrl' then 100 when 'screener' then 60 else 40 end) * 10 + fq) as value from fx_obs where statement_type = 'consolidated' and value <> 0 and raw_label <> 'promo' group by 1, 2, 3", "fx_obs"))
def snk11(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs").where("statement_type = 'consolidated' and value <> 0 and raw_label <> 'promo'")
    best = pool(obs, ["company_id", "raw_label", "fy"], -F.col("fq"))
    return best.select("company_id", F.col("raw_label").alias("concept"), "fy", "value")
