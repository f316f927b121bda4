"""Filters (FLT): row, label, page and batch tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query


def batch_facts(obs: DataFrame, keys: list[str]) -> DataFrame:
    """What the soundness of a batch depends on; facts of parts of a batch add up."""
    size = F.abs("value")
    named = F.length(F.regexp_replace("raw_label", "[^A-Za-z]", "")) > 4
    return obs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(size.cast("decimal(38,4)")).alias("total"), F.bool_or(size > 1).alias("big"), F.bool_or(named).alias("named"))


def added_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bool_or("big").alias("big"), F.bool_or("named").alias("named"))


def batch_reasons(obs: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Why a source's batch is not sound, null if it is. The rows stay; only storing them is withheld."""
    return batch_facts(obs, keys).select(*keys, "n", reason_of(least).alias("reason"))


def reason_of(least: int = 3) -> Column:
    return F.when(F.col("n") < least, "few items").when(F.col("total") <= 0, "all zero").when(~F.col("big"), "tiny values").when(~F.col("named"), "no labels")


@query("flt1_batch_sanity", oracle("select company_id, source, fy, count(*) as n, case when count(*) < 3 then 'few items' when not bool_or(length(raw_label) > 4) then 'no labels' end as reason from fx_obs group by 1, 2, 3", "fx_obs"))
def flt1(spark, sf_dir):
    return batch_reasons(fixture(spark, sf_dir, "fx_obs"), ["company_id", "source", "fy"])


def garbled(text: Column) -> Column:
    """100 characters and 30 words or more, over 35 percent of the words single letters."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return (F.length(text) >= 100) & (F.size(words) >= 30) & (F.size(F.filter(words, lambda w: w.rlike("^[A-Za-z]$"))) > 0.35 * F.size(words))


@query("flt10_garbled_text", r"with t as (select doc_id, case when doc_id % 4 = 0 then regexp_replace(text, '([a-z])', '\1 ', 'g') else text end as t from documents), w as (select doc_id, t, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') as ws from t) select doc_id, length(t) >= 100 and len(ws) >= 30 and len(list_filter(ws, lambda x: regexp_full_match(x, '[A-Za-z]'))) > 0.35 * len(ws) as garbled from w")
def flt10(spark, sf_dir):
    text = F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", "([a-z])", "$1 ")).otherwise(F.col("text"))
    return fixture(spark, sf_dir, "documents").withColumn("t", text).select("doc_id", garbled(F.col("t")).alias("garbled"))


def without_reference(values: Column) -> Column:
    """Numbers of a line without a leading note reference: the first of three or more, whole, 1-99."""
    first = values[0]
    is_ref = (F.size(values) >= 3) & (first == F.floor(first)) & first.between(1, 99)
    return F.when(is_ref, F.slice(values, F.lit(2), F.size(values))).otherwise(values)


@query("flt11_note_reference", "with v as (select l_orderkey as line, list(l_quantity order by l_linenumber, l_partkey, l_quantity) as vs from lineitem group by 1) select line, array_to_string(list_transform(case when len(vs) >= 3 and vs[1] = floor(vs[1]) and vs[1] between 1 and 99 then vs[2:] else vs end, lambda x: cast(cast(x as integer) as varchar)), ',') as numbers from v")
def flt11(spark, sf_dir):
    values = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"])
    lines = fixture(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line")).agg(values.alias("vs"))
    return lines.select("line", F.array_join(F.transform(without_reference(F.col("vs")), lambda v: v.cast("int").cast("string")), ",").alias("numbers"))


@query("flt12_grid_trust", "with r as (select l_orderkey as row, l_linenumber as col, l_extendedprice as v, lag(l_extendedprice) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as prev, min(abs(l_extendedprice)) over (partition by l_orderkey) as least from lineitem) select row, col, v as value, not (v = 0) as trusted, not (v = 0 or v between 1990 and 2050 or least > 1e6) as fallback, not (v = 0 or v between 1990 and 2050 or least > 1e6 or coalesce(greatest(abs(v), abs(prev)) / least(abs(v), abs(prev)) > 100, false)) as strict from r")
def flt12(spark, sf_dir):
    row = Window.partitionBy("l_orderkey")
    v = F.col("l_extendedprice")
    prev = F.lag(v).over(row.orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = fixture(spark, sf_dir, "lineitem").withColumns({"prev": prev, "least": F.min(F.abs(v)).over(row)})
    zero, year_like = v == 0, v.between(1990, 2050)
    swing = F.coalesce(F.greatest(F.abs(v), F.abs("prev")) / F.least(F.abs(v), F.abs("prev")) > 100, F.lit(False))
    loose = zero | year_like | (F.col("least") > 1e6)
    return rows.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), v.alias("value"), (~zero).alias("trusted"), (~loose).alias("fallback"), (~(loose | swing)).alias("strict"))


@query("flt13_plausible_year", oracle("select company_id, raw_label, fy, count(*) as n from fx_obs where fy between 1980 and 2035 group by 1, 2, 3", "fx_obs"))
def flt13(spark, sf_dir, low: int = 1980, high: int = 2035):
    return fixture(spark, sf_dir, "fx_obs").where(F.col("fy").between(low, high)).groupBy("company_id", "raw_label", "fy").agg(F.count("*").alias("n"))


def document_kind(name: Column) -> Column:
    t = F.lower(name)
    return F.when(t.rlike("annual[-_ ]?report|integrated[-_ ]?report"), "annual").when(t.rlike("presentation|investor"), "presentation").when(t.rlike(r"q[1-4]|quarter|result"), "quarterly").otherwise("other")


@query("flt14_document_kind", "select o_orderkey as id, case o_orderkey % 4 when 0 then 'annual' when 1 then 'presentation' when 2 then 'quarterly' else 'other' end as kind from orders")
def flt14(spark, sf_dir):
    names = F.array(*map(F.lit, ("Annual_Report_", "investor-presentation-", "Q3_results_", "notice_")))
    name = F.concat(F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")), F.col("o_orderkey"), F.lit(".pdf"))
    return fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), document_kind(name).alias("kind"))


@query("flt16_sheet_periods", oracle("select o.company_id, o.raw_label, o.fy, o.fq, o.source, o.statement_type from fx_obs o semi join (select distinct company_id, fy from fx_obs where source = 'xbrl' and fq = 4) p on o.company_id = p.company_id and o.fy = p.fy", "fx_obs"))
def flt16(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    return obs.join(obs.where("source = 'xbrl' and fq = 4").select("company_id", "fy"), ["company_id", "fy"], "left_semi").select("company_id", "raw_label", "fy", "fq", "source", "statement_type")


@query("flt17_confidence_floor", "select l_orderkey as id, l_linenumber as line, l_partkey as part, case when l_discount < 0.03 then 'below floor' when l_returnflag = 'A' then 'cell filled' when abs(l_extendedprice - l_quantity * 1000) <= 0.01 then 'no change' else 'accepted' end as outcome from lineitem")
def flt17(spark, sf_dir, floor: float = 0.03):
    outcome = F.when(F.col("l_discount") < floor, "below floor").when(F.col("l_returnflag") == "A", "cell filled").when(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000) <= 0.01, "no change").otherwise("accepted")
    return fixture(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), outcome.alias("outcome"))


@query("flt18_scope_pairs", oracle("with a as (select distinct company_id, statement_type as wanted from fx_obs), b as (select distinct company_id, case when company_id % 3 = 0 then null else statement_type end as table_scope, case when company_id % 2 = 0 then 'consolidated' end as doc_scope from fx_obs) select company_id, wanted, table_scope, doc_scope from a join b using (company_id) where coalesce(table_scope, doc_scope, wanted) = wanted", "fx_obs"))
def flt18(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs").select("company_id", "statement_type").distinct()
    tables = obs.select("company_id", F.when(F.col("company_id") % 3 != 0, F.col("statement_type")).alias("table_scope"), F.when(F.col("company_id") % 2 == 0, "consolidated").alias("doc_scope")).distinct()
    met = obs.withColumnRenamed("statement_type", "wanted").join(tables, "company_id")
    return met.where(F.coalesce("table_scope", "doc_scope", "wanted") == F.col("wanted")).select("company_id", "wanted", "table_scope", "doc_scope")


@query("flt19_chunk_years", oracle("with d as (select company_id, raw_label, list(distinct fy) as years from fx_obs where source = 'xbrl' and fq = 1 group by 1, 2), t as (select company_id, raw_label, years, unnest([1996, 2001]) as target from d) select company_id, raw_label, target from t where len(list_filter(years, lambda y: abs(y - target) <= 1)) > 0", "fx_obs"))
def flt19(spark, sf_dir):
    chunks = fixture(spark, sf_dir, "fx_obs").where("source = 'xbrl' and fq = 1").groupBy("company_id", "raw_label").agg(F.collect_set("fy").alias("years"))
    asked = chunks.withColumn("target", F.explode(F.array(F.lit(1996), F.lit(2001))))
    return asked.where((F.size("years") == 0) | F.exists("years", lambda y: F.abs(y - F.col("target")) <= 1)).select("company_id", "raw_label", "target")


@query("flt20_writable_cells", "with c as (select distinct l_orderkey as row, l_linenumber as col from lineitem) select row, col from c anti join (select l_orderkey as row, l_linenumber as col from lineitem where l_returnflag = 'A') f using (row, col) anti join (select l_orderkey as row, l_linenumber as col from lineitem where l_quantity > 25) g using (row, col)")
def flt20(spark, sf_dir):
    cells = fixture(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), "l_returnflag", "l_quantity")
    grid = cells.select("row", "col").distinct()
    return grid.join(cells.where("l_returnflag = 'A'"), ["row", "col"], "left_anti").join(cells.where("l_quantity > 25"), ["row", "col"], "left_anti")
