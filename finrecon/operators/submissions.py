"""Submitted labels to template labels (J24), component sums of read figures (A8), and the wide view of a sheet (SNK3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.operators.joins import top
from finrecon.operators.texts import quoted
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

# What a label may begin and end with besides its name, and words of labels that are percentages.
OPERATORS, REMARKS = ("less:", "add:", "plus:", "minus:"), ("(net)", "(gross)", "(consolidated)", "(standalone)")
PERCENT = r"(?i)%|ratio|margin|return|roa\b|roe\b|nim\b|crar\b|gnpa|nnpa|casa|yield|cost\s+of|coverage|spread"
# Sums of components by field, and how many of the components it takes.
COMPONENTS = (("Less: Cost of goods sold", ("_cogs_materials", "_cogs_purchases", "_cogs_inventory_change"), 2), ("Less: Tax", ("tax_current", "tax_deferred"), 2))


def submitted_key(label: Column) -> Column:
    """A label without operators in front and remarks behind, in lower case, words parted by one blank. Each operator and remark is tried once, in order."""
    t = F.lower(F.trim(label))
    # One reference to the text for each step, so the expression grows with the steps only.
    for p in OPERATORS:
        t = F.regexp_replace(t, rf"^{p}\s*", "")
    for r in REMARKS:
        t = F.regexp_replace(t, rf"\s*\({r[1:-1]}\)$", "")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def resolved_submissions(labels: DataFrame, template: DataFrame, concepts: DataFrame) -> DataFrame:
    """(label, template_label, tier) of submitted labels (label) against a template (template_label, ord) and the concepts of labels (label, concept): 1 the same text, 2 the same key, 3 the same concept,
    4 a key that holds the other or shares two words with it or half of the shorter one's words. Of several template labels the first; a label without any has no row. Labels meet on equal keys, concepts or words of a template, which is a short list."""
    own = labels.select("label").distinct().where("label <> ''").withColumn("key", submitted_key(F.col("label")))
    known = template.select("template_label", "ord", submitted_key(F.col("template_label")).alias("tkey"))
    one = own.join(known.select(F.col("template_label").alias("label"), "template_label", "ord"), "label").select("label", "template_label", "ord", F.lit(1).alias("tier"))
    two = own.where("key <> ''").join(known, F.col("key") == F.col("tkey")).select("label", "template_label", "ord", F.lit(2).alias("tier"))
    of = known.join(concepts.select(F.col("label").alias("template_label"), "concept"), "template_label").select("template_label", "ord", "concept")
    three = own.where("key <> ''").join(concepts, "label").join(of, "concept").select("label", "template_label", "ord", F.lit(3).alias("tier"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    x = own.select("label", "key", words(F.col("key")).alias("xs"), F.explode(words(F.col("key"))).alias("w"))
    y = known.select("template_label", "ord", "tkey", words(F.col("tkey")).alias("ys"), F.explode(words(F.col("tkey"))).alias("w"))
    shared = F.size(F.array_intersect("xs", "ys"))
    near = F.col("key").contains(F.col("tkey")) | F.col("tkey").contains(F.col("key")) | (shared >= 2) | (shared / F.least(F.size("xs"), F.size("ys")) >= 0.5)
    four = x.join(y, "w").where(near).select("label", "template_label", "ord", F.lit(4).alias("tier"))
    return top(one.union(two).union(three).union(four), ["label"], [F.col("tier"), F.col("ord")]).select("label", "template_label", "tier")


def component_sums(figures: DataFrame, keys: Sequence[str], components=COMPONENTS) -> DataFrame:
    """(keys, field, value) of sums over figures (keys, field, value, ord): the first value of each component, where enough are there and the field itself is not."""
    parts = list(dict.fromkeys(p for _, own, _ in components for p in own))
    firsts = figures.where("value is not null").groupBy(*keys).agg(
        *(F.min_by("value", F.when(F.col("field") == p, F.col("ord"))).alias(f"p{i}") for i, p in enumerate(parts)), *(F.max(F.col("field") == c).alias(f"has{i}") for i, (c, _, _) in enumerate(components))
    )
    rows = []
    for i, (field, own, least) in enumerate(components):
        values = F.array_compact(F.array(*(F.col(f"p{parts.index(p)}") for p in own)))
        rows.append(F.when(~F.col(f"has{i}") & (F.size(values) >= least), F.struct(F.lit(field).alias("field"), F.aggregate(values, F.lit(0.0), lambda s, v: s + v).alias("value"))))
    return firsts.select(*keys, F.inline(F.array_compact(F.array(*rows))))


def period_order(period: Column) -> Column:
    """Places of periods from the newest: years by year, quarters by year and quarter."""
    year, quarter = F.regexp_extract(period, r"(\d{4})$", 1).cast("int"), F.coalesce(F.regexp_extract(period, r"^([1-4])QF", 1).try_cast("int"), F.lit(0))
    return -(year * 10 + quarter)


def wide_view(rows: DataFrame, keys: Sequence[str], currency: str = "crore") -> DataFrame:
    """(keys, label, uom, cells) of rows (keys, label, period, value): one row for a label with its values as an array of (period, value), newest first, over all periods of the keys; a label that reads as a ratio is in percent.

    A sheet's periods are few, so they are an array and not columns: sheets with other periods share the view. Of several values the first by size is kept."""
    cells = rows.groupBy(*keys, "label", "period").agg(F.max("value").alias("value"))
    periods = rows.groupBy(*keys).agg(F.collect_set("period").alias("ps"))
    each = cells.groupBy(*keys, "label").agg(F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("m")).join(periods, list(keys))
    ordered = F.transform(F.array_sort(F.transform("ps", lambda p: F.struct(period_order(p).alias("o"), p.alias("p")))), lambda x: F.struct(x["p"].alias("period"), F.try_element_at(F.col("m"), x["p"]).alias("value")))
    return each.select(*keys, "label", F.when(F.col("label").rlike(PERCENT), "%").otherwise(currency).alias("uom"), ordered.alias("cells"))


_VIEW_SQL = f"""with c as (select company_id, concat(raw_label, case when company_id % 2 = 0 then ' margin' else '' end) as label, case when fq = 4 then concat('F', fy) else concat(fq, 'QF', fy) end as period, fy * 10 + case when fq = 4 then 0 else fq end as o, max(value) as value from fx_obs where source = 'xbrl' group by 1, 2, 3, 4),
 p as (select distinct company_id, period, o from c), l as (select distinct company_id, label from c)
 select company_id, label, case when regexp_matches(label, {quoted(PERCENT)}) then '%' else 'crore' end as uom, string_agg(concat(period, '=', coalesce(cast(cast(c.value as decimal(20,2)) as varchar), '')), ';' order by p.o desc) as cells from l join p using (company_id) left join c using (company_id, label, period) group by 1, 2, 3"""


@query("snk3_sheet_view", oracle(_VIEW_SQL, "fx_obs"))
def snk3_view(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs").where("source = 'xbrl'")
    label = F.concat("raw_label", F.when(F.col("company_id") % 2 == 0, " margin").otherwise(""))
    period = F.when(F.col("fq") == 4, F.concat(F.lit("F"), "fy")).otherwise(F.concat(F.col("fq"), F.lit("QF"), "fy"))
    view = wide_view(obs.select("company_id", label.alias("label"), period.alias("period"), "value"), ["company_id"])
    text = F.transform("cells", lambda c: F.concat(c["period"], F.lit("="), F.coalesce(c["value"].cast("decimal(20,2)").cast("string"), F.lit(""))))
    return view.select("company_id", "label", "uom", F.array_join(text, ";").alias("cells"))


@query("a08_figure_sums", oracle("with f as (select company_id, fy, case concept when 'revenue_from_operations' then '_cogs_materials' when 'cost_of_goods_sold' then '_cogs_purchases' when 'employee_benefits_expense' then '_cogs_inventory_change' when 'other_expenses' then 'tax_current' when 'finance_cost' then 'tax_deferred' when 'ebitda' then 'Less: Tax' end as field, round(value) as value from fx_lines), p as (select company_id, fy, max(case when field = '_cogs_materials' then value end) as a, max(case when field = '_cogs_purchases' then value end) as b, max(case when field = '_cogs_inventory_change' then value end) as c, max(case when field = 'tax_current' then value end) as d, max(case when field = 'tax_deferred' then value end) as e, count(*) filter (where field = 'Less: Tax') as has from f where field is not null group by 1, 2) select company_id, fy, 'Less: Cost of goods sold' as field, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) as value from p where (a is not null)::int + (b is not null)::int + (c is not null)::int >= 2 union all select company_id, fy, 'Less: Tax', d + e from p where d is not null and e is not null and has = 0", "fx_lines"))
def a08_figures(spark, sf_dir):
    names = {"revenue_from_operations": "_cogs_materials", "cost_of_goods_sold": "_cogs_purchases", "employee_benefits_expense": "_cogs_inventory_change", "other_expenses": "tax_current", "finance_cost": "tax_deferred", "ebitda": "Less: Tax"}
    field = F.lit(None).cast("string")
    for concept, name in names.items():
        field = F.when(F.col("concept") == concept, name).otherwise(field)
    figures = fixture(spark, sf_dir, "fx_lines").select("company_id", "fy", field.alias("field"), F.round("value").alias("value"), F.lit(1).alias("ord")).where("field is not null")
    return component_sums(figures, ["company_id", "fy"])


_KEY_SQL = "trim(regexp_replace(case when ends_with({0}, '(net)') then trim({0}[:-6]) else {0} end, '[^a-z0-9]+', ' ', 'g'))"
_LESS = "case when starts_with(lower({0}), 'less:') then trim(substr(lower({0}), 6)) else lower({0}) end"
J24_SQL = f"""with t as (select template_label, row_number() over (order by template_label) as ord, lower(template_label) as tkey from fx_template),
 l as (select raw_label as label from fx_pool_label union select template_label from fx_template union select concat('Plus: ', split_part(template_label, ' ', 2), ' items') from fx_template union select concat('Concept ', template_label) from fx_template),
 n as (select label, {_LESS.format('label')} as s from l), n2 as (select label, case when starts_with(s, 'plus:') then trim(substr(s, 6)) else s end as s from n), k as (select label, {_KEY_SQL.format('s')} as key from n2),
 c as (select 'Concept ' || template_label as label, template_label as concept from fx_template union all select template_label, case when length(template_label) % 2 = 0 then template_label end from fx_template),
 m as (select k.label, t.template_label, ord, 1 as tier from k join t on k.label = t.template_label union all select k.label, t.template_label, ord, 2 from k join t on k.key = t.tkey
  union all select k.label, t.template_label, t.ord, 3 from k join c a using (label) join c b on a.concept = b.concept join t on t.template_label = b.label
  union all select label, template_label, ord, 4 from (select k.label, t.template_label, ord, key, tkey, list_distinct(string_split(key, ' ')) as xs, list_distinct(string_split(tkey, ' ')) as ys from k cross join t) where len(list_intersect(xs, ys)) > 0 and (contains(key, tkey) or contains(tkey, key) or len(list_intersect(xs, ys)) >= 2 or len(list_intersect(xs, ys)) / least(len(xs), len(ys)) >= 0.5))
 select label, template_label, tier from (select *, row_number() over (partition by label order by tier, ord) as o from m) where o = 1"""


@query("j24_resolved_submissions", oracle(J24_SQL, "fx_template", "fx_pool_label"))
def j24_resolved(spark, sf_dir):
    template = fixture(spark, sf_dir, "fx_template")
    # A template is a short list in its own order.
    ordered = template.withColumn("ord", F.row_number().over(Window.orderBy("template_label")))
    name = F.col("template_label")
    extra = template.select(F.explode(F.array(name, F.concat(F.lit("Plus: "), F.split_part(name, F.lit(" "), F.lit(2)), F.lit(" items")), F.concat(F.lit("Concept "), name))).alias("label"))
    labels = fixture(spark, sf_dir, "fx_pool_label").select(F.col("raw_label").alias("label")).union(extra).distinct()
    concepts = template.select(F.concat(F.lit("Concept "), name).alias("label"), name.alias("concept")).union(template.where(F.length(name) % 2 == 0).select(name, name))
    return resolved_submissions(labels, ordered, concepts)
