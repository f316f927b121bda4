"""Choices by tables and bounds that are arguments: synonyms of tokens (L7, J6), periods to ask for (FLT16, U4), cells to fill (J25), floors of confidence (FLT17), tallies and coverage (A9, A10), provenance (A17), one report for each year or address (W9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.functions import labels as lb
from finrecon.operators.joins import top
from finrecon.operators.pools import RANK_SQL, rank_of
from finrecon.operators.setjoins import Overlap, meeting
from finrecon.operators.texts import quoted
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

# Words that stand for a token besides itself.
TOKEN_SYNONYMS = {
    "amortisation": ("amortization",), "amortization": ("amortisation",), "depreciation": ("depn",), "tax": ("taxation",), "interest": ("finance",), "finance": ("interest",), "ppe": ("property", "plant", "equipment"), "fixed": ("ppe",),
    "receivables": ("debtors",), "payables": ("creditors",), "borrowings": ("debt", "loans"), "cash": ("bank",), "employee": ("staff", "personnel"),
}
# Floors of confidence by use, the least change of a filled value, scores from which labels match, and words of labels whose values may be losses.
FLOORS, LEAST_CHANGE = {"cli": 0.5, "fill": 0.55, "correction": 0.80, "recheck": 0.75, "recheck_loose": 0.65}, 0.01
MATCH, MATCH_ONE_CONCEPT, CONTAINED = 0.55, 0.70, 0.7
MAY_BE_LOSS = ("pat", "pbt", "profit", "earnings", "eps", "diluted", "exceptional", "gain", "loss", "comprehensive income")


def expanded_tokens(label: Column, synonyms: Mapping[str, Sequence[str]] = TOKEN_SYNONYMS) -> Column:
    """The words of a normal label with the synonyms of each."""
    words = F.filter(F.split(lb.normal(label), " "), lambda w: w != "")
    table = F.create_map(*(x for w, own in synonyms.items() for x in (F.lit(w), F.array(*map(F.lit, own)))))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))))


def overlap_matches(template: DataFrame, pool: DataFrame, synonyms: Mapping[str, Sequence[str]] = TOKEN_SYNONYMS) -> DataFrame:
    """(template_label, pool_label, score): the best pool label (label, concept) of each template label (label, concept), both of distinct labels, by expanded tokens: the larger of jaccard and 0.7 containment with three tokens or more on both sides.

    A match takes 0.55, or 0.70 where only the pool label has a concept; labels of different concepts never match. Ties go to the pool label that comes first. Labels meet on prefixes of their expanded tokens."""
    tokens = lambda label: expanded_tokens(label, synonyms)
    need = lambda share: lambda ts, label: F.size(ts) * share
    least = MATCH / CONTAINED
    met = meeting(template.select("label"), pool.select("label"), [Overlap(tokens, need(MATCH), need(MATCH)), Overlap(tokens, need(least), None), Overlap(tokens, None, need(least))])
    x, y = tokens(F.col("a")), tokens(F.col("b"))
    scored = met.join(template.toDF("a", "ca"), "a").join(pool.toDF("b", "cb"), "b").withColumn("score", F.round(lb.overlap_score(x, y), 6))
    bound = F.when(F.col("ca").isNull() & F.col("cb").isNotNull(), MATCH_ONE_CONCEPT).otherwise(MATCH)
    good = scored.where((F.col("score") >= bound) & (F.col("ca").isNull() | F.col("cb").isNull() | (F.col("ca") == F.col("cb"))))
    return top(good, ["a"], [F.desc("score"), F.col("b")]).select(F.col("a").alias("template_label"), F.col("b").alias("pool_label"), "score")


def asked_periods(template: Column, data: Column, quarterly: bool, text: Column | None = None) -> Column:
    """The periods to ask for, newest first, from those of a template and of the data (arrays). Quarters: those of both, else the template's, else the data's. Years: those of both and the newest one of the template, two where text is there
    (true); without data the template's."""
    mine = F.sort_array(F.array_distinct(template), asc=False)
    both = F.array_intersect(mine, data)
    if quarterly:
        return F.when(F.size(both) > 0, both).when(F.size(mine) > 0, mine).otherwise(F.sort_array(F.array_distinct(data), asc=False))
    newest = F.slice(mine, F.lit(1), F.when(F.coalesce(text, F.lit(False)), 2).otherwise(1) if text is not None else F.lit(1))
    found = F.when(F.size(data) > 0, F.sort_array(F.array_union(both, newest), asc=False)).otherwise(mine)
    return F.when(F.size(found) > 0, found).otherwise(mine)


def cells_to_fill(rows: DataFrame, columns: DataFrame, taken: DataFrame) -> DataFrame:
    """(sheet, row, label, period): the cells of template rows (sheet, row, label) in the period columns of their sheet (sheet, period) that are neither filled nor formulas (taken: sheet, row, period). A sheet's columns are few."""
    periods = columns.groupBy("sheet").agg(F.collect_set("period").alias("ps"))
    cells = rows.join(periods, "sheet").select("sheet", "row", "label", F.explode("ps").alias("period"))
    return cells.join(taken.select("sheet", "row", "period").distinct(), ["sheet", "row", "period"], "left_anti")


def gated(fills: DataFrame, floors: Mapping[str, float] = FLOORS, least_change: float = LEAST_CHANGE) -> DataFrame:
    """fills (use, label, confidence, value, current) with outcome and written, the value that the cell gets.

    Below the floor of its use a fill is dropped; into an empty cell it is written, negative magnitudes above 0.5 as positive ones unless the label may be a loss; a correction overwrites if it changes the value by more than least_change; any other fill finds the
    cell filled. An unknown use has no floor."""
    floor = F.lit(0.0)
    for use, value in floors.items():
        floor = F.when(F.col("use") == use, value).otherwise(floor)
    loss = F.lower("label").rlike("|".join(MAY_BE_LOSS))
    value = F.when((F.col("value") < 0) & (F.abs("value") > 0.5) & ~loss, F.abs("value")).otherwise(F.col("value"))
    outcome = (
        F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) < floor, "below floor").when(F.col("value").isNull(), "value not numeric").when(F.col("current").isNull(), "written")
        .when(F.col("use") != "correction", "cell already filled").when(F.abs(F.col("value") - F.col("current")) > least_change, "corrected").otherwise("no change")
    )
    return fills.withColumn("outcome", outcome).withColumn("written", F.when(F.col("outcome") == "written", value).when(F.col("outcome") == "corrected", F.col("value")))


def tallies(rows: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    """(by..., kind, n) for each level of by, from all of it down to none of it; what is summed over is null."""
    names = list(by)
    levels = [names[:k] for k in range(len(names), -1, -1)]
    return rows.groupingSets([[F.col(c) for c in (*own, kind)] for own in levels], *(F.col(c) for c in (*names, kind))).agg(F.count("*").alias("n"))


def coverage(expected: DataFrame, facts: DataFrame, keys: Sequence[str], section: str = "section") -> DataFrame:
    """(keys, section, found, expected, share): how many of the fields (section, field) that are expected for each key are there with a value; facts are (keys, field, value)."""
    have = facts.where("value is not null").select(*keys, "field").distinct().withColumn("_there", F.lit(1))
    grid = facts.select(*keys).distinct().join(F.broadcast(expected.groupBy(section).agg(F.collect_set("field").alias("fs")).groupBy().agg(F.collect_list(F.struct(section, "fs")).alias("all"))))
    cells = grid.select(*keys, F.inline("all")).select(*keys, section, F.explode("fs").alias("field")).join(have, [*keys, "field"], "left")
    out = cells.groupBy(*keys, section).agg(F.count("_there").alias("found"), F.count("*").alias("expected"))
    return out.withColumn("share", F.round(F.col("found") / F.col("expected"), 6))


def provenance(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """(keys, sources, first, winner): the sources of a cell by rank, each once, the source that arrived first and the one that wins; rows have source and the columns of order."""
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct((-rank_of(F.col("source"))).alias("r"), "source"))), lambda x: x["source"]))
    return rows.groupBy(*keys).agg(names.alias("sources"), F.min_by("source", F.struct(*order)).alias("first"), F.max_by("source", F.struct(rank_of(F.col("source")))).alias("winner"))


def one_report(reports: DataFrame, company: str, by: str, order: Sequence[Column], null_is_a_group: bool = True) -> DataFrame:
    """The first report of each company and year or address. Reports without one are one group, or are dropped."""
    return top(reports if null_is_a_group else reports.where(F.col(by).isNotNull()), [company, by], list(order))


_TOK = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
_SYN = "syn(w, s) as (values " + ", ".join(f"({quoted(w)}, {quoted(s)})" for w, own in TOKEN_SYNONYMS.items() for s in own) + ")"
J6_SQL = f"""with {_SYN}, t as (select distinct replace(concept, '_', ' ') as label, case when length(concept) % 3 > 0 then substr(concept, 1, 4) end as c from fx_lines),
 p as (select distinct concat(replace(replace(replace(replace(concept, '_', ' '), 'tax', 'taxation'), 'amortization', 'amortisation'), 'finance', 'interest'), case when length(concept) % 2 = 0 then ' account' else '' end) as label, case when length(concept) % 4 > 0 then substr(concept, 1, 4) end as c from fx_lines),
 e as (select label, list(distinct w) as ws from (select label, unnest({_TOK.format('label')}) as w from (select label from t union select label from p) union all select label, s from (select label, unnest({_TOK.format('label')}) as w from (select label from t union select label from p)) join syn using (w)) group by 1),
 m as (select t.label as a, p.label as b, t.c as ca, p.c as cb, len(list_intersect(x.ws, y.ws)) as i, len(x.ws) as n, len(y.ws) as k from t cross join p join e x on x.label = t.label join e y on y.label = p.label),
 s as (select *, round(greatest(i / (n + k - i), case when n >= 3 and k >= 3 then 0.7 * (i / least(n, k)) else 0 end), 6) as score from m),
 g as (select *, row_number() over (partition by a order by score desc, b) as o from s where score >= case when ca is null and cb is not null then 0.70 else 0.55 end and (ca is null or cb is null or ca = cb))
 select a as template_label, b as pool_label, score from g where o = 1"""


@query("j06_synonym_overlap", oracle(J6_SQL, "fx_lines"))
def j06_synonyms(spark, sf_dir):
    names = fixture(spark, sf_dir, "fx_lines").select("concept").distinct()
    plain = F.replace("concept", F.lit("_"), F.lit(" "))
    own = lambda n: F.when(F.length("concept") % n > 0, F.substring("concept", 1, 4)).alias("concept")
    other = plain
    for a, b in (("tax", "taxation"), ("amortization", "amortisation"), ("finance", "interest")):
        other = F.replace(other, F.lit(a), F.lit(b))
    other = F.concat(other, F.when(F.length("concept") % 2 == 0, " account").otherwise(""))
    return overlap_matches(names.select(plain.alias("label"), own(3)).distinct(), names.select(other.alias("label"), own(4)).distinct())


@query("u04_asked_years", oracle("with t as (select company_id, list(distinct fy) as t, list(distinct fy) filter (where source = 'xbrl') as d from fx_obs group by 1), n as (select company_id, list_sort(t, 'DESC') as t, coalesce(d, []) as d from t) select company_id, array_to_string(case when len(d) > 0 then list_sort(list_distinct(list_concat(list_intersect(t, d), t[1:case when company_id % 2 = 0 then 2 else 1 end])), 'DESC') else t end, ',') as years from n", "fx_obs"))
def u04_asked(spark, sf_dir):
    sheet = fixture(spark, sf_dir, "fx_obs").groupBy("company_id").agg(F.collect_set("fy").alias("t"), F.collect_set(F.when(F.col("source") == "xbrl", F.col("fy"))).alias("d"))
    years = asked_periods(F.col("t"), F.col("d"), False, F.col("company_id") % 2 == 0)
    return sheet.select("company_id", F.array_join(F.transform(years, lambda y: y.cast("string")), ",").alias("years"))


@query("j25_cells_to_fill", oracle("with r as (select distinct company_id as sheet, raw_label as row from fx_obs), c as (select distinct company_id as sheet, fy as period from fx_obs), t as (select distinct company_id as sheet, raw_label as row, fy as period from fx_obs where source = 'xbrl' or fq = 4) select sheet, row, period from r join c using (sheet) anti join t using (sheet, row, period)", "fx_obs"))
def j25_cells(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs").select(F.col("company_id").alias("sheet"), F.col("raw_label").alias("row"), F.col("raw_label").alias("label"), F.col("fy").alias("period"), "source", "fq")
    return cells_to_fill(obs.select("sheet", "row", "label").distinct(), obs.select("sheet", "period").distinct(), obs.where("source = 'xbrl' or fq = 4")).select("sheet", "row", "period")


_FILL_SQL = """f as (select l_orderkey as id, l_linenumber as line, l_partkey as part, case l_linenumber % 4 when 0 then 'cli' when 1 then 'fill' when 2 then 'correction' else 'recheck' end as use, case when l_partkey % 3 = 0 then 'Profit after tax' else 'Finance cost' end as label,
 0.4 + l_discount * 6 as confidence, case when l_returnflag = 'R' then -l_quantity else l_quantity end as value, case when l_linestatus = 'O' then case when l_tax < 0.02 then l_quantity else l_quantity + l_tax end end as current from lineitem),
 o as (select *, case when confidence < case use when 'cli' then 0.5 when 'fill' then 0.55 when 'correction' then 0.8 else 0.75 end then 'below floor' when current is null then 'written' when use <> 'correction' then 'cell already filled' when abs(value - current) > 0.01 then 'corrected' else 'no change' end as outcome from f)"""


def _fills(spark, sf_dir) -> DataFrame:
    use = F.element_at(F.array(*map(F.lit, ("cli", "fill", "correction", "recheck"))), F.col("l_linenumber").cast("int") % 4 + 1)
    value = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    current = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_tax") < 0.02, F.col("l_quantity")).otherwise(F.col("l_quantity") + F.col("l_tax")))
    label = F.when(F.col("l_partkey") % 3 == 0, "Profit after tax").otherwise("Finance cost")
    rows = fixture(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), use.alias("use"), label.alias("label"), (0.4 + F.col("l_discount") * 6).alias("confidence"), value.alias("value"), current.alias("current"))


@query("flt17_gated_fills", f"with {_FILL_SQL} select id, line, part, outcome, case outcome when 'written' then case when value < -0.5 and label = 'Finance cost' then -value else value end when 'corrected' then value end as written from o")
def flt17_gated(spark, sf_dir):
    return gated(_fills(spark, sf_dir)).select("id", "line", "part", "outcome", "written")


@query("a09_fill_tallies", f"with {_FILL_SQL} select coalesce(use, 'all') as use, coalesce(label, 'all') as label, outcome, count(*) as n from o group by grouping sets ((use, label, outcome), (use, outcome), (outcome))")
def a09_fills(spark, sf_dir):
    return tallies(gated(_fills(spark, sf_dir)), ["use", "label"], "outcome").fillna("all", ["use", "label"])


@query("a10_section_coverage", oracle("with e as (select distinct statement_type as section, raw_label as field from fx_obs), k as (select distinct company_id, fy from fx_obs where source = 'xbrl'), h as (select distinct company_id, fy, raw_label as field from fx_obs where source = 'xbrl' and value > 40000) select company_id, fy, section, count(h.field) as found, count(*) as expected, round(count(h.field) / count(*), 6) as share from k cross join e left join h using (company_id, fy, field) group by 1, 2, 3", "fx_obs"))
def a10_coverage(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    facts = obs.where("source = 'xbrl'").select("company_id", "fy", F.col("raw_label").alias("field"), F.when(F.col("value") > 40000, F.col("value")).alias("value"))
    return coverage(obs.select(F.col("statement_type").alias("section"), F.col("raw_label").alias("field")).distinct(), facts, ["company_id", "fy"])


@query("a17_first_arrival", oracle(f"with s as (select company_id, raw_label, fy, source, {RANK_SQL} as rank, min(fq * 2 + (statement_type = 'standalone')::int) as arrived from fx_obs group by 1, 2, 3, 4, 5) select company_id, raw_label, fy, string_agg(source, ',' order by rank desc, source) as sources, arg_min(source, concat(lpad(arrived::varchar, 4, '0'), source)) as first, arg_max(source, rank) as winner from s group by 1, 2, 3", "fx_obs"))
def a17_first(spark, sf_dir):
    order = [(F.col("fq") * 2 + (F.col("statement_type") == "standalone").cast("int")).alias("arrived"), F.col("source")]
    found = provenance(fixture(spark, sf_dir, "fx_obs"), ["company_id", "raw_label", "fy"], order)
    return found.withColumn("sources", F.array_join("sources", ","))


@query("w09_report_by_address", "with r as (select o_custkey as company_id, case when o_orderkey % 7 > 0 then concat('r', o_orderkey % 3) end as url, o_orderkey as id, row_number() over (partition by o_custkey, o_orderkey % 7 = 0, o_orderkey % 3 order by o_totalprice, o_orderkey) as k from orders) select company_id, url, id from r where k = 1 and url is not null")
def w09_address(spark, sf_dir):
    url = F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("r"), (F.col("o_orderkey") % 3).cast("string")))
    reports = fixture(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), url.alias("url"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return one_report(reports, "company_id", "url", [F.col("o_totalprice"), F.col("id")], null_is_a_group=False).select("company_id", "url", "id")
