"""Joins (J): labels to concepts and template rows, periods as of a year, intervals, routes and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.functions import labels as lb, numbers as nb
from finrecon.operators.pools import KEYS, rank_of
from finrecon.operators.setjoins import Overlap, meeting
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

NORMAL_POOL = "lower(replace(replace(raw_label, 'Less: ', ''), ' (net)', ''))"


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def _labels(spark, sf_dir):
    pool = fixture(spark, sf_dir, "fx_pool_label").withColumn("norm", lb.normal(F.col("raw_label")))
    template = fixture(spark, sf_dir, "fx_template").withColumn("norm", lb.normal(F.col("template_label")))
    return pool, template


@query("j01_exact_label", oracle(f"select template_label, raw_label from fx_template left join fx_pool_label on lower(template_label) = {NORMAL_POOL}", "fx_template", "fx_pool_label"))
def j01(spark, sf_dir):
    pool, template = _labels(spark, sf_dir)
    return template.join(pool, "norm", "left").select("template_label", "raw_label")


SYNONYMS = (("cold", "hot"), ("old", "new"), ("small", "large"))


@query(
    "j02_synonym_label",
    oracle(
        f"""with s(a, b) as (values ('cold', 'hot'), ('old', 'new'), ('small', 'large')), t as (select template_label, split_part(lower(template_label), ' ', 1) as f from fx_template),
        p as (select raw_label, split_part({NORMAL_POOL}, ' ', 1) as f from fx_pool_label)
        select template_label, raw_label, 0.95::double as score from t join (select a, b from s union select b, a from s) on f = a join p on p.f = b""",
        "fx_template",
        "fx_pool_label",
    ),
)
def j02(spark, sf_dir):
    pool, template = _labels(spark, sf_dir)
    one = spark.createDataFrame(list(SYNONYMS), "a string, b string")
    both = F.broadcast(one.union(one.select("b", "a")))  # a synonym dictionary is written by hand
    t = template.withColumn("a", F.split_part("norm", F.lit(" "), F.lit(1)))
    p = pool.withColumn("b", F.split_part("norm", F.lit(" "), F.lit(1)))
    return t.join(both, "a").join(p.select("b", "raw_label"), "b").select("template_label", "raw_label", F.lit(0.95).alias("score"))


def candidates(left: DataFrame, right: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Pairs that share a token, each once: an equi-join on exploded tokens stands for the pairwise loop."""
    a = left.withColumn("token", F.explode(tokens))
    b = right.withColumn("token", F.explode(f"{tokens}_r"))
    return a.join(b, "token").drop("token").distinct()


TOKENS_SQL = f"""t as (select template_label, string_split(lower(template_label), ' ') as x from fx_template), p as (select raw_label, string_split({NORMAL_POOL}, ' ') as y from fx_pool_label),
 c as (select template_label, raw_label, x, y, len(list_intersect(x, y)) as i from t cross join p where len(list_intersect(x, y)) > 0),
 s as (select *, i / len(list_distinct(list_concat(x, y))) as jac, i / least(len(x), len(y)) as con from c)"""


def _scores(pairs: DataFrame) -> DataFrame:
    x, y = F.col("tokens"), F.col("tokens_r")
    return pairs.withColumns({"jaccard": lb.jaccard(x, y), "overlap": lb.overlap_score(x, y)})


def _scored(spark, sf_dir):
    pool, template = _labels(spark, sf_dir)
    a = template.select("template_label", lb.tokens(F.col("template_label")).alias("tokens"))
    b = pool.select("raw_label", lb.tokens(F.col("raw_label")).alias("tokens_r"))
    return _scores(candidates(a, b))


def shared_tokens(least: float) -> Overlap:
    """Pairs that share at least that part of the tokens of either label, as those of a jaccard or a share of the longer label of at least least do."""
    need = lambda ts, label: F.size(ts) * least
    return Overlap(lb.tokens, need, need)


def contained_tokens(least: float) -> list[Overlap]:
    """Pairs that share at least that part of the tokens of the shorter label."""
    need = lambda ts, label: F.size(ts) * least
    return [Overlap(lb.tokens, need, None), Overlap(lb.tokens, None, need)]


def _meeting_labels(spark, sf_dir, measures: list[Overlap]) -> DataFrame:
    """Scores of the template and pool labels that may reach one of the measures."""
    pool, template = _labels(spark, sf_dir)
    met = meeting(template.select(F.col("template_label").alias("label")), pool.select(F.col("raw_label").alias("label")), measures).toDF("template_label", "raw_label")
    return _scores(met.select("template_label", "raw_label", lb.tokens(F.col("template_label")).alias("tokens"), lb.tokens(F.col("raw_label")).alias("tokens_r")))


def resolved(labels: DataFrame, aliases: DataFrame, least: float = 0.75) -> DataFrame:
    """(label, concept, tier) for distinct labels: alias, then a variant of one, then the share of common tokens in the longer; the first alias among equals.

    Only distinct labels are resolved, so the work follows the vocabulary and not the rows."""
    own = labels.select("label").distinct().withColumn("norm", lb.normal(F.col("label")))
    known = aliases.select(lb.normal(F.col("alias")).alias("norm"), "concept", "ord")
    exact = top(own.join(known, "norm"), ["label"], [F.col("ord")]).select("label", "concept", F.lit(1).alias("tier"))
    left = own.join(exact, "label", "left_anti")
    varied = left.select("label", F.explode(lb.variants(F.col("norm"))).alias("norm")).join(known, "norm")
    second = top(varied, ["label"], [F.col("ord")]).select("label", "concept", F.lit(2).alias("tier"))
    last = left.join(second, "label", "left_anti").select("label", "norm")
    met = meeting(last.select(F.col("norm").alias("label")).distinct(), known.select(F.col("norm").alias("label")).distinct(), [shared_tokens(least)])
    met = met.join(last.select("label", F.col("norm").alias("a")), "a").join(known.select("concept", "ord", F.col("norm").alias("b")), "b")
    met = met.select("label", "concept", "ord", lb.tokens(F.col("a")).alias("tokens"), lb.tokens(F.col("b")).alias("tokens_r"))
    share = F.size(F.array_intersect("tokens", "tokens_r")) / F.greatest(F.size("tokens"), F.size("tokens_r"))
    third = top(met.withColumn("share", share).where(F.col("share") >= least), ["label"], [F.desc("share"), F.col("ord")]).select("label", "concept", F.lit(3).alias("tier"))
    return exact.union(second).union(third)


@query(
    "j04_concept_resolution",
    oracle(
        f"""with a as (select lower(template_label) as n, row_number() over (order by template_label) as ord, 'c' || cast(row_number() over (order by template_label) as varchar) as concept from fx_template),
        l as (select raw_label as label, {NORMAL_POOL} as n from fx_pool_label union select replace(raw_label, ' (net)', ' extra (net)'), {NORMAL_POOL} || ' extra' from fx_pool_label),
        e as (select label, concept, 1 as tier from l join a using (n)),
        w as (select label, n, string_split(n, ' ') as x from l where label not in (select label from e)),
        b as (select label, concept, ord, len(list_intersect(x, string_split(a.n, ' '))) / greatest(len(x), len(string_split(a.n, ' '))) as share from w cross join a),
        f as (select label, concept, 3 as tier from (select *, row_number() over (partition by label order by share desc, ord) as k from b where share >= 0.6) where k = 1)
        select * from e union all select * from f""",
        "fx_template",
        "fx_pool_label",
    ),
)
def j04(spark, sf_dir):
    pool, template = _labels(spark, sf_dir)
    order = Window.orderBy("template_label")  # the knowledge base is a table of a few thousand aliases
    aliases = template.select(F.col("template_label").alias("alias"), F.row_number().over(order).alias("ord")).withColumn("concept", F.concat(F.lit("c"), F.col("ord")))
    labels = pool.select(F.col("raw_label").alias("label")).union(pool.select(F.regexp_replace("raw_label", r" \(net\)$", " extra (net)")))
    return resolved(labels, aliases, 0.6)


@query("j05_largest_of_concept", oracle("with r as (select company_id, concept, fy, value, row_number() over (partition by company_id, concept, fy order by abs(value) desc, value, source, statement_type, fq) as k, count(*) over (partition by company_id, concept, fy) as n, median(abs(value)) over (partition by company_id, concept, fy) as m from fx_concepts), d as (select *, n >= 3 and max(case when k = 1 then abs(value) end) over (partition by company_id, concept, fy) > 5 * m as drop_first from r) select company_id, concept, fy, value, n from d where k = case when drop_first then 2 else 1 end", "fx_concepts"))
def j05(spark, sf_dir):
    key = Window.partitionBy("company_id", "concept", "fy")
    order = key.orderBy(F.desc(F.abs("value")), "value", "source", "statement_type", "fq")
    rows = fixture(spark, sf_dir, "fx_concepts").withColumns({"k": F.row_number().over(order), "n": F.count("*").over(key), "m": F.median(F.abs("value")).over(key), "most": F.max(F.abs("value")).over(key)})
    pick = F.when((F.col("n") >= 3) & (F.col("most") > 5 * F.col("m")), 2).otherwise(1)
    return rows.where(F.col("k") == pick).select("company_id", "concept", "fy", "value", "n")


@query("j06_token_overlap", oracle(f"with {TOKENS_SQL}, o as (select *, greatest(jac, case when len(x) >= 3 and len(y) >= 3 then 0.7 * con else 0 end) as score from s) select template_label, raw_label, round(score, 6) as score from o where score >= 0.3", "fx_template", "fx_pool_label"))
def j06(spark, sf_dir):
    return _meeting_labels(spark, sf_dir, [shared_tokens(0.3), *contained_tokens(0.3 / 0.7)]).where("overlap >= 0.3").select("template_label", "raw_label", F.round("overlap", 6).alias("score"))


@query("j07_ranked_candidates", oracle(f"with {TOKENS_SQL} select template_label, raw_label, cast(rank() over (partition by template_label order by jac desc) as integer) as place from s where jac >= 0.2", "fx_template", "fx_pool_label"))
def j07(spark, sf_dir):
    place = F.rank().over(Window.partitionBy("template_label").orderBy(F.desc("jaccard")))
    return _meeting_labels(spark, sf_dir, [shared_tokens(0.2)]).where("jaccard >= 0.2").select("template_label", "raw_label", place.alias("place"))


@query("j08_mutual_best", oracle(f"with {TOKENS_SQL}, r as (select *, row_number() over (partition by template_label order by jac desc, raw_label) as k, row_number() over (partition by raw_label order by jac desc, template_label) as q from s) select template_label, raw_label, round(jac, 6) as score from r where k = 1 and q = 1", "fx_template", "fx_pool_label"))
def j08(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("template_label").orderBy(F.desc("jaccard"), "raw_label"))
    q = F.row_number().over(Window.partitionBy("raw_label").orderBy(F.desc("jaccard"), "template_label"))
    return _scored(spark, sf_dir).withColumns({"k": k, "q": q}).where("k = 1 and q = 1").select("template_label", "raw_label", F.round("jaccard", 6).alias("score"))


@query(
    "j11_cross_check",
    oracle(
        """with d as (select company_id, raw_label, fy, fq, value from fx_obs where source = 'xbrl' and statement_type = 'consolidated'),
        w as (select company_id, raw_label, fy, fq, value, source, row_number() over (partition by company_id, raw_label, fy, fq order by case source when 'screener' then 0 else 1 end) as k from fx_obs where source <> 'xbrl' and statement_type = 'consolidated')
        select company_id, raw_label, fy, fq, d.value as extracted, w.value as outside, source, case when r <= 0.02 then 'HIGH' when r <= 0.1 then 'MEDIUM' when r <= 0.25 then 'LOW' else 'FLAG' end as tier
        from d join w using (company_id, raw_label, fy, fq) cross join lateral (select case when w.value = 0 then abs(d.value) else abs(d.value - w.value) / abs(w.value) end as r) where k = 1""",
        "fx_obs",
    ),
)
def j11(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs").where("statement_type = 'consolidated'")
    ours = obs.where("source = 'xbrl'").select(*KEYS, F.col("value").alias("extracted"))
    theirs = obs.where("source <> 'xbrl'").groupBy(*KEYS).agg(F.max_by(F.struct("value", "source"), rank_of(F.col("source"))).alias("w"))
    met = ours.join(theirs, KEYS).select(*KEYS, "extracted", F.col("w.value").alias("outside"), "w.source")
    return met.withColumn("tier", nb.agreement(F.col("extracted"), F.col("outside")))


@query("j12_gap_fill", oracle("with c as (select distinct company_id, raw_label, fy from fx_obs where source = 'xbrl'), f as (select company_id, raw_label, fy, arg_max(value, fq * 10 + (statement_type = 'standalone')::int) as value from fx_obs where source = 'screener' and raw_label in (select lower(p_type) from part where p_type in ('STANDARD', 'PROMO', 'SMALL')) group by 1, 2, 3) select f.* from f anti join c using (company_id, raw_label, fy)", "fx_obs"))
def j12(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    in_template = fixture(spark, sf_dir, "part").where("p_type in ('STANDARD', 'PROMO', 'SMALL')").select(F.lower("p_type").alias("raw_label")).distinct()
    last = F.struct("fq", F.col("statement_type") == "standalone")
    offered = obs.where("source = 'screener'").join(in_template, "raw_label", "left_semi").groupBy("company_id", "raw_label", "fy").agg(F.max_by("value", last).alias("value"))
    return offered.join(obs.where("source = 'xbrl'").select("company_id", "raw_label", "fy").distinct(), ["company_id", "raw_label", "fy"], "left_anti")


@query("j13_stamp_tier", oracle("with c as (select company_id, raw_label, fy, min(case when value > 100000 then 1 when value > 50000 then 2 else 3 end) as t from fx_obs where source = 'screener' group by 1, 2, 3) select o.company_id, o.raw_label, o.fy, o.fq, o.statement_type, case t when 1 then 'HIGH' when 3 then 'LOW' else 'MEDIUM' end as tier from fx_obs o left join c using (company_id, raw_label, fy) where source = 'xbrl'", "fx_obs"))
def j13(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    tier = F.when(F.col("value") > 100000, 1).when(F.col("value") > 50000, 2).otherwise(3)
    checks = obs.where("source = 'screener'").groupBy("company_id", "raw_label", "fy").agg(F.min(tier).alias("t"))
    name = F.when(F.col("t") == 1, "HIGH").when(F.col("t") == 3, "LOW").otherwise("MEDIUM")
    return obs.where("source = 'xbrl'").join(checks, ["company_id", "raw_label", "fy"], "left").select(*KEYS, "statement_type", name.alias("tier"))


def as_of(rows: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Adds the value of the closest earlier year of the key, by one window over the key's years."""
    before = Window.partitionBy(*keys).orderBy(year).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"prior_year": F.max(year).over(before), "prior_value": F.last(value, ignorenulls=True).over(before)})


@query("j14_prior_year", oracle("with h as (select company_id, raw_label, fy, max(value) as value from fx_obs where source = 'xbrl' group by 1, 2, 3) select a.company_id, a.raw_label, a.fy, a.value, max(b.fy) as prior_year, arg_max(b.value, b.fy) as prior_value from h a left join h b on a.company_id = b.company_id and a.raw_label = b.raw_label and b.fy < a.fy group by 1, 2, 3, 4", "fx_obs"))
def j14(spark, sf_dir):
    history = fixture(spark, sf_dir, "fx_obs").where("source = 'xbrl'").groupBy("company_id", "raw_label", "fy").agg(F.max("value").alias("value"))
    return as_of(history, ["company_id", "raw_label"], "fy", "value")


@query("j18_quarter_over_year", oracle("with a as (select company_id, raw_label, fy, max(v) as most from (select company_id, raw_label, fy, statement_type, cast(sum(cast(value as decimal(18,2))) as double) / 4 as v from fx_obs where source = 'xbrl' group by 1, 2, 3, 4) group by 1, 2, 3) select o.company_id, o.raw_label, o.fy, o.fq, o.statement_type, case when abs(value) > 1.5 * most then null else value end as value from fx_obs o join a using (company_id, raw_label, fy) where source = 'xbrl'", "fx_obs"))
def j18(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs").where("source = 'xbrl'")
    year = obs.groupBy("company_id", "raw_label", "fy", "statement_type").agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / 4).alias("v"))
    most = year.groupBy("company_id", "raw_label", "fy").agg(F.max("v").alias("most"))
    return obs.join(most, ["company_id", "raw_label", "fy"]).select(*KEYS, "statement_type", F.when(F.abs("value") <= 1.5 * F.col("most"), F.col("value")).alias("value"))


@query("j19_equal_scopes", oracle("with c as (select * from fx_obs where statement_type = 'consolidated'), s as (select * from fx_obs where statement_type = 'standalone') select s.company_id, s.raw_label, s.source, s.fy, s.fq, case when c.value is not null and abs(round(c.value / 1000) - round(s.value / 1000)) < 0.01 then null else s.value end as value from s left join c using (company_id, raw_label, source, fy, fq)", "fx_obs"))
def j19(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    keys = ["company_id", "raw_label", "source", "fy", "fq"]
    s = obs.where("statement_type = 'standalone'").select(*keys, "value")
    c = obs.where("statement_type = 'consolidated'").select(*keys, F.col("value").alias("other"))
    same = F.col("other").isNotNull() & (F.abs(F.round(F.col("other") / 1000) - F.round(F.col("value") / 1000)) < 0.01)
    return s.join(c, keys, "left").select(*keys, F.when(~same, F.col("value")).alias("value"))


def contained(a: DataFrame, b: DataFrame, x: str, y: str, gap: int) -> DataFrame:
    """Pairs of which one text holds the other, lengths at most gap apart. The first three characters of the inner text occur in the outer one, so both meet in an equi-join on those."""

    def grams(c: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(3))))

    inner = a.withColumn("k", F.substring(x, 1, 3)).join(b.withColumn("k", F.explode(grams(y))), "k").where(F.expr(f"contains({y}, {x})"))
    outer = a.withColumn("k", F.explode(grams(x))).join(b.withColumn("k", F.substring(y, 1, 3)), "k").where(F.expr(f"contains({x}, {y})"))
    return inner.union(outer).drop("k").where(F.expr(f"abs(length({x}) - length({y})) <= {gap}")).distinct()


@query("j22_containment", oracle("with t as (select distinct split_part(lower(template_label), ' ', 1) as w from fx_template), d as (select distinct lower(raw_label) as l from fx_pool_label) select w as template_word, l as label from t join d on (contains(l, w) or contains(w, l)) and abs(length(l) - length(w)) <= 25", "fx_template", "fx_pool_label"))
def j22(spark, sf_dir):
    words = fixture(spark, sf_dir, "fx_template").select(F.split_part(F.lower("template_label"), F.lit(" "), F.lit(1)).alias("w")).distinct()
    lines = fixture(spark, sf_dir, "fx_pool_label").select(F.lower("raw_label").alias("l")).distinct()
    return contained(words, lines, "w", "l", 25).select(F.col("w").alias("template_word"), F.col("l").alias("label"))


@query("j23_fill_empty", oracle("with a as (select company_id, raw_label, fy, max(value) as v from fx_obs where source = 'screener' group by 1, 2, 3), b as (select company_id, raw_label, fy, max(value) as v from fx_obs where source = 'yfinance' group by 1, 2, 3) select company_id, raw_label, fy, coalesce(a.v, b.v) as value, case when a.v is not null then 'primary' else 'gap' end as origin from a full join b using (company_id, raw_label, fy)", "fx_obs"))
def j23(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs").where("source in ('screener', 'yfinance')")
    best = obs.groupBy("company_id", "raw_label", "fy").agg(F.max(F.when(F.col("source") == "screener", F.col("value"))).alias("a"), F.max(F.when(F.col("source") == "yfinance", F.col("value"))).alias("b"))
    return best.select("company_id", "raw_label", "fy", F.coalesce("a", "b").alias("value"), F.when(F.col("a").isNotNull(), "primary").otherwise("gap").alias("origin"))


@query("j24_submitted_label", oracle(f"select raw_label, template_label, case when lower(raw_label) = lower(template_label) then 1 else 2 end as tier from fx_pool_label join fx_template on lower(template_label) in (lower(raw_label), {NORMAL_POOL})", "fx_template", "fx_pool_label"))
def j24(spark, sf_dir):
    pool, template = _labels(spark, sf_dir)
    exact = pool.join(template.select(F.lower("template_label").alias("low"), "template_label"), F.lower("raw_label") == F.col("low")).select("raw_label", "template_label", F.lit(1).alias("tier"))
    rest = pool.join(exact, "raw_label", "left_anti").join(template, "norm").select("raw_label", "template_label", F.lit(2).alias("tier"))
    return exact.union(rest)


@query("j25_spec_expansion", "with rows as (select distinct o_orderkey as row, o_orderpriority as label from orders), periods(col, period) as (values (1, 'F2023'), (2, 'F2024'), (3, 'F2025')), formula as (select l_orderkey as row, l_linenumber as col from lineitem where l_returnflag = 'A'), filled as (select l_orderkey as row, l_linenumber as col from lineitem where l_returnflag = 'R') select row, label, col, period from rows cross join periods anti join formula using (row, col) anti join filled using (row, col)")
def j25(spark, sf_dir):
    rows = fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_orderpriority").alias("label")).distinct()
    periods = F.array(*(F.struct(F.lit(k).alias("col"), F.lit(f"F{2022 + k}").alias("period")) for k in (1, 2, 3)))
    grid = rows.select("row", "label", F.inline(periods))
    cells = fixture(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), "l_returnflag")
    return grid.join(cells.where("l_returnflag = 'A'"), ["row", "col"], "left_anti").join(cells.where("l_returnflag = 'R'"), ["row", "col"], "left_anti").select("row", "label", "col", "period")
