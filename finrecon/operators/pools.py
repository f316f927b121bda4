"""Pools and aggregates (A): one value per company, label and period from many sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

#: How far each source is trusted.
SOURCE_RANK = {"xbrl": 100, "screener": 60, "yfinance": 40}
RANK_SQL = "case source when 'xbrl' then 100 when 'screener' then 60 else 40 end"
KEYS = ["company_id", "raw_label", "fy", "fq"]


def rank_of(source: Column, ranks: Mapping[str, int] = SOURCE_RANK) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), source), F.lit(0))


def pool(obs: DataFrame, keys: list[str], arrival: Column) -> DataFrame:
    """The value of the best source for each key, the first arrival among equals; blank labels and missing values are left out.

    max_by aggregates partially before the shuffle, so a key may have any number of rows."""
    usable = obs.where("value is not null and not isnan(value) and trim(raw_label) <> ''")
    best = F.struct(rank_of(F.col("source")), -arrival)
    return usable.groupBy(*keys).agg(F.max_by(F.struct("value", "source"), best).alias("best")).select(*keys, "best.value", "best.source")


def _ordered(obs: DataFrame) -> tuple[DataFrame, Column]:
    """The fixture has no arrival order; consolidated comes first."""
    return obs, F.when(F.col("statement_type") == "consolidated", 0).otherwise(1)


@query("a01_pool_build", oracle(f"select company_id, raw_label, fy, fq, arg_max(value, {RANK_SQL} * 10 + (statement_type = 'consolidated')::int) as value, arg_max(source, {RANK_SQL} * 10 + (statement_type = 'consolidated')::int) as source from fx_obs group by 1, 2, 3, 4", "fx_obs"))
def a01(spark, sf_dir):
    obs, arrival = _ordered(fixture(spark, sf_dir, "fx_obs"))
    return pool(obs, KEYS, arrival)


def consensus(obs: DataFrame, keys: list[str], slack: float = 0.05) -> DataFrame:
    """Clusters of values within slack of the running upper median, in order of rank and value; the best has most sources, then the best rank.

    A key has as many values as it has sources and scopes, so its array stays short; the fold runs inside one aggregate."""
    item = F.struct((-rank_of(F.col("source"))).alias("r"), F.col("value").alias("v"), F.col("source").alias("s"))
    rows = obs.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))

    def middle(c: Column) -> Column:
        values = F.array_sort(F.transform(c, lambda x: x["v"]))
        return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))

    def add(clusters: Column, x: Column) -> Column:
        near = F.transform(clusters, lambda c: F.abs(x["v"] - middle(c)) / F.greatest(F.abs(middle(c)), F.lit(1.0)) <= slack)
        at = F.array_position(near, True)
        joined = F.transform(clusters, lambda c, i: F.when(i + 1 == at, F.concat(c, F.array(x))).otherwise(c))
        return F.when(at > 0, joined).otherwise(F.concat(clusters, F.array(F.array(x))))

    empty = F.array().cast("array<array<struct<r:int,v:double,s:string>>>")
    found = rows.withColumn("clusters", F.aggregate("items", empty, add))
    sources = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["s"])))
    scored = F.transform("clusters", lambda c, i: F.struct(sources(c).alias("n"), (-F.array_min(F.transform(c, lambda x: x["r"]))).alias("rank"), (-i).alias("i"), middle(c).alias("v")))
    best = found.withColumn("best", F.array_max(scored))
    level = F.when(F.col("best.n") >= 2, "HIGH").when(F.size("clusters") > 1, "FLAGGED").otherwise("MEDIUM")
    return best.select(*keys, F.col("best.v").alias("value"), F.col("best.n").cast("long").alias("sources"), level.alias("confidence"))


A2_SQL = f"""with o as (select company_id, raw_label, fy, fq, value, source, {RANK_SQL} as r from fx_obs where statement_type = 'consolidated'),
 w as (select company_id, raw_label, fy, fq, max(case when r = 100 then value end) as a, max(case when r = 60 then value end) as b, max(case when r = 40 then value end) as c from o group by 1,2,3,4),
 l as (select *, list_filter([a, b, c], lambda x: x is not null) as vs from w),
 t as (select *, vs[1] as x, vs[2] as y, vs[3] as z, vs[2] is not null and abs(vs[2] - vs[1]) / greatest(abs(vs[1]), 1.0) <= 0.05 as xy from l),
 m as (select *, case when xy then greatest(x, y) else x end as m1 from t),
 n as (select *, z is not null and abs(z - m1) / greatest(abs(m1), 1.0) <= 0.05 as z1, z is not null and y is not null and not xy and abs(z - y) / greatest(abs(y), 1.0) <= 0.05 as z2 from m),
 f as (select *, 1 + xy::int + z1::int as n1, case when xy or y is null then 0 else 1 + (z2 and not z1)::int end as n2 from n)
select company_id, raw_label, fy, fq, case when n2 > n1 then greatest(y, z) when n1 = 3 then list_sort([x, y, z])[2] when xy then greatest(x, y) when z1 then greatest(x, z) else x end as value,
 cast(greatest(n1, n2) as bigint) as sources, case when greatest(n1, n2) >= 2 then 'HIGH' when y is not null then 'FLAGGED' else 'MEDIUM' end as confidence from f"""


@query("a02_consensus", oracle(A2_SQL, "fx_obs"))
def a02(spark, sf_dir):
    return consensus(fixture(spark, sf_dir, "fx_obs").where("statement_type = 'consolidated'"), KEYS)


@query("a03_first_value", oracle("select company_id, statement_type, raw_label, arg_min(value, fy * 100 + fq * 10 + case source when 'screener' then 0 when 'xbrl' then 1 else 2 end) as value from fx_obs group by 1, 2, 3", "fx_obs"))
def a03(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    return obs.groupBy("company_id", "statement_type", "raw_label").agg(F.min_by("value", F.struct("fy", "fq", "source")).alias("value"))


@query("a04_concept_dedup", oracle("select company_id, fy, fq, concept, upper(substr(concept, 1, 1)) || replace(substr(concept, 2), '_', ' ') as title, arg_max(value, abs(value)) as value from fx_concepts group by 1, 2, 3, 4", "fx_concepts"))
def a04(spark, sf_dir):
    best = fixture(spark, sf_dir, "fx_concepts").groupBy("company_id", "fy", "fq", "concept").agg(F.max_by("value", F.abs("value")).alias("value"))
    title = F.regexp_replace(F.concat(F.upper(F.substring("concept", 1, 1)), F.expr("substring(concept, 2)")), "_", " ")
    return best.select("company_id", "fy", "fq", "concept", title.alias("title"), "value")


STOCK = ("depreciation_amortization",)


def annual(quarters: DataFrame, keys: list[str], stock: tuple[str, ...] = STOCK) -> DataFrame:
    """Flows are summed over the quarters, stocks take the last one; complete tells whether all four were there. Sums are exact decimals."""
    rows = quarters.groupBy(*keys, "fy").agg(
        F.sum(F.col("value").cast("decimal(38,4)")).alias("total"), F.max_by("value", "fq").alias("last"), F.count_distinct("fq").alias("quarters")
    )
    value = F.when(F.col("concept").isin(*stock), F.col("last")).otherwise(F.round(F.col("total").cast("double"), 4))
    return rows.select(*keys, "fy", value.alias("value"), "quarters", (F.col("quarters") == 4).alias("complete"))


@query(
    "a05_quarters_to_year",
    oracle(
        """select company_id, source, statement_type, concept, fy, case when concept = 'depreciation_amortization' then arg_max(value, fq) else round(cast(sum(cast(value as decimal(38,4))) as double), 4) end as value,
        count(distinct fq) as quarters, count(distinct fq) = 4 as complete from fx_concepts group by 1, 2, 3, 4, 5""",
        "fx_concepts",
    ),
)
def a05(spark, sf_dir):
    return annual(fixture(spark, sf_dir, "fx_concepts"), ["company_id", "source", "statement_type", "concept"])


CONCEPT_KEYS = ["company_id", "source", "statement_type", "fy", "fq"]
CONCEPTS = ("revenue_from_operations", "cost_of_goods_sold", "employee_benefits_expense", "other_expenses", "depreciation_amortization", "finance_cost")
WIDE_SQL = "wide as (select company_id, source, statement_type, fy, fq, " + ", ".join(f"max(case when concept = '{c}' then value end) as {c}" for c in CONCEPTS) + " from fx_concepts group by 1, 2, 3, 4, 5)"


def wide(concepts: DataFrame, keys: list[str] = CONCEPT_KEYS, names: tuple[str, ...] = CONCEPTS) -> DataFrame:
    """One column per concept; the list of concepts is given, so no pass is spent on finding it."""
    return concepts.groupBy(*keys).pivot("concept", list(names)).agg(F.max("value"))


def summed(parts: list[Column], least: int) -> Column:
    """Exact sum of the parts that are there, null with fewer than least."""
    present = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts[1:]), F.when(parts[0].isNotNull(), 1).otherwise(0))
    zero = F.lit(0).cast("decimal(30,4)")
    total = sum((F.coalesce(p.cast("decimal(30,4)"), zero) for p in parts[1:]), F.coalesce(parts[0].cast("decimal(30,4)"), zero))
    return F.when(present >= least, total.cast("double"))


def dec(c: str) -> str:
    return f"coalesce(cast({c} as decimal(30,4)), 0)"


EXPENSES = CONCEPTS[1:]
A6_SUM = " + ".join(dec(c) for c in EXPENSES)
A6_COUNT = " + ".join(f"({c} is not null)::int" for c in EXPENSES)


@query("a06_conditional_sum", oracle(f"with {WIDE_SQL} select company_id, source, statement_type, fy, fq, case when {A6_COUNT} >= 3 then cast({A6_SUM} as double) end as total_expenses, case when {A6_COUNT} = 5 then cast({A6_SUM} as double) end as complete_expenses from wide", "fx_concepts"))
def a06(spark, sf_dir):
    w = wide(fixture(spark, sf_dir, "fx_concepts"))
    parts = [F.col(c) for c in EXPENSES]
    return w.select(*CONCEPT_KEYS, summed(parts, 3).alias("total_expenses"), summed(parts, 5).alias("complete_expenses"))


@query("a09_tallies", oracle("select company_id, source, statement_type, count(*) as n, count(*) filter (where value > 100000) as large from fx_obs group by rollup(company_id, source, statement_type)", "fx_obs"))
def a09(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    return obs.rollup("company_id", "source", "statement_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100000).alias("large"))


@query("a10_coverage", oracle("with e as (select c.company_id, l.raw_label from (select distinct company_id from fx_obs) c cross join (select distinct raw_label from fx_obs) l), h as (select distinct company_id, raw_label from fx_obs where source = 'xbrl' and fy = 1996) select e.company_id, avg(case when h.company_id is not null then 1.0 else 0.0 end) as coverage from e left join h using (company_id, raw_label) group by 1", "fx_obs"))
def a10(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    labels = obs.select("raw_label").distinct()
    have = obs.where("source = 'xbrl' and fy = 1996").groupBy("company_id").agg(F.count_distinct("raw_label").alias("have"))
    expected = labels.agg(F.count("*").alias("expected"))
    # One row with the number of labels meets every company.
    every = obs.select("company_id").distinct().join(F.broadcast(expected))
    return every.join(have, "company_id", "left").select("company_id", (F.coalesce("have", F.lit(0)) / F.col("expected")).alias("coverage"))


#: Words of the test corpus in the part of section keywords, with weights.
KEYWORDS = (("balance", "the", 2.0), ("balance", "and", 1.0), ("balance", "der", 2.0), ("profit", "que", 2.0), ("profit", "of", 1.5), ("profit", "und", 1.0))


def page_scores(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """Score of each page and section: weight x log(1 + count) / log 2 over the keywords, counts not overlapping.

    The keyword table is written by hand; it is turned into expressions, so every page is read once and nothing is multiplied out."""
    rows = keywords.collect()
    lower = F.lower("text")
    out = []
    for section in sorted({r["section"] for r in rows}):
        terms = [
            F.lit(r["weight"]) * F.log1p(((F.length(lower) - F.length(F.replace(lower, F.lit(r["keyword"]), F.lit("")))) / len(r["keyword"])).cast("double")) / F.log(F.lit(2.0))
            for r in rows
            if r["section"] == section
        ]
        out.append(F.struct(F.lit(section).alias("section"), F.round(sum(terms[1:], terms[0]), 4).alias("score")))
    return pages.select("filing", "page_no", F.inline(F.array(*out)))


A11_TERM = "sum(weight * ln(1 + (length(t) - length(replace(t, keyword, ''))) / length(keyword)) / ln(2.0))"


@query("a11_page_score", oracle(f"with k(section, keyword, weight) as (values {', '.join(str(k) for k in KEYWORDS)}) select filing, page_no, section, round({A11_TERM}, 4) as score from (select filing, page_no, lower(text) as t from fx_pages) cross join k group by 1, 2, 3", "fx_pages"))
def a11(spark, sf_dir):
    return page_scores(fixture(spark, sf_dir, "fx_pages"), spark.createDataFrame(list(KEYWORDS), "section string, keyword string, weight double"))


SECTORS = (("english", ("the", "and", "of", "is")), ("german", ("der", "und", "die", "das")), ("french", ("les", "des", "que", "une")), ("spanish", ("los", "las", "una", "por")))


def sector_of(text: Column, sectors=SECTORS, least: int = 3) -> Column:
    """The sector with most keywords in the text, at least least; the first among equals; else generic."""
    lower = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    hits = [F.struct(sum((lower.contains(f" {w} ").cast("int") for w in words[1:]), lower.contains(f" {words[0]} ").cast("int")).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("s")) for i, (name, words) in enumerate(sectors)]
    best = F.greatest(*hits)
    return F.when(best["n"] >= least, best["s"]).otherwise("generic")


A12_HITS = ", ".join("(" + " + ".join(f"contains(t, ' {w} ')::int" for w in ws) + f") as {s}" for s, ws in SECTORS)


@query("a12_document_sector", f"with h as (select doc_id, {A12_HITS} from (select doc_id, ' ' || lower(text) || ' ' as t from documents)) select doc_id, case when greatest(english, german, french, spanish) < 3 then 'generic' when english = greatest(english, german, french, spanish) then 'english' when german = greatest(german, french, spanish) then 'german' when french >= spanish then 'french' else 'spanish' end as sector from h")
def a12(spark, sf_dir):
    return fixture(spark, sf_dir, "documents").select("doc_id", sector_of(F.col("text")).alias("sector"))


@query("a13_section_buckets", oracle(f"select company_id, case when raw_label in ('standard', 'economy') then 'balance' else 'profit' end as section, raw_label, fy, arg_max(value, {RANK_SQL} * 1000 + fq * 10 + (statement_type = 'consolidated')::int) as value from fx_obs group by 1, 2, 3, 4", "fx_obs"))
def a13(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    section = F.when(F.col("raw_label").isin("standard", "economy"), "balance").otherwise("profit")
    order = F.struct(rank_of(F.col("source")), F.col("fq"), F.col("statement_type") == "consolidated")
    return obs.groupBy("company_id", section.alias("section"), "raw_label", "fy").agg(F.max_by("value", order).alias("value"))


@query("a14_ordered_merge", oracle("with o as (select company_id, raw_label, fy, fq, value, case source when 'screener' then 1 when 'xbrl' then 2 else 3 end as ord from fx_obs where statement_type = 'standalone') select company_id, raw_label, fy, fq, arg_min(value, ord) as value, min(ord) as came_from from o group by 1, 2, 3, 4", "fx_obs"))
def a14(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs").where("statement_type = 'standalone'")
    parts = [obs.where(F.col("source") == s).select(*KEYS, "value").withColumn("ord", F.lit(i)) for i, s in enumerate(("screener", "xbrl", "yfinance"), 1)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy(*KEYS).agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("came_from"))


@query("a15_repeated_value", "select l_orderkey as row_id, l_linenumber as col, case when count(*) over (partition by l_orderkey, l_quantity) >= 3 then null else l_quantity end as value from lineitem")
def a15(spark, sf_dir):
    same = Window.partitionBy("l_orderkey", "l_quantity")
    rows = fixture(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("col"), F.when(F.count("*").over(same) < 3, F.col("l_quantity")).alias("value"))


@query("a16_section_confidence", oracle(f"with k(section, keyword, weight) as (values {', '.join(str(k) for k in KEYWORDS)}), s as (select filing, page_no, section, round({A11_TERM}, 4) as score from (select filing, page_no, lower(text) as t from fx_pages) cross join k group by 1, 2, 3) select filing, section, least(1.0::double, round(cast(sum(cast(score as decimal(18,4))) as double) / 2000, 6)) as confidence from s group by 1, 2", "fx_pages"))
def a16(spark, sf_dir):
    scores = page_scores(fixture(spark, sf_dir, "fx_pages"), spark.createDataFrame(list(KEYWORDS), "section string, keyword string, weight double"))
    total = F.sum(F.col("score").cast("decimal(18,4)")).cast("double")
    return scores.groupBy("filing", "section").agg(F.least(F.lit(1.0), F.round(total / 2000, 6)).alias("confidence"))


@query("a17_provenance", oracle(f"select company_id, raw_label, fy, fq, string_agg(source || '/' || statement_type, ',' order by {RANK_SQL} desc, statement_type) as provenance, count(*) as n from fx_obs group by 1, 2, 3, 4", "fx_obs"))
def a17(spark, sf_dir):
    item = F.struct((-rank_of(F.col("source"))).alias("r"), "statement_type", "source")
    names = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat_ws("/", x["source"], x["statement_type"]))
    return fixture(spark, sf_dir, "fx_obs").groupBy(*KEYS).agg(F.array_join(names, ",").alias("provenance"), F.count("*").alias("n"))


@query("a18_rekeyed_quarters", oracle("select company_id, raw_label, statement_type, case when fq = 4 then concat('F', cast(fy as varchar)) else concat(cast(fq as varchar), 'QF', cast(fy as varchar)) end as period, value from fx_obs where source = 'xbrl'", "fx_obs"))
def a18(spark, sf_dir):
    period = F.when(F.col("fq") == 4, F.concat(F.lit("F"), F.col("fy"))).otherwise(F.concat(F.col("fq"), F.lit("QF"), F.col("fy")))
    rows = fixture(spark, sf_dir, "fx_obs").where("source = 'xbrl'").withColumn("period", period)
    return rows.groupBy("company_id", "raw_label", "statement_type", "period").agg(F.min_by("value", "fq").alias("value"))


@query("a19_row_class", oracle("select company_id, fy, case when bool_or(regexp_matches(raw_label, 'medium')) then 'operating' when bool_or(regexp_matches(raw_label, 'standard|economy')) then 'balance' else 'profit' end as class, count(*) as n from fx_obs group by 1, 2", "fx_obs"))
def a19(spark, sf_dir):
    votes = fixture(spark, sf_dir, "fx_obs").groupBy("company_id", "fy").agg(
        F.bool_or(F.col("raw_label").rlike("medium")).alias("o"), F.bool_or(F.col("raw_label").rlike("standard|economy")).alias("b"), F.count("*").alias("n")
    )
    return votes.select("company_id", "fy", F.when(F.col("o"), "operating").when(F.col("b"), "balance").otherwise("profit").alias("class"), "n")


@query("u1_union", oracle("select source, count(*) as n from (select * from fx_obs where source = 'xbrl' union all select * from fx_obs where source = 'screener') group by 1", "fx_obs"))
def u1(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    both = obs.where("source = 'xbrl'").unionByName(obs.where("source = 'screener'").drop("statement_type"), allowMissingColumns=True)
    return both.groupBy("source").agg(F.count("*").alias("n"))


@query("u2_distinct_by_url", "select url, min(page_id) as page_id from pages group by url")
def u2(spark, sf_dir):
    pages = fixture(spark, sf_dir, "pages").select("url", "page_id")
    again = pages.where("page_id % 2 = 0").withColumn("page_id", F.col("page_id") + 1_000_000)
    return pages.union(again).groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("u3_still_empty", oracle("select distinct company_id, raw_label, fy from fx_obs anti join (select company_id, raw_label, fy from fx_obs where source = 'xbrl') f using (company_id, raw_label, fy)", "fx_obs"))
def u3(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    cell = ["company_id", "raw_label", "fy"]
    return obs.select(*cell).distinct().join(obs.where("source = 'xbrl'").select(*cell), cell, "left_anti")


@query("u4_ask_years", oracle("with d as (select company_id, list_sort(list(distinct fy)) as have from fx_obs where source = 'xbrl' group by 1) select company_id, array_to_string(case when len(list_intersect(have, [1996, 1997, 2050])) > 0 then list_sort(list_intersect(have, [1996, 1997, 2050])) else have end, ',') as years from d", "fx_obs"))
def u4(spark, sf_dir):
    have = fixture(spark, sf_dir, "fx_obs").where("source = 'xbrl'").groupBy("company_id").agg(F.array_sort(F.collect_set("fy")).alias("have"))
    both = F.array_intersect("have", F.array(F.lit(1996), F.lit(1997), F.lit(2050)))
    return have.select("company_id", F.array_join(F.transform(F.when(F.size(both) > 0, F.array_sort(both)).otherwise(F.col("have")), lambda y: y.cast("string")), ",").alias("years"))
