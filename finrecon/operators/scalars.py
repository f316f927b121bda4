"""Queries over the scalar functions: periods (P), numbers (N) and labels (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from finrecon.functions import labels as lb, numbers as nb, periods as pd
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

QUARTER_SQL = "case when m between 4 and 6 then 1 when m between 7 and 9 then 2 when m >= 10 then 3 else 4 end"
FY_SQL = "cast(case when m >= 4 then y + 1 else y end as integer)"


@query(
    "p1_period_text",
    oracle(
        """select id, raw_period, case id % 8 when 4 then concat(cast(id % 4 + 1 as varchar), 'QF', cast(y as varchar)) when 6 then concat('1QF', cast(y + 1 as varchar))
        when 7 then null else concat('F', cast(y as varchar)) end as period from fx_period_text""",
        "fx_period_text",
    ),
)
def p1(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_period_text").select("id", "raw_period", pd.period(F.col("raw_period"), 1990, 2050).alias("period"))


@query(
    "p2_quarter_text",
    oracle(
        """select id, case id % 8 when 4 then concat(cast(id % 4 + 1 as varchar), 'QF', cast(y as varchar)) when 5 then concat('4QF', cast(y as varchar))
        when 6 then concat('1QF', cast(y + 1 as varchar)) end as quarter from fx_period_text""",
        "fx_period_text",
    ),
)
def p2(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_period_text").select("id", pd.quarter(F.col("raw_period")).alias("quarter"))


@query(
    "p3_grid_period",
    oracle("select id, case id % 8 when 4 then concat(cast(id % 4 + 1 as varchar), 'QF', cast(y as varchar)) when 6 then concat('1QF', cast(y + 1 as varchar)) when 7 then null else concat('F', cast(y as varchar)) end as period from fx_period_text", "fx_period_text"),
)
def p3(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_period_text")
    padded = F.concat(F.lit(" "), F.upper("raw_period"), F.lit(" "))
    return rows.select("id", pd.period(padded, 1990, 2050).alias("period"))


@query(
    "p4_heading_period",
    """select o_orderkey as id, case when o_orderkey % 3 = 0 then concat('F', cast(y + (case when m >= 4 then 1 else 0 end) as varchar))
    else concat(cast(q as varchar), 'QF', cast(y + (case when m >= 4 then 1 else 0 end) as varchar)) end as period
    from (select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m,
      case when month(o_orderdate) between 4 and 6 then 1 when month(o_orderdate) between 7 and 9 then 2 when month(o_orderdate) >= 10 then 3 else 4 end as q from orders)""",
)
def p4(spark, sf_dir):
    orders = fixture(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "Year ended ").otherwise("Three months ended ")
    return orders.select(F.col("o_orderkey").alias("id"), pd.heading(F.concat(kind, F.date_format("o_orderdate", "MMMM d, yyyy"))).alias("period"))


@query(
    "p5_periods_in_text",
    oracle(
        """select id, array_to_string(list_sort(list_distinct([y, y + 1])), ',') as years from fx_period_text where y between 1990 and 2049""",
        "fx_period_text",
    ),
)
def p5(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_period_text").where("y between 1990 and 2049")
    text = F.concat_ws(" ", F.lit("for FY"), F.concat(F.lit("F"), F.col("y")), F.lit("and"), (F.col("y") + 1).cast("string"), F.lit("against"), F.col("y").cast("string"))
    return rows.select("id", F.array_join(F.transform(pd.all_periods(text, 1990, 2050), lambda y: y.cast("string")), ",").alias("years"))


@query(
    "p6_fiscal_year",
    f"""select o_orderkey as id, {FY_SQL} as fy, cast({QUARTER_SQL} as integer) as fq, cast(y as integer) as calendar_fy,
    cast(case when m <= 6 then y else y + 1 end as integer) as june_fy
    from (select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m from orders)""",
)
def p6(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return fixture(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), pd.fiscal_year(day).alias("fy"), pd.fiscal_quarter(day).alias("fq"), F.year(day).alias("calendar_fy"), pd.fiscal_year(day, 7).alias("june_fy")
    )


@query(
    "p7_year_from_name",
    "select o_orderkey as id, cast(case when o_orderkey % 3 = 0 then 2011 + o_orderkey % 9 + 1 else 2011 + o_orderkey % 9 end as integer) as fy from orders",
)
def p7(spark, sf_dir):
    y = F.lit(2011) + F.col("o_orderkey") % 9
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("annual_report_"), y, F.lit("-"), F.substring((y + 1).cast("string"), 3, 2), F.lit(".pdf"))).otherwise(
        F.concat(F.lit("https://x.example/reports/"), y, F.lit("/report.pdf"))
    )
    return fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pd.year_from_name(name).alias("fy"))


@query(
    "p8_quarter_from_text",
    f"""select o_orderkey as id, cast(case when o_orderkey % 2 = 0 then o_orderkey % 4 + 1 else {QUARTER_SQL} end as integer) as fq
    from (select o_orderkey, month(o_orderdate) as m from orders)""",
)
def p8(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("results_Q"), F.col("o_orderkey") % 4 + 1, F.lit("_final.pdf"))).otherwise(F.concat(F.lit("Results for "), F.date_format("o_orderdate", "MMMM yyyy")))
    return fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pd.quarter_of_text(text).alias("fq"))


@query(
    "p9_both_readings",
    f"""select o_orderkey as id, unnest([concat(cast({QUARTER_SQL} as varchar), 'QF', cast({FY_SQL} as varchar)), concat('F', cast({FY_SQL} as varchar))]) as period
    from (select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m from orders)""",
)
def p9(spark, sf_dir):
    text = F.concat(F.lit("Statement for the period ended "), F.date_format("o_orderdate", "MMMM d, yyyy"))
    both = F.array(pd.heading(F.concat(F.lit("quarter ended "), text)), pd.heading(F.concat(F.lit("year ended "), text)))
    return fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(both).alias("period"))


@query(
    "p10_site_heading",
    oracle("select id, case when id % 8 = 7 then null when id % 8 in (4, 6) then y else case when id % 8 = 2 then y - 1 else y end end as year from fx_period_text", "fx_period_text"),
)
def p10(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_period_text").select("id", pd.site_year(F.col("raw_period")).alias("year"))


@query(
    "n1_number_text",
    oracle(
        """select id, raw, case id % 6 when 0 then -cast(cast(v as decimal(18,2)) as double) when 2 then cast(cast(v as decimal(18,2)) as double) * 0.1 when 3 then null
        else cast(cast(v as decimal(18,2)) as double) end as value from fx_number_text""",
        "fx_number_text",
    ),
)
def n1(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_number_text").select("id", "raw", nb.number(F.col("raw")).alias("value"))


@query("n2_site_number", "select o_orderkey as id, cast(cast(o_totalprice as decimal(18,2)) as double) as value from orders")
def n2(spark, sf_dir):
    raw = F.concat(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), F.lit(" %"))
    return fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), nb.site_number(raw).alias("value"))


@query(
    "n4_to_crore",
    """select o_orderkey as id, round(o_totalprice * case o_orderkey % 4 when 0 then 0.01::double when 1 then 0.1::double when 2 then 0.0001::double else 1.0::double end, 4) as value from orders""",
)
def n4(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("Lakhs", "million", "thousand", "Crore"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), nb.to_crore(F.col("o_totalprice"), unit).alias("value"))


@query(
    "n5_scale_guess",
    """select o_orderkey as id, round(case when abs(v) > 1e10 then v / 1e7 when o_orderkey % 5 = 0 and abs(v) > 1 then v / 100 else v end, 6) as value
    from (select o_orderkey, case when o_orderkey % 2 = 0 then o_totalprice * 1e6 else o_totalprice / 10 end as v from orders)""",
)
def n5(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") * 1e6).otherwise(F.col("o_totalprice") / 10)
    return fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), nb.scale_guess(v, F.col("o_orderkey") % 5 == 0).alias("value"))


@query(
    "n6_agreement",
    oracle(
        """select a.company_id, a.raw_label, a.fy, a.fq, a.statement_type, case when d <= 0.02 then 'HIGH' when d <= 0.10 then 'MEDIUM' when d <= 0.25 then 'LOW' else 'FLAG' end as tier,
        (greatest(abs(a.v), abs(a.w)) < 1e-6 or abs(a.v - a.w) <= 0.02 * greatest(abs(a.v), abs(a.w))) as close
        from (select x.company_id, x.raw_label, x.fy, x.fq, x.statement_type, x.value as v, y.value as w, case when y.value = 0 then abs(x.value) else abs(x.value - y.value) / abs(y.value) end as d
          from fx_obs x join fx_obs y on x.company_id = y.company_id and x.raw_label = y.raw_label and x.fy = y.fy and x.fq = y.fq and x.statement_type = y.statement_type
          where x.source = 'xbrl' and y.source = 'yfinance') a""",
        "fx_obs",
    ),
)
def n6(spark, sf_dir):
    obs = fixture(spark, sf_dir, "fx_obs")
    keys = ["company_id", "raw_label", "fy", "fq", "statement_type"]
    left, right = obs.where("source = 'xbrl'").select(*keys, F.col("value").alias("v")), obs.where("source = 'yfinance'").select(*keys, F.col("value").alias("w"))
    return left.join(right, keys).select(*keys, nb.agreement(F.col("v"), F.col("w")).alias("tier"), nb.close(F.col("v"), F.col("w"), 0.02).alias("close"))


@query(
    "n7_glued_cells",
    """select o_orderkey as id, concat(cast(2000 + o_orderkey % 20 as varchar), '-', right(cast(2001 + o_orderkey % 20 as varchar), 2)) as first_year,
    case when o_orderkey % 2 = 0 then 2 else 1 end as numbers from orders""",
)
def n7(spark, sf_dir):
    y = F.lit(2000) + F.col("o_orderkey") % 20
    span = F.concat(y, F.lit("-"), F.substring((y + 1).cast("string"), 3, 2))
    number = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    cell = F.when(F.col("o_orderkey") % 2 == 0, F.concat(number, number)).otherwise(number)
    return fixture(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), nb.glued_years(F.concat(span, span))[0].alias("first_year"), F.size(nb.glued_numbers(cell)).alias("numbers")
    )


@query("l1_clean_label", "select p_partkey as id, p_name as label from part")
def l1(spark, sf_dir):
    bullet = F.element_at(F.array(*map(F.lit, ("• ", "(ii) ", "1. ", "- "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return fixture(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), lb.clean(F.concat(F.lit("  "), bullet, F.regexp_replace("p_name", " ", "   "), F.lit(" "))).alias("label"))


@query("l2_normal_label", oracle("select raw_label, lower(replace(replace(raw_label, 'Less: ', ''), ' (net)', '')) as label from fx_pool_label", "fx_pool_label"))
def l2(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_pool_label").select("raw_label", lb.normal(F.col("raw_label")).alias("label"))


@query(
    "l5_field_rules",
    """with rules(section, ord, pattern, field) as (values ('STANDARD', 1, 'e.*e', 's1'), ('STANDARD', 2, 'a', 's2'), ('PROMO', 1, 'o', 'p1'), ('PROMO', 2, 'a', 'p2'), ('ECONOMY', 1, 'r', 'e1'))
    select p_partkey as id, arg_min(field, ord) as field from part join rules on p_type = section and regexp_matches(p_name, pattern) group by p_partkey""",
)
def l5(spark, sf_dir):
    rules = spark.createDataFrame([("STANDARD", 1, "e.*e", "s1"), ("STANDARD", 2, "a", "s2"), ("PROMO", 1, "o", "p1"), ("PROMO", 2, "a", "p2"), ("ECONOMY", 1, "r", "e1")], "section string, ord int, pattern string, field string")
    # A rule table is written by hand and stays small.
    met = fixture(spark, sf_dir, "part").join(F.broadcast(rules), F.expr("p_type = section and p_name rlike pattern"))
    return met.groupBy(F.col("p_partkey").alias("id")).agg(F.min_by("field", "ord").alias("field"))


@query(
    "l6_label_variants",
    """select distinct n as label, unnest(list_distinct([n, regexp_replace(n, 's$', ''), concat(n, 's'), regexp_replace(n, ' (expenses?|costs?)$', ''), regexp_replace(n, 'ies$', 'y')])) as variant
    from (select lower(p_name) as n from part)""",
)
def l6(spark, sf_dir):
    names = fixture(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(lb.normal(F.col("p_name")).alias("label"), F.explode(lb.variants(F.col("p_name"))).alias("variant")).distinct()


PAIR_SQL = """with t as (select distinct lower(p_name) as n from part), k as (select n, list_distinct(list_filter(string_split(n, ' '), lambda x: length(x) > 1)) as ts from t),
 p as (select a.n as a, b.n as b, a.ts as x, b.ts as y, len(list_intersect(a.ts, b.ts)) as i from k a join k b on a.n < b.n and split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1))"""


def _pairs(spark, sf_dir):
    names = fixture(spark, sf_dir, "part").select(F.lower("p_name").alias("n")).distinct().withColumn("first", F.split_part("n", F.lit(" "), F.lit(1)))
    return names.select("first", F.col("n").alias("a")).join(names.select("first", F.col("n").alias("b")), "first").where("a < b")


@query("l7_token_overlap", PAIR_SQL + " select a, b, round(i / len(list_distinct(list_concat(x, y))), 6) as jaccard, round(i / least(len(x), len(y)), 6) as containment from p")
def l7(spark, sf_dir):
    x, y = lb.tokens(F.col("a")), lb.tokens(F.col("b"))
    return _pairs(spark, sf_dir).select("a", "b", F.round(lb.jaccard(x, y), 6).alias("jaccard"), F.round(lb.containment(x, y), 6).alias("containment"))


@query(
    "l8_trigram_cosine",
    PAIR_SQL
    + """, g as (select n, list_distinct(list_transform(range(1, length(n) + 1), lambda i: substr(' ' || n || ' ', i, 3))) as s from t)
    select p.a, p.b, round(len(list_intersect(u.s, v.s)) / sqrt(len(u.s) * len(v.s)), 6) as cosine, levenshtein(p.a, p.b) as distance from p join g u on u.n = p.a join g v on v.n = p.b""",
)
def l8(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round(lb.trigram_cosine(F.col("a"), F.col("b")), 6).alias("cosine"), F.levenshtein("a", "b").cast("long").alias("distance"))


@query(
    "l14_statement_plan",
    oracle(
        """select company_id, case when c and s then 'consolidated,standalone' when c then 'consolidated' else 'standalone' end as fetch, case when c then 'consolidated' else 'standalone' end as first_choice
        from (select company_id, bool_or(statement_type = 'consolidated') as c, bool_or(statement_type = 'standalone') as s from fx_obs group by 1)""",
        "fx_obs",
    ),
)
def l14(spark, sf_dir):
    has = fixture(spark, sf_dir, "fx_obs").groupBy("company_id").agg(F.bool_or(F.col("statement_type") == "consolidated").alias("c"), F.bool_or(F.col("statement_type") == "standalone").alias("s"))
    scopes = F.array_compact(F.array(F.when(F.col("c"), "consolidated"), F.when(F.col("s"), "standalone")))
    return has.select("company_id", F.array_join(scopes, ",").alias("fetch"), scopes[0].alias("first_choice"))


@query(
    "l15_boilerplate_strip",
    r"""select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 3 and not regexp_matches(x, '^\s*([-_=*]{3,}|(page\s+)?\d+(\s+of\s+\d+)?)\s*$')), chr(10)) as text from documents""",
)
def l15(spark, sf_dir):
    keep = F.filter(F.split("text", "\n"), lambda x: (F.length(F.trim(x)) >= 3) & ~x.rlike(r"^\s*([-_=*]{3,}|(page\s+)?\d+(\s+of\s+\d+)?)\s*$"))
    return fixture(spark, sf_dir, "documents").select("doc_id", F.array_join(keep, "\n").alias("text"))


@query(
    "l16_word_chunks",
    r"""with w as (select doc_id, string_split_regex(trim(text, E' \n\t\r'), '\s+') as ws from documents)
    select doc_id, cast(k / 192 as integer) as chunk, array_to_string(ws[k + 1 : k + 230], ' ') as text from (select doc_id, ws, unnest(range(0, greatest(len(ws) - 38, 1), 192)) as k from w)""",
)
def l16(spark, sf_dir):
    words = fixture(spark, sf_dir, "documents").select("doc_id", F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+").alias("ws"))
    last = F.greatest(F.size("ws") - 39, F.lit(0))
    starts = words.withColumn("k", F.explode(F.sequence(F.lit(0), last, F.lit(192))))
    return starts.select("doc_id", (F.col("k") / 192).cast("int").alias("chunk"), F.array_join(F.slice("ws", F.col("k") + 1, F.lit(230)), " ").alias("text"))


@query(
    "l18_row_text",
    "select l_orderkey as id, '| ' || string_agg(cast(l_linenumber as varchar) || ' | ' || cast(l_partkey as varchar), ' | ' order by l_linenumber, l_partkey, l_suppkey) || ' |' as row_text from lineitem group by 1",
)
def l18(spark, sf_dir):
    cells = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda c: F.concat_ws(" | ", c["l_linenumber"].cast("string"), c["l_partkey"].cast("string")))
    return fixture(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("row_text"))


def line_chunks(text, most: int, overlap: int):
    """Lines joined into chunks of at most most characters; a chunk starts with the last overlap lines of the one before. A longer line is a chunk of its own."""
    lines = F.split(text, "\n")
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x) + 1)
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"))

    def add(s, line):
        full = (F.size(s["now"]) > 0) & (size(s["now"]) + F.length(line) > most)
        carried = F.slice(s["now"], F.greatest(F.size(s["now"]) - overlap + 1, F.lit(1)), F.lit(overlap))
        carried = F.when(size(carried) + F.length(line) > most, F.array().cast("array<string>")).otherwise(carried)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.concat(F.when(full, carried).otherwise(s["now"]), F.array(line)).alias("now"),
        )

    folded = F.aggregate(lines, start, add)
    return F.transform(F.concat(folded["done"], F.array(folded["now"])), lambda c: F.array_join(c, "\n"))


@query("l16_line_chunks")
def l16_lines(spark, sf_dir):
    return fixture(spark, sf_dir, "documents").select("doc_id", F.posexplode(line_chunks(F.col("text"), 2000, 2)).alias("chunk", "text"))
