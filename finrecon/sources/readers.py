"""Sources: records, grids, facts, tables in text and links to long observations."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from finrecon.functions import numbers as nb, periods as pr
from finrecon.functions.once import once
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

#: The observation record.
OBS = T.StructType(
    [
        T.StructField("company_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("statement_type", T.StringType()),
        T.StructField("section", T.StringType()), T.StructField("raw_label", T.StringType()), T.StructField("template_field", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("period", T.StringType()),
        T.StructField("confidence", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("observed_at", T.TimestampType()),
    ]
)


def read_observations(spark, path: str, form: str = "parquet") -> DataFrame:
    """Observations with the fixed schema and canonical periods; a missing column is null."""
    df = spark.read.schema(OBS).format(form).load(path)
    return df.withColumn("period", F.coalesce(pr.period(F.col("period")), F.col("period")))


@query("src1_observations", oracle("select company_id, source, statement_type, raw_label, case when fq = 4 then concat('F', fy::varchar) else concat(fq::varchar, 'QF', fy::varchar) end as period, round(value * 0.1, 4) as value from fx_obs", "fx_obs"))
def src1(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_obs")
    text = F.when(F.col("fq") == 4, F.concat(F.lit("FY"), F.col("fy"))).otherwise(F.concat(F.lit("Q"), F.col("fq"), F.lit(" FY"), F.col("fy")))
    return rows.select("company_id", "source", "statement_type", "raw_label", pr.period(text, 1990, 2050).alias("period"), nb.to_crore(F.col("value"), F.lit("million")).alias("value"))


#: Spellings of a field in exchange records, in the order in which they are tried.
SPELLINGS = {"revenue": ("revenueFromOperations", "totalRevenue"), "expense": ("totalExpenses", "expenses")}


#: Keys under which a response holds its records, and spellings of the consolidated scope.
WRAPPERS = ("data", "results", "financialResults", "quarterlyResults")
CONSOLIDATED = ("consolidated", "con", "c")


def records_in(body: Column, record: str) -> Column:
    """The records of a JSON response: a list, a list under one of the wrappers, or a single record."""
    rows, text = f"array<struct<{record}>>", F.trim(body)
    wrapped = F.from_json(F.when(text.startswith("{"), text), ", ".join(f"{w} {rows}" for w in WRAPPERS))
    return F.coalesce(*(wrapped[w] for w in WRAPPERS), F.from_json(text, rows))


def exchange_records(raw: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """JSON responses to long rows: the first spelling that is there gives the field; consolidated rows only, all rows of a company that has none."""
    names = [n for group in SPELLINGS.values() for n in group]
    record = ", ".join(f"{n}: string" for n in ("statement", "unit", *names))
    rec = raw.select(*keys, F.explode(records_in(F.col(body), record)).alias("r")).select(*keys, "r.*")
    scope = F.lower(F.trim("statement"))
    rec = rec.withColumn("statement", F.when(scope.isin(*CONSOLIDATED), "consolidated").otherwise(scope))
    has = F.count_if(F.col("statement") == "consolidated").over(Window.partitionBy(keys[0]))
    rec = rec.withColumn("has", has).where((F.col("statement") == "consolidated") | (F.col("has") == 0))
    fields = {f: nb.number(F.coalesce(*spelling)) for f, spelling in SPELLINGS.items()}
    wide = rec.select(*keys, "statement", "unit", *(v.alias(f) for f, v in fields.items()))
    long = wide.unpivot([*keys, "statement", "unit"], list(fields), "field", "amount").where("amount is not null")
    return long.select(*keys, "statement", "field", nb.to_crore(F.col("amount"), F.col("unit")).alias("value"))


def _exchange(spark, sf_dir):
    rows = fixture(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 2 == 0, "revenueFromOperations").otherwise("totalRevenue")
    scope = F.when((F.col("o_custkey") % 3 == 0) | (F.col("o_orderkey") % 2 == 0), "standalone").otherwise("Con")
    text = F.concat(F.lit('{"statement":"'), scope, F.lit('","unit":"Lakhs","'), key, F.lit('":"'), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), F.lit('"}'))
    listed = F.concat(F.lit("["), text, F.lit("]"))
    shape = F.when(F.col("o_orderkey") % 3 == 0, listed).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"data":'), listed, F.lit("}"))).otherwise(F.concat(F.lit('{"quarterlyResults":'), listed, F.lit("}")))
    return rows.select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("record"), shape.alias("body"))


@query("src2_exchange_records", "with r as (select o_custkey as company_id, o_orderkey as record, case when o_custkey % 3 = 0 or o_orderkey % 2 = 0 then 'standalone' else 'consolidated' end as statement, cast(cast(o_totalprice as decimal(18,2)) as double) as v from orders), h as (select *, count(*) filter (where statement = 'consolidated') over (partition by company_id) as n from r) select company_id, record, statement, 'revenue' as field, round(v * 0.01, 4) as value from h where statement = 'consolidated' or n = 0")
def src2(spark, sf_dir):
    return exchange_records(_exchange(spark, sf_dir), "body", ["company_id", "record"])


@query("src3_statement_json", "select l_orderkey as company_id, cast(l_linenumber as integer) as line, concat('F', cast(year(l_shipdate) as varchar)) as period, l_quantity as value from lineitem where l_returnflag <> 'A'")
def src3(spark, sf_dir):
    item = F.to_json(F.struct(F.year("l_shipdate").cast("string").alias("displayPeriod"), F.col("l_quantity").alias("amount"), F.when(F.col("l_returnflag") == "A", "TTM").otherwise("FY").alias("kind")))
    shape = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit('{"data":['), item, F.lit("]}"))).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit('{"result":{"rows":['), item, F.lit("]}}"))).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    raw = fixture(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("company_id"), F.col("l_linenumber").cast("int").alias("line"), shape.alias("body"))
    row = "array<struct<displayPeriod:string,amount:double,kind:string>>"
    listed = F.from_json("body", row)
    wrapped = F.from_json("body", f"struct<data:{row},result:struct<rows:{row}>>")
    rows = F.when(F.ltrim("body").startswith("["), listed).otherwise(once(wrapped, lambda w: F.coalesce(w["data"], w["result"]["rows"], listed)))
    # For a plain explode the optimizer puts a filter on the array before it, which parses the text again.
    return raw.select("company_id", "line", F.explode_outer(rows).alias("r")).where("r.kind <> 'TTM'").select("company_id", "line", pr.period(F.col("r.displayPeriod"), 1990, 2050).alias("period"), F.col("r.amount").alias("value"))


def long_statement(wide: DataFrame, ids: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """A wide statement, one column for each year, to (ids, period, value) in crore; NaN and nulls go. labels names fields of the raw labels, others keep theirs."""
    years = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(ids, years, "period", "value").where("value is not null and not isnan(value)")
    if labels:
        pairs = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
        long = long.withColumn("raw_label", F.coalesce(F.try_element_at(pairs, F.col("raw_label")), F.col("raw_label")))
    return long.select(*ids, F.concat(F.lit("F"), F.col("period")).alias("period"), F.round(F.col("value") / 1e7, 10).alias("value"))


#: Labels of a wide statement and their fields.
WIDE_LABELS = {"standard": "revenue", "economy": "cost_of_revenue", "promo": "other_expenses"}


@query("src4_wide_statement", oracle("select company_id, case raw_label when 'standard' then 'revenue' when 'economy' then 'cost_of_revenue' when 'promo' then 'other_expenses' else raw_label end as raw_label, concat('F', fy) as period, round(max(value) / 1e7, 10) as value from fx_obs where source = 'yfinance' group by company_id, fx_obs.raw_label, fy", "fx_obs"))
def src4(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_obs").where("source = 'yfinance'")
    wide = rows.groupBy("company_id", "raw_label").pivot("fy", list(range(1980, 2036))).agg(F.max("value"))
    return long_statement(wide, ["company_id", "raw_label"], WIDE_LABELS)


def html_cells(pages: DataFrame) -> DataFrame:
    """Cells of html pages: page_id, tag, row, col, text. Arrow batches go through the parser of the standard library."""

    class Cells(HTMLParser):
        """(tag, row, column, text) of table cells and list items of a page; a helper of one page."""

        def __init__(self):
            super().__init__()
            self.out, self.tag, self.row, self.col = [], None, 0, 0

        def handle_starttag(self, tag, attrs):
            if tag in ("tr", "ul", "ol"):
                self.row, self.col = self.row + 1, 0
            elif tag in ("td", "th", "li", "h1", "p"):
                self.tag, self.col = tag, self.col + 1
                self.out.append([tag, self.row, self.col, ""])

        def handle_endtag(self, tag):
            if tag == self.tag:
                self.tag = None

        def handle_data(self, data):
            if self.tag:
                self.out[-1][3] += data

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                cells = Cells()
                cells.feed(html or "")
                rows += [(page_id, *c) for c in cells.out]
            yield pd.DataFrame(rows, columns=["page_id", "tag", "row", "col", "text"])

    return pages.select("page_id", "html").mapInPandas(parse, "page_id long, tag string, row int, col int, text string")


@query("src5_html_cells")
def src5(spark, sf_dir):
    return html_cells(fixture(spark, sf_dir, "pages"))


def filing_facts(contexts: DataFrame, facts: DataFrame, tags: DataFrame) -> DataFrame:
    """Facts of structured filings: contexts give the period, the tag table the field; the longest duration wins for each company, field and year."""
    span = F.datediff("end_date", "start_date")
    met = facts.join(contexts, ["company_id", "ctx_id"]).join(F.broadcast(tags), "tag")  # tags are a mapping written by hand
    value = F.col("value_text").try_cast("double") * F.when(F.col("decimals") <= -7, 1.0).otherwise(1e-7)
    return met.groupBy("company_id", "field", pr.fiscal_year(F.col("end_date")).alias("fy")).agg(F.max_by(value, F.struct(span, "ctx_id")).alias("value"))


@query("src8_filing_facts", "with c as (select l_suppkey as company_id, l_orderkey * 10 + l_linenumber as ctx, l_partkey, l_suppkey, cast(l_shipdate as date) as end_date, l_quantity::int as days, l_extendedprice as v, l_returnflag as tag from lineitem where l_returnflag <> 'N'), u as (select *, row_number() over (partition by company_id, ctx order by l_partkey, v) as k from c) select company_id, case tag when 'A' then 'revenue' else 'expense' end as field, cast(case when month(end_date) >= 4 then year(end_date) + 1 else year(end_date) end as integer) as fy, arg_max(v * 1e-7, days * 100000000::bigint + ctx) as value from u where k = 1 group by 1, 2, 3")
def src8(spark, sf_dir):
    rows = fixture(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").withColumn("ctx_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey", "ctx_id").orderBy("l_partkey", "l_extendedprice"))).where("k = 1").withColumnRenamed("l_suppkey", "company_id")
    end = F.to_date("l_shipdate")
    contexts = rows.select("company_id", "ctx_id", F.date_sub(end, F.col("l_quantity").cast("int")).alias("start_date"), end.alias("end_date"))
    facts = rows.select("company_id", "ctx_id", F.col("l_returnflag").alias("tag"), F.col("l_extendedprice").cast("string").alias("value_text"), F.lit(0).alias("decimals"))
    return filing_facts(contexts, facts, spark.createDataFrame([("A", "revenue"), ("R", "expense")], "tag string, field string"))


@query("src10_page_links", r"""select distinct page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]+)"', 1)) as link from pages""")
def src10(spark, sf_dir):
    links = F.array_union(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]+)"'), F.lit(1)), F.regexp_extract_all("html", F.lit(r'data-href="([^"]+)"'), F.lit(1)))
    return fixture(spark, sf_dir, "pages").select("page_id", F.explode(links).alias("link")).distinct()


@query("src11_site_roots", "select distinct regexp_extract(url, '^(https?://[^/?#]+)', 1) as root, not contains(url, 'spam') as allowed from pages where not contains(regexp_extract(url, '^(https?://[^/?#]+)', 1), 'blog.')")
def src11(spark, sf_dir):
    host = F.parse_url("url", F.lit("HOST"))
    root = F.concat(F.parse_url("url", F.lit("PROTOCOL")), F.lit("://"), host)
    return fixture(spark, sf_dir, "pages").where(~host.contains("blog.")).select(root.alias("root"), (~F.col("url").contains("spam")).alias("allowed")).distinct()


def split_pages(stitched: DataFrame, keys: list[str]) -> DataFrame:
    """Text with page markers to (keys, page_no, text)."""
    parts = stitched.select(*keys, F.explode(F.split("doc", r"(?=<<PAGE \d+>>\n)")).alias("part")).where("part <> ''")
    return parts.select(*keys, F.regexp_extract("part", r"^<<PAGE (\d+)>>", 1).cast("int").alias("page_no"), F.regexp_replace("part", r"^<<PAGE \d+>>\n", "").alias("text"))


@query("src12_split_pages", "select doc_id, 1 as page_no, text || chr(10) as text from documents union all select doc_id, 2, source || ' ' || lang from documents")
def src12(spark, sf_dir):
    doc = F.concat(F.lit("<<PAGE 1>>\n"), F.col("text"), F.lit("\n<<PAGE 2>>\n"), F.col("source"), F.lit(" "), F.col("lang"))
    return split_pages(fixture(spark, sf_dir, "documents").select("doc_id", doc.alias("doc")), ["doc_id"])


@query("src13_section_weights", "with w(sector, section, keyword, weight) as (values ('banking', 'profit', 'interest', 2.0::double), ('banking', 'balance', 'deposits', 1.5::double), ('generic', 'profit', 'revenue', 1.0::double)), s as (select s_suppkey as company_id, case s_suppkey % 3 when 0 then 'banking' when 1 then 'it' else 'generic' end as sector from supplier) select company_id, section, keyword, weight from s join w on w.sector = case when s.sector in (select sector from w) then s.sector else 'generic' end")
def src13(spark, sf_dir):
    weights = spark.createDataFrame([("banking", "profit", "interest", 2.0), ("banking", "balance", "deposits", 1.5), ("generic", "profit", "revenue", 1.0)], "sector string, section string, keyword string, weight double")
    sector = F.when(F.col("s_suppkey") % 3 == 0, "banking").when(F.col("s_suppkey") % 3 == 1, "it").otherwise("generic")
    own = fixture(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), sector.alias("wanted"))
    known = weights.select(F.col("sector").alias("known")).distinct()
    chosen = own.join(F.broadcast(known), F.col("wanted") == F.col("known"), "left").select("company_id", F.coalesce("known", F.lit("generic")).alias("sector"))
    return chosen.join(F.broadcast(weights), "sector").select("company_id", "section", "keyword", "weight")


def knowledge_base(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base concepts with a sector's overlay on top; names that begin with _ are left out."""
    b, o = base.where(~F.col("concept").startswith("_")), overlay.where(~F.col("concept").startswith("_"))
    met = b.withColumnRenamed("alias", "b").join(o.withColumnRenamed("alias", "o"), "concept", "full_outer")
    return met.select("concept", F.coalesce("o", "b").alias("alias"))


@query("src14_knowledge_base", "with b as (select concat('c', p_partkey) as concept, p_name as alias from part where p_type <> 'PROMO'), o as (select concat('c', p_partkey) as concept, upper(p_name) as alias from part where p_type in ('PROMO', 'SMALL')) select concept, coalesce(o.alias, b.alias) as alias from b full join o using (concept)")
def src14(spark, sf_dir):
    part = fixture(spark, sf_dir, "part")
    concept = F.concat(F.lit("c"), F.col("p_partkey")).alias("concept")
    return knowledge_base(part.where("p_type <> 'PROMO'").select(concept, F.col("p_name").alias("alias")), part.where("p_type in ('PROMO', 'SMALL')").select(concept, F.upper("p_name").alias("alias")))


def alias_index(base: DataFrame) -> DataFrame:
    """(alias, concept) from (concept, aliases): a concept's own name first, then its name in words and its aliases, all in lower case; of concepts that share one, the first by name."""
    own = F.array(F.struct(F.lower("concept").alias("alias"), F.lit(0).alias("step")), F.struct(F.lower(F.replace("concept", F.lit("_"), F.lit(" "))).alias("alias"), F.lit(1).alias("step")))
    more = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lower(F.trim(a)).alias("alias"), F.lit(1).alias("step")))
    rows = base.where(~F.col("concept").startswith("_")).select("concept", F.explode(F.concat(own, more)).alias("e"))
    return rows.groupBy("e.alias").agg(F.min_by("concept", F.struct("e.step", "concept")).alias("concept"))


@query("src14_alias_index", "with k as (select concat('C_', p_partkey) as concept, p_name from part), e as (select concept, lower(concept) as alias, 0 as step from k union all select concept, replace(lower(concept), '_', ' '), 1 from k union all select concept, lower(trim(p_name)), 1 from k) select alias, arg_min(concept, concat(step, concept)) as concept from e group by 1")
def src14_aliases(spark, sf_dir):
    return alias_index(fixture(spark, sf_dir, "part").select(F.concat(F.lit("C_"), F.col("p_partkey")).alias("concept"), F.array("p_name").alias("aliases")))


@query("src15_registers", "with r(nation, site) as (values (15, 'a.example'), (20, 'b.example')) select s_suppkey as company_id, coalesce(site, 'unknown') as site from supplier left join r on nation = s_nationkey")
def src15(spark, sf_dir):
    sites = spark.createDataFrame([(15, "a.example"), (20, "b.example")], "nation int, site string")
    return fixture(spark, sf_dir, "supplier").join(F.broadcast(sites), F.col("nation") == F.col("s_nationkey"), "left").select(F.col("s_suppkey").alias("company_id"), F.coalesce("site", F.lit("unknown")).alias("site"))
