"""Inputs of the library's schemas, derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finrecon.functions import rules

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

OBS = """select l_suppkey as company_id, lower(p_type) as raw_label,
 case l_returnflag when 'A' then 'xbrl' when 'N' then 'screener' else 'yfinance' end as source,
 case l_linestatus when 'O' then 'consolidated' else 'standalone' end as statement_type,
 cast(case when month(l_shipdate)>=4 then year(l_shipdate)+1 else year(l_shipdate) end as int) as fy,
 cast(case when month(l_shipdate) between 4 and 6 then 1 when month(l_shipdate) between 7 and 9 then 2
      when month(l_shipdate)>=10 then 3 else 4 end as int) as fq,
 cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as value
from lineitem join part on p_partkey=l_partkey
group by 1,2,3,4,5,6"""
CONCEPTS = """select company_id, source, statement_type, fy, fq, value,
 case raw_label when 'standard' then 'revenue_from_operations' when 'economy' then 'cost_of_goods_sold'
  when 'medium' then 'employee_benefits_expense' when 'promo' then 'other_expenses'
  when 'small' then 'depreciation_amortization' else 'finance_cost' end as concept
from fx_obs"""
PERIOD_TEXT = """select o_orderkey as id, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m,
 case o_orderkey % 8
  when 0 then concat('FY', cast(year(o_orderdate) as varchar(4)))
  when 1 then concat('F', cast(year(o_orderdate) as varchar(4)))
  when 2 then concat(cast(year(o_orderdate)-1 as varchar(4)),'-',substring(cast(year(o_orderdate) as varchar(4)),3,2))
  when 3 then concat('March 31, ', cast(year(o_orderdate) as varchar(4)))
  when 4 then concat('Q', cast(o_orderkey % 4 + 1 as varchar(1)), ' FY', substring(cast(year(o_orderdate) as varchar(4)),3,2))
  when 5 then concat('Mar ', cast(year(o_orderdate) as varchar(4)))
  when 6 then concat('Jun-', substring(cast(year(o_orderdate) as varchar(4)),3,2))
  else 'TTM' end as raw_period
from orders"""
NUMBER_TEXT = """select o_orderkey as id, o_totalprice as v,
 case o_orderkey % 6
  when 0 then concat('(', cast(cast(o_totalprice as decimal(18,2)) as varchar(30)), ')')
  when 1 then concat('₹ ', cast(cast(o_totalprice as decimal(18,2)) as varchar(30)))
  when 2 then concat(cast(cast(o_totalprice as decimal(18,2)) as varchar(30)), ' Mn')
  when 3 then 'Nil'
  when 4 then concat(cast(cast(o_totalprice as decimal(18,2)) as varchar(30)), ' Cr')
  else cast(cast(o_totalprice as decimal(18,2)) as varchar(30)) end as raw
from orders"""
TEMPLATE = "select distinct concat(upper(substring(p_name,1,1)), substring(p_name,2)) as template_label from part"
POOL_LABEL = "select distinct concat('Less: ', upper(p_name), ' (net)') as raw_label from part where p_partkey % 3 <> 0"
FILING_PAGES = "select source as filing, doc_id as page_no, text, lang, n_chars from documents"

_NAMED = ", ".join(f"({i}, '{c}')" for i, c in enumerate(rules.CONCEPTS))
#: Values of all concepts by company and year, scattered over the companies by the keys of the rows; a few are negative.
LINES = f"""select l_suppkey as company_id, case l_suppkey % 4 when 1 then 'bank' when 2 then 'nbfc' when 3 then 'insurance' else 'general' end as sector,
 cast(year(l_shipdate) as int) as fy, concept,
 cast(sum(cast(case when l_returnflag = 'R' and l_tax > 0.06 then -l_extendedprice else l_extendedprice end as decimal(18,2))) as double) as value
from lineitem join (select * from (values {_NAMED}) as c(i, concept)) c on c.i = (l_orderkey + 7 * l_partkey + 13 * l_linenumber) % {len(rules.CONCEPTS)}
group by 1,2,3,4"""

#: Labels, headings and company names as filings have them; rows of a table pick one by their key.
WORDING = {
    "label": ("Revenue from Operations", "Net Sales (gross of excise)", "Cost of materials consumed", "Gross profit", "Employee benefits expense", "EBITDA margin", "Depreciation and amortisation expense", "EBIT",
              "Finance costs", "Profit before tax", "Total tax expense", "Profit for the year", "Intangible assets under development", "Other non-current assets", "Trade receivables", "Non-current borrowings",
              "For Sharp & Tannan LLP", "DIN: 00012345", "Place: Mumbai", "In terms of our report attached", "Company Secretary", "a b c d profit", "12", "Total - (A)", "otal income", "March March", "SCHEDULE",
              "a) Opening balance", "(b) Additions", "iv) Closing stock", "In favour", "the bank had", "12,000 Equity Shares of ₹ 10 each", "options were granted in the y ear", "weighted average exercise price",
              "(ii)", "Tax effect of unusual items", "Interest expense", "Repurchase of capital stock", "Exceptional items", "Loss on sale of assets", "Inventories",
              "Net cash generated from operating activities", "Net cash used in investing activities", "Cash flow from financing activities", "Cash and cash equivalents at the beginning of the year", "Closing cash balance",
              "Net increase in cash and cash equivalents", "Income taxes paid", "Changes in working capital", "Less: Cost of goods sold", "Diluted EPS",
              "Other expenses, which for this purpose hold the cost of power, fuel, freight and outside services"),
    "line": ("Standalone Balance Sheet", "Particulars FY2024 FY2023", "Revenue from operations 12 #1 #2", "Non-current liabilities", "Borrowings #1 (#2)", "Provisions #1 #2", "Current assets", "Investments 4 #1 #2",
             "Consolidated Statement of Profit and Loss", "Year ended March 31, 2022 Year ended March 31, 2021", "a) Finance costs #1 #2", "| Particulars | FY2024 | FY2023 |", "|---|---|---|", "| Trade receivables | #1 | #2 |",
             "| Inventories | #2 | #1 |", "Balance sheet", "As at March 31, 2019", "Equity", "Reference years 2023 2024", "Growth of sales 0.12 0.45", "Statement of cash flows", "Depreciation and amortisation expense #2 #1 #1",
             "Consolidated Balance Sheet", "31 March 2020 31 March 2020 31 March 2019", "Non-current assets", "Investments 7 #2 #1", "page 7 [SCOPE=UNKNOWN]", "Current liabilities", "Lease liabilities #1 #2", "Words without figures"),
    "sheet": ("Annual P&L", "Annual Balance Sheet", "Cash Flow", "Operating Metrics", "Quarterly P&L", "Key ratios", "Asset quality", "Quarterly results", "Consolidated BS", "Cover"),
    "cover": ("Annual Report 2023-24", "Intimation of the outcome of the board meeting", "Unaudited financial results", "Investor Presentation Q2 FY24", "Standalone Balance Sheet", "Transcript of the call", "Results for the quarter ended June 30", ""),
    "heading": ("Standalone Balance Sheet as at March 31, 2024", "Consolidated Statement of Profit and Loss", "Cash Flow Statement for the year", "Notes to the standalone financial statements", "Schedule 12 Deposits",
                "Significant accounting policies", "Independent Auditor's Report", "Key performance indicators and CRAR", "Sustainability report: GHG emissions", "No. of beneficiaries reached", "Corporate Governance Report",
                "Revenue from operations (Rs. in lakhs)", "Segment reporting (₹ in crore)", "Related party transactions in 000's", "Unaudited results for the quarter ended June 30", "Chairman's message", "Property, plant and equipment (₹ 000)",
                "Contingent liabilities", "Other expenses, amount in thousand", "Notice of the Annual General Meeting", "(₹ lakhs) Borrowings", "Rs. million unless stated", "Maturity pattern of deposits", "Interest earned, all figures '000", "plain words only"),
    "company": ("Harbour Bank Ltd", "Northern Life Insurance", "Alpha Asset Management", "Delta Broking", "Sunrise Housing Fin", "Blue Infotech", "Green Pharma", "Daily Foods", "Swift Motors", "Iron Steel Works", "Coast Petroleum",
                "Hill Power", "Urban Developers", "Sky Telecom", "Lens Media", "Agro Chem", "Rock Cement", "Shaft Engineers", "Ocean Shipping", "Plain Trading"),
}


def _pick(kind: str, key: str) -> str:
    words = WORDING[kind]
    return f"case {key} % {len(words)} " + " ".join("when {} then '{}'".format(i, w.replace("'", "''")) for i, w in enumerate(words)) + " end"


def _picked(kind: str, key: str) -> str:
    """The same word as _pick, from one literal array: a branch for each word makes generated code too long for the JVM to compile."""
    words = WORDING[kind]
    return "get(array({}), cast({} % {} as int))".format(", ".join("'{}'".format(w.replace("'", "''")) for w in words), key, len(words))


RAW_LABEL = f"select l_orderkey as id, l_linenumber as line, l_suppkey as company_id, {_pick('label', '(l_orderkey + 5 * l_linenumber + l_partkey)')} as label, cast(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as double) as value from lineitem"
FILED_PAGE = f"select o_custkey as filing, o_orderkey as page_no, concat({_pick('heading', '(o_orderkey + o_custkey)')}, chr(10), 'Particulars | 2024 | 2023', chr(10), o_orderpriority, ' | ', cast(o_orderkey as varchar(20))) as text from orders"
COMPANY = f"select s_suppkey as company_id, {_pick('company', 's_suppkey')} as name from supplier"

#: Lines of filings: the lines of a page follow each other in the list, with two figures of the row put in.
FILED_LINE = f"""select filing, page_no, line_no, replace(replace({_pick('line', '(page_no * 7 + line_no)')}, '#1', v), '#2', w) as line
from (select cast(floor(l_orderkey / 16) as bigint) as filing, l_orderkey as page_no,
 cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as line_no,
 cast(cast(l_extendedprice as decimal(18,2)) as varchar(30)) as v, cast(cast(l_quantity * 1000 as decimal(18,2)) as varchar(30)) as w
from lineitem) as numbered"""
SHEET = f"select p_partkey as id, {_pick('sheet', 'p_partkey')} as sheet from part"
COVER_PAGE = f"select o_custkey as filing, o_orderkey as page_no, {_pick('cover', '(o_orderkey + o_custkey)')} as text from orders"

FIXTURES = {
    "fx_filed_line": FILED_LINE,
    "fx_sheet": SHEET,
    "fx_cover_page": COVER_PAGE,
    "fx_raw_label": RAW_LABEL,
    "fx_filed_page": FILED_PAGE,
    "fx_company": COMPANY,
    "fx_lines": LINES,
    "fx_obs": OBS,
    "fx_concepts": CONCEPTS,
    "fx_period_text": PERIOD_TEXT,
    "fx_number_text": NUMBER_TEXT,
    "fx_template": TEMPLATE,
    "fx_pool_label": POOL_LABEL,
    "fx_pages": FILING_PAGES,
}

#: The pick expressions of the fixtures, and what Spark runs in their place.
PICKS = {
    _pick(kind, key): _picked(kind, key)
    for kind, key in (
        ("label", "(l_orderkey + 5 * l_linenumber + l_partkey)"), ("heading", "(o_orderkey + o_custkey)"), ("company", "s_suppkey"),
        ("line", "(page_no * 7 + line_no)"), ("sheet", "p_partkey"), ("cover", "(o_orderkey + o_custkey)"),
    )
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a given table by its own name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name]
    for by_case, by_array in PICKS.items():
        text = text.replace(by_case, by_array)
    if name == "fx_concepts":
        return spark.sql(text.replace("fx_obs", "{obs}"), obs=fixture(spark, sf_dir, "fx_obs"))
    used = [t for t in TABLES if f"from {t}" in text or f"join {t} " in text]
    for t in used:
        text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(text, **{t: fixture(spark, sf_dir, t) for t in used})


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL with the named fixtures in front."""
    if "fx_concepts" in names and "fx_obs" not in names:
        names = ("fx_obs", *names)
    ctes = ", ".join(f"{n} as ({FIXTURES[n]})" for n in names)
    body = body.strip()
    if not names:
        return body
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") else f"with {ctes} {body}"
