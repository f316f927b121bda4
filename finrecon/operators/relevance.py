"""How much a page speaks for a section, how sure a section of a filing is, and the sector of a filing (A11, A12, A16). The tables are arguments; their defaults are fixed values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from finrecon.operators.texts import quoted
from finrecon.plans.fixtures import fixture, oracle
from finrecon.plans.registry import query

# Keywords of sections with their weights where a sector has none of its own.
SECTION_WEIGHTS = {
    "Annual P&L": {"profit and loss": 3.0, "profit before tax": 2.0, "profit after tax": 2.0},
    "Annual Balance Sheet": {"balance sheet": 3.0, "total assets": 2.5},
    "Annual Cash Flow": {"cash flow": 3.0, "cash flows from operating": 3.0},
}
# A number that stands alone, headings with years, and titles of statements.
LONE_NUMBER = r"(?<!\w)\d[\d,]*(?:\.\d+)?(?!\w)"
YEAR_HEADING = r"march\s+31,?\s+\d{4}|year\s+ended|as\s+at\s+(?:march|31)|fy\s*\d{2,4}|31\s+march\s+\d{4}"
STATEMENT_TITLE = r"statement\s+of\s+profit|profit\s+and\s+loss\s+account|balance\s+sheet|cash\s+flow\s+statement|income\s+statement"
# Lines of a table for one point and the most points for them, points for a heading with a year and for a title, characters in which a title counts, and the sum of scores at which a section is sure.
LINES_A_POINT, MOST_POINTS, YEAR_POINTS, TITLE_POINTS, TITLE_WITHIN, SURE = 8.0, 2.0, 1.5, 2.5, 400, 20.0
# Words that tell a sector, in order, and how many of them it takes.
SECTOR_WORDS = (
    ("banking", 3, ("scheduled bank", "banking company", "reserve bank of india", "net interest margin", "net npa", "gross npa", "capital adequacy ratio", "car ratio", "priority sector", "slr", "crar", "net interest income",
                    "interest earned", "interest expended", "advances", "deposits", "balances with rbi", "balances with reserve bank")),
    ("nbfc", 2, ("non-banking financial", "nbfc", "rbi registration", "assets under management", "aum", "net interest margin", "gross npa", "loan book", "disbursements", "microfinance", "housing finance")),
    ("insurance", 2, ("insurance", "premium earned", "claims paid", "reinsurance", "solvency margin", "policyholder", "underwriting", "actuarial", "irda", "irdai", "life insurance", "general insurance")),
    ("it", 2, ("software services", "information technology", "it services", "digital services", "technology solutions", "bpo", "ites", "saas", "cloud services", "nasscom", "onsite offshore")),
    ("manufacturing", 2, ("cost of materials consumed", "raw material", "manufacturing expenses", "cost of goods sold", "inventories", "inventory", "work in progress", "work-in-progress", "purchases of stock-in-trade", "plant and machinery",
                          "property, plant and equipment", "capital work-in-progress", "revenue from operations", "pharmaceutical", "pharma", "consumer products", "consumer goods", "fmcg", "industrial", "manufacturing", "chemicals", "cement",
                          "steel", "textile")),
)


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in the text, without overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def page_relevance(pages: DataFrame, weights: Mapping[str, Mapping[str, float]] = SECTION_WEIGHTS) -> DataFrame:
    """(filing, page_no, section, score): weighted logarithms of the keywords' counts, points for lines of a table, for a heading with a year and for a statement's title at the head. One pass over the pages; a null text scores 0."""
    text = F.lower(F.coalesce("text", F.lit("")))
    lines = F.size(F.filter(F.split(text, "\n"), lambda line: F.regexp_count(line, F.lit(LONE_NUMBER)) >= 2))
    shared = F.least(lines / LINES_A_POINT, F.lit(MOST_POINTS)) + F.when(text.rlike(YEAR_HEADING), YEAR_POINTS).otherwise(0.0) + F.when(F.substring(text, 1, TITLE_WITHIN).rlike(STATEMENT_TITLE), TITLE_POINTS).otherwise(0.0)
    read = pages.select("filing", "page_no", text.alias("_t"), shared.alias("_shared"))
    scores = []
    for section, words in weights.items():
        terms = [w * F.log1p(occurrences(F.col("_t"), word)) / F.log(F.lit(2.0)) for word, w in words.items()]
        scores.append(F.struct(F.lit(section).alias("section"), F.round(sum(terms[1:], terms[0]) + F.col("_shared"), 6).alias("score")))
    return read.select("filing", "page_no", F.inline(F.array(*scores)))


def section_confidence(scores: DataFrame, sure: float = SURE) -> DataFrame:
    """(filing, section, confidence): the sum of a section's scores over its pages against the sum at which it is sure, 1 at most."""
    total = F.sum(F.col("score").cast("decimal(20,6)")).cast("double")
    return scores.groupBy("filing", "section").agg(F.round(F.least(F.lit(1.0), total / sure), 6).alias("confidence"))


def document_sector(pages: DataFrame, sectors: Sequence[tuple[str, int, Sequence[str]]] = SECTOR_WORDS) -> DataFrame:
    """(filing, sector, hits): the sector with most of its words anywhere in the filing, if they reach its bound; of equals the first; else generic with 0 hits. Words are flags of pages, so a filing's text is never put together."""
    words = list(dict.fromkeys(w for _, _, own in sectors for w in own))
    text = F.lower("text")
    flags = pages.groupBy("filing").agg(*(F.coalesce(F.max(text.contains(w)), F.lit(False)).alias(f"w{i}") for i, w in enumerate(words)))
    hits = [sum((F.col(f"w{words.index(w)}").cast("int") for w in own[1:]), F.col(f"w{words.index(own[0])}").cast("int")) for _, _, own in sectors]
    told = [F.when(n >= least, F.struct(n.alias("hits"), F.lit(-k).alias("order"), F.lit(name).alias("sector"))) for k, (n, (name, least, _)) in enumerate(zip(hits, sectors, strict=True))]
    best = F.array_max(F.array_compact(F.array(*told)))
    return flags.select("filing", F.coalesce(best["sector"], F.lit("generic")).alias("sector"), F.coalesce(best["hits"], F.lit(0)).alias("hits"))


_WEIGHTS_SQL = "k(section, word, w) as (values " + ", ".join(f"({quoted(s)}, {quoted(x)}, {w}::double)" for s, own in SECTION_WEIGHTS.items() for x, w in own.items()) + ")"
RELEVANCE_SQL = f"""{_WEIGHTS_SQL}, t as (select filing, page_no, lower(coalesce(text, '')) as t from fx_filed_page),
 h as (select *, least(len(list_filter(string_split(t, chr(10)), lambda x: len(regexp_extract_all(x, '\\b\\d[\\d,]*(?:\\.\\d+)?\\b')) >= 2)) / {LINES_A_POINT}, {MOST_POINTS}) + case when regexp_matches(t, {quoted(YEAR_HEADING)}) then {YEAR_POINTS} else 0 end
   + case when regexp_matches(t[:{TITLE_WITHIN}], {quoted(STATEMENT_TITLE)}) then {TITLE_POINTS} else 0 end as shared from t),
 s as (select filing, page_no, section, round(sum(w * ln(1 + (length(t) - length(replace(t, word, ''))) / length(word)) / ln(2.0)) + any_value(shared), 6) as score from h cross join k group by 1, 2, 3)"""


@query("a11_page_relevance", oracle(f"with {RELEVANCE_SQL} select * from s", "fx_filed_page"))
def a11_relevance(spark, sf_dir):
    return page_relevance(fixture(spark, sf_dir, "fx_filed_page"))


@query("a16_section_sureness", oracle(f"with {RELEVANCE_SQL} select filing, section, round(least(1.0::double, cast(sum(cast(score as decimal(20,6))) as double) / {SURE}), 6) as confidence from s group by 1, 2", "fx_filed_page"))
def a16_sureness(spark, sf_dir):
    return section_confidence(page_relevance(fixture(spark, sf_dir, "fx_filed_page")))


_SECTORS_SQL = "k(sector, least, place, word) as (values " + ", ".join(f"({quoted(s)}, {n}, {i}, {quoted(w)})" for i, (s, n, own) in enumerate(SECTOR_WORDS) for w in own) + ")"


@query(
    "a12_filing_sector",
    oracle(
        f"with {_SECTORS_SQL}, m as (select filing, sector, least, place, count(distinct word) as n from fx_filed_page join k on contains(lower(text), word) group by 1, 2, 3, 4), b as (select *, row_number() over (partition by filing order by n desc, place) as o from m where n >= least), f as (select distinct filing from fx_filed_page) select filing, coalesce(sector, 'generic') as sector, cast(coalesce(n, 0) as integer) as hits from f left join (select * from b where o = 1) using (filing)",
        "fx_filed_page",
    ),
)
def a12_sector(spark, sf_dir):
    return document_sector(fixture(spark, sf_dir, "fx_filed_page"))
