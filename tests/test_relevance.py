"""Page scores and sectors: literal cases."""

import math

from finrecon.operators import relevance as rel

SCHEMA = "filing long, page_no int, text string"


def test_signals_of_a_page(spark):
    table = "\n".join(["item 1,200 3.5", "x1 2y 7"] * 20)
    pages = [(1, 1, "Balance Sheet as at March 31, 2024\ntotal assets 5"), (1, 2, table), (1, 3, "x" * 400 + " balance sheet balance sheet"), (1, 4, None), (1, 5, "FY24 profit after tax")]
    got = {(r["page_no"], r["section"]): r["score"] for r in rel.page_relevance(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[1, "Annual Balance Sheet"] == 3.0 + 2.5 + 0.125 + 1.5 + 2.5 and got[1, "Annual P&L"] == 4.125
    assert got[2, "Annual P&L"] == 2.0 and got[4, "Annual Cash Flow"] == 0.0
    assert got[3, "Annual Balance Sheet"] == round(3 * math.log(3) / math.log(2), 6) and got[5, "Annual P&L"] == 3.5
    sure = {r["section"]: r["confidence"] for r in rel.section_confidence(rel.page_relevance(spark.createDataFrame(pages, SCHEMA))).collect()}
    assert sure["Annual Balance Sheet"] == round(min(1, (9.625 + 2 + got[3, "Annual Balance Sheet"] + 1.5) / 20), 6) and sure["Annual Cash Flow"] == round((4.125 + 2 + 1.5) / 20, 6)


def test_sectors(spark):
    pages = [(1, 1, "CRAR and SLR"), (1, 2, "Gross NPA"), (2, 1, "gross npa, loan book"), (3, 1, "gross npa"), (3, 2, None), (4, 1, None), (5, 1, "insurance cement steel claims paid"), (6, 1, "Life insurance steel cement FMCG pharma")]
    got = {r["filing"]: (r["sector"], r["hits"]) for r in rel.document_sector(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {1: ("banking", 3), 2: ("nbfc", 2), 3: ("generic", 0), 4: ("generic", 0), 5: ("insurance", 2), 6: ("manufacturing", 4)}
