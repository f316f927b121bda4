"""Fields of statement lines by ordered patterns, as data, and the literal that a label must hold for a pattern to be tried."""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser

# For each section the fields in order, each with its patterns; the first that a label matches is its field.
PROFIT_AND_LOSS = (
    ("Revenue from operations", (
        r"revenue from operations", r"net revenue from operations", r"total revenue from operations", r"revenue from contracts? with customers?", r"revenue from software\b", r"revenue from services?\b",
        r"\bnet\s+sales?\b", r"\btotal\s+sales?\b", r"\bnet\s+turnover\b", r"\bgross\s+revenue\s+from\s+operations?\b", r"\btotal\s+income\s+from\s+operations?\b",
        r"\btotal\s+operating\s+(?:revenue|income)\b", r"\bsales\s+(?:and\s+)?other\s+operating\s+(?:revenue|income)\b",
    )),
    ("Less: Cost of goods sold", (r"^cost of goods sold\b", r"^cost of revenues?\b", r"^cost of sales?\b", r"^cost of services?\b", r"cost of goods sold")),
    ("_cogs_materials", (r"cost of materials consumed", r"raw materials? consumed", r"consumption of raw materials?")),
    ("_cogs_purchases", (r"purchases? of stock.in.trade", r"purchase of traded goods", r"purchases? of finished goods")),
    ("_cogs_inventory_change", (r"changes? in inventories?", r"(?:increase|decrease) in inventories?")),
    ("Employee benefits expense", (r"employee benefits? expense", r"\bstaff costs?\b", r"personnel (?:expense|costs?)", r"manpower (?:expense|costs?)", r"salaries.*wages.*bonus", r"wages.*salaries")),
    ("Other expenses (Net)", (
        r"other expenses?\b(?!\s*income)", r"other operating expenses?", r"selling.*general.*(?:and\s+)?administrative", r"general.*(?:and\s+)?administrative.*expenses?", r"administration\s+expenses?", r"selling.*distribution.*expenses?",
    )),
    ("Less: Depreciation, amortization & impairment", (
        r"depreciation.*amorti[sz]ation", r"depreciation\s+and\s+amorti[sz]ation", r"depreciation.*impairment", r"\bdepreciation\b.*\bexpense\b", r"\bamorti[sz]ation\b.*\bexpense\b",
    )),
    ("Less: Finance cost", (
        r"finance costs?", r"interest expense", r"finance charges?", r"borrowing costs?", r"interest on borrowings?", r"financial (?:expense|charges?|costs?)", r"interest\s+(?:and\s+)?finance\s+charges?",
    )),
    ("Add: Other Income (Net)", (r"other income\b", r"other income \(net\)", r"non.operating income", r"miscellaneous\s+income\b")),
    ("Add: Share of net profit of associates", (
        r"^share of (?:net )?profit (?:of|from) associates?", r"equity in (?:net\s+)?earnings", r"^share of profit.*associates?", r"^share of profit.*joint ventures?", r"share of (?:net\s+)?profit.*equity method",
    )),
    ("Less: Tax", (
        r"\btotal\s+(?:income\s+)?tax\s*(?:expense)?\b", r"^provision\s+for\s+(?:income\s+)?tax\b", r"less:\s*income\s+tax\s+expense", r"income\s+tax\s+expense\b", r"^tax\s+expense\b", r"^income\s+tax\b(?!\s+assets?)",
    )),
    ("Profit after Tax", (r"profit after (?:income\s+)?tax\b", r"profit for the (?:year|period)\b", r"net profit after tax\b", r"profit \(after tax\)", r"net (?:income|earnings?) after tax\b")),
    ("Diluted EPS", (r"diluted\s+(?:earnings per share|eps|e\.p\.s\.)", r"earnings per equity share.*diluted", r"diluted\s+eps\b")),
)
BALANCE_SHEET = (
    ("Property, Plant & Equipment", (r"property,?\s+plant\s+(?:and|&)\s+equipment\b(?!\s+net)",)),
    ("Capital Work in Progress", (r"capital work.in.progress", r"\bcwip\b")),
    ("Goodwill", (r"\bgoodwill\b(?!\s+on\s+(?:impairment|testing))",)),
    ("Intangible Asset", (r"intangible assets?\b(?!\s+under)",)),
    ("Intangible Assets under development", (r"intangible assets?\s+under\s+development",)),
    ("Right of Use Assets", (r"right.of.use assets?", r"\brou\s+assets?\b")),
    ("Investments - equity method", (r"investments?.*equity method", r"investments?.*associates.*equity", r"investments?.*associates?\b", r"investments?.*joint ventures?")),
    ("Other Investments", (r"other investments?\b", r"current investments?\b", r"investments?.*fair value", r"investments?.*mutual\s+funds?\b")),
    ("Other Financial Assets", (r"other financial assets?\b",)),
    ("Income Tax Assets (Net)", (r"income tax assets?\s*\(?net\)?", r"advance\s+income.tax", r"current tax assets?\s*\(?net\)?")),
    ("Deferred tax assets (Net)", (r"deferred tax assets?\s*\(?net\)?",)),
    ("Other non-current assets", (r"other non.current assets?", r"other\s+noncurrent\s+assets?")),
    ("Total Non-Current Assets", (r"total non.current assets?",)),
    ("Inventories", (r"\binventories\b", r"\bstock.in.trade\b")),
    ("Trade Receivables", (r"trade receivables?", r"sundry\s+debtors?\b", r"trade\s+debtors?\b", r"accounts\s+receivable\b")),
    ("Cash & Cash Equivalents", (r"cash and cash equivalents?", r"cash\s*&\s*cash equivalents?", r"cash\s+and\s+bank\s+balances?\b(?!\s+other)")),
    ("Bank Balances Other Than above", (r"bank balances?\s+other than", r"other\s+bank\s+balances?")),
    ("Other Current Assets", (r"other current assets?\b",)),
    ("Total Current Assets", (r"total current assets?",)),
    ("Total Assets", (r"total assets\b",)),
    ("Equity Share capital", (r"(?:equity\s+)?share capital\b", r"paid.up\s+(?:equity\s+)?share\s+capital", r"paid.up\s+capital\b")),
    ("Other Equity", (r"other equity\b", r"reserves\s+and\s+surplus", r"shareholders.?\s*funds?\b", r"total\s+other\s+equity\b")),
    ("Total Equity", (r"total equity\b", r"total shareholders.?\s*equity")),
    ("Borrowings (Non-Current)", (r"borrowings?\b.*non.current", r"non.current.*borrowings?\b")),
    ("Lease Liabilities (Non-Current)", (r"lease liabilit(?:y|ies).*non.current", r"non.current.*lease liabilit")),
    ("Provisions (Non-Current)", (r"provisions?\s+non.current", r"non.current.*provisions?\b")),
    ("Deferred tax liabilities (Net)", (r"deferred tax liabilit(?:y|ies)\s*\(?net\)?",)),
    ("Other Non-Current Liabilities", (r"other non.current liabilit", r"other noncurrent liabilit")),
    ("Total Non-Current Liabilities", (r"total non.current liabilit",)),
    ("Borrowings (Current)", (r"borrowings?\b.*current(?!\s+assets)", r"current.*borrowings?\b(?!.*non)")),
    ("Dues of Micro & small enterprises", (r"dues.*micro.*small", r"\bmsme\b", r"micro.*small.*enterprises?")),
    ("Dues of other creditors", (r"dues.*other\s+creditors?", r"dues.*creditors?\s+other\s+than", r"creditors?\s+other\s+than\s+micro", r"other\s+than\s+micro.*small.*enterprise")),
    ("Other Financial Liabilities", (r"other financial liabilit",)),
    ("Other Current Liabilities", (r"other current liabilit",)),
    ("Provisions (Current)", (r"provisions?\s+(?:\(current\)|current)",)),
    ("Current Tax Liabilities (Net)", (r"current tax liabilit",)),
    ("Total Current Liabilities", (r"total current liabilit",)),
    ("Total Equity & Liabilities", (r"total equity\s*(?:and|&)\s*liabilit",)),
)
CASH_FLOW = (
    ("Net Cash from Operating Activities", (r"net cash (?:generated |flow )?from operating", r"net cash.*operating activities?", r"cash (?:generated|used) (?:in|from) operations?", r"net cash(?:flow)?\s+from\s+operations?\b")),
    ("Net Cash from Investing Activities", (r"net cash (?:used |flow )?(?:in|from) investing", r"net cash.*investing activities?", r"cash (?:used|generated) in investing")),
    ("Net Cash from Financing Activities", (r"net cash (?:used |flow )?(?:in|from) financing", r"net cash.*financing activities?", r"cash (?:used|generated) in financing")),
    ("Net Change in Cash", (r"net (?:increase|decrease|change) in cash", r"net change in cash", r"(?:increase|decrease) in cash and cash equivalents?", r"net (?:increase|decrease) in cash and bank")),
    ("Opening Cash", (r"cash.*(?:beginning|opening)\s+of\s+(?:year|period)", r"opening balance.*cash", r"cash.*balance.*(?:beginning|opening)", r"cash and cash equivalents?.*beginning")),
    ("Closing Cash", (r"cash.*(?:end|close)\s+of\s+(?:year|period)", r"closing balance.*cash", r"cash.*balance.*(?:end|close)", r"cash and cash equivalents?.*end\s+of")),
)
SECTION_FIELDS = {"Annual P&L": PROFIT_AND_LOSS, "Annual Balance Sheet": BALANCE_SHEET, "Annual Cash Flow": CASH_FLOW}


def literal_of(pattern: str) -> str:
    """The longest text without a choice that every match of the pattern holds, in lower case; empty if there is none."""
    best = run = ""
    for kind, value in parser.parse(pattern):
        run = run + chr(value) if kind is kinds.LITERAL else ""
        best = max(best, run, key=len)
    return best.lower()
