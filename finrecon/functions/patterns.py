"""Patterns of labels, headings, units and companies, in the order in which they are tried. All of it is data; users pass tables of the same form."""

from __future__ import annotations

# Audit and signature lines among labels.
BOILERPLATE = (
    r"(?i)\bfor\s+[A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,5}\s*(?:LLP|& Co|& Associates|Chartered Accountants)\b",
    r"(?i)\bDIN\s*[:#]?\s*\d{6,}",
    r"(?i)\b(?:chairman|managing director|whole.?time director|chief financial officer|chief executive officer|company secretary|partner|membership(?:\s+no)?|registration(?:\s+no)?)\b",
    r"(?i)^(?:place|date)\s*[:#]",
    r"(?i)in terms of our (?:attached )?report",
)
# Words split by character recognition, phrases of notes, lone numerals.
SPLIT_WORD = r"[a-z] [a-z]{2,}"
NUMERAL = r"^[\(\[ivxIVX\d\s\)\]]+$"
NOTE_PHRASES = (
    "attending every meeting", "options were exercised", "options were granted", "not applicable", "refer note", "per the", "as per the", "in years", "year 1", "year 2", "year 3", "year 4", "year 5",
    "subtotal", "opening balance", "closing balance", "weighted average", "exercise price", "grant date", "defined benefit", "post-retirement", "pension plan", "sensitivity analysis", "discount rate",
    "mortality rate", "not later than", "later than one", "financial year ended",
)
# Rows of schedules, votes and page heads among labels.
JUNK = (
    r"(?i)^Total\s*[-–]\s*\([A-Z]{1,3}\)\s*$", r"(?i)^[A-Z]\s+Balance\s+in\b", r"(?i)^March\s+March\b", r"(?i)^otal\s+", r"(?i)^ess:\s+", r"(?i)\b(?:REPORTS|STATUTORY|STATEMENTS)\s*$",
    r"(?i)^No\.\s+of\s+valid\s+votes\b", r"(?i)^(?:In\s+favour|Against)\s*$", r"(?i)^Percentage\s*\(%\)\s+(?:in\s+favour|against)\b", r"(?i)equity\s+shares\s+of\s+[₹\d]", r"(?i)\bprevious\s+year\s*[:]\s*[\d,]",
    r"(?i)^\s*\(?[a-e]\)\s+", r"(?i)^\s*[ivxl]+\)\s+", r"(?i)^.{80,}\s+crore\b", r"(?i)^the\s+bank\s+had\b", r"^[A-Z]{7,}(?:[\s\-][A-Z]{2,})*\s*$",
)
# Noise of a reformulating source, and its lines with the sign turned round.
REFORMULATED = r"(?i)^(?:tax effect of|tax rate for|normalized\s|reconciled\s|diluted average|basic average|special income|net non operating interest|otherunder preferred|(?:repurchase|issuance) of capital|(?:proceeds|repayment) of (?:debt|long term debt))"
SIGN_TURNED = ("interest expense", "tax provision", "income tax", "depreciation amortization", "depreciation amortization depletion", "reconciled depreciation")
# Words of lines that may be losses.
MAY_LOSE = ("profit", "earnings", "income before tax", "income after tax", "comprehensive income", "exceptional", "gain", "loss")

# Heads of pages with notes and disclosures, titles of statements, and signs of other pages.
NOTES_PAGE = (
    r"(?i)contingent liabilit|notes?\s+(?:to|on|forming part of)\s+(?:the\s+)?(?:accounts?|financial)|notes?\s+(?:and\s+)?(?:significant\s+)?accounting\s+polic|significant\s+accounting\s+polic|basis\s+of\s+(?:preparation|consolidation)"
    r"|statutory\s+auditor|independent\s+auditor|report\s+of\s+the\s+(?:statutory\s+)?auditor|related\s+party\s+disclosure|deferred\s+tax\s+(?:asset|liabilit)|capital\s+(?:commitments?|adequacy\s+ratio)|capital\s+to\s+risk"
    r"|risk\s+weighted\s+assets|\bcrar\b|basel\s+(?:i+|accord|framework|norm)|pillar\s+[123]|paid.up\s+(?:equity\s+)?capital\s+raised|maturity\s+pattern|concentration\s+of\s+(?:deposit|advance|exposure)|sector.?wise\s+(?:classification|exposure|npa)"
)
STATEMENT_TITLE = r"(?i)balance\s+sheet|profit\s+(?:and|&)\s+loss|profit\s+and\s+loss\s+account|cash\s+flow\s+statement|income\s+statement|statement\s+of\s+(?:profit|financial\s+position)|revenue\s+from\s+operations|interest\s+earned|interest\s+income"
NOTES_TITLE = r"(?im)^\s*(?:notes?\s+(?:to|on|forming\s+part)|schedule\s+\d+\b|significant\s+accounting\s+polic|basis\s+of\s+(?:preparation|consolidation)|auditor.s\s+report)"
NOT_FINANCIAL = (
    r"(?i)capital\s+adequacy|risk\s+weighted\s+assets|\bcrar\b|\bbasel\s+(?:ii|iii)\b|energy\s+(?:consumption|intensity|generated)|ghg\s+emissions?|greenhouse\s+gas|carbon\s+footprint|\besg\s+(?:report|framework|polic)|sustainability\s+report"
    r"|environmental\s+(?:performance|impact|data)|waste\s+(?:generated|disposed|recycled)|water\s+(?:consumption|withdrawal|discharge)|csr\s+(?:activit|expenditure|spend|committee)|business\s+responsibility\s+(?:and\s+sustainability\s+)?report"
    r"|\bbrsr\b|directors.\s+report|corporate\s+governance\s+report|management\s+discussion\s+(?:and|&)\s+analysis|training\s+(?:hours?|programme|beneficiar)|employee\s+(?:engagement|wellness|strength)"
)
COUNT_TABLES = r"(?i)no\.\s+of\s+beneficiar|number\s+of\s+beneficiar|beneficiar(?:y|ies)\s+\(in\s+numbers?\)|no\.\s+of\s+(?:camps?|programmes?|schools?|clinics?|villages?|households?)|\bsebi\s+\(share\s+based\s+employee\b|\bsweat\s+equity\s+shares?\b"

# Unit phrases and the divisor to crore.
UNITS = (
    (r"(?i)(?:rs\.?|₹|inr|amount)\s*in\s*(?:indian\s+)?(?:rs\.?\s*)?crore", 1.0), (r"(?i)\bcrore", 1.0), (r"(?i)(?:rs\.?|₹|inr)\s*in\s*million", 10.0), (r"(?i)\brs\.\s*million\b", 10.0),
    (r"(?i)(?:rs\.?|₹|inr|amount)\s*in\s*(?:rs\.?\s*)?lakh", 100.0), (r"(?i)\(?rs\.?\s*lakh\)?", 100.0), (r"(?i)\blakh", 100.0), (r"(?i)(?:rs\.?|₹|inr|amount)\s*in\s*(?:rs\.?\s*)?thousand", 10000.0),
    (r"(?i)\(?(?:rs\.?|₹)\s*000\)?", 10000.0), (r"(?i)₹\s*in\s*000", 10000.0), (r"(?i)\bthousand", 10000.0), (r"(?i)000[‘’ʼ`']\s*s\s+of", 10000.0), (r"(?i)in\s+000[‘’ʼ`']\s*s\b", 10000.0), (r"(?i)'000", 10000.0),
    (r"(?i)\b000s\b", 10000.0), (r"(?i)amounts?\s+in\s+000", 10000.0),
)
UNIT_WINDOWS = (2000, 5000, 15000, None)

# Keywords of sections in the order in which sections are tried.
SECTIONS = (
    ("Annual P&L", ("profit and loss", "profit & loss", "income statement", "statement of profit", "statement of operations", "revenue from operations", "interest income", "interest earned", "total income", "net revenue")),
    ("Annual Cash Flow", ("cash flow", "cash flows", "statement of cash", "operating activities", "investing activities", "financing activities")),
    ("Operating Metrics", ("key performance indicator", "financial highlight", "key financial indicator", "key indicator", "performance highlight", "business highlight", "asset quality", "capital adequacy", "crar", "gnpa", "nnpa", "gross npa",
                           "net npa", "net interest margin", "nim", "return on asset", "return on equity", "casa ratio", "loan book", "book value", "credit cost", "provision coverage", "slippage", "cost to income", "disbursement", "aum", "collection efficiency")),
    ("Quarterly", ("quarterly result", "quarter ended", "results for the quarter", "unaudited result", "limited review")),
    ("Annual Balance Sheet", ("balance sheet", "financial position", "assets and liabilities", "total assets", "total liabilities", "equity and liabilities", "sources of funds", "application of funds")),
)
CONSOLIDATED, STANDALONE = r"(?i)\bconsolidated\b", r"(?i)\bstandalone\b|\bseparate\b"
# Titles of pages; a first group holds the scope.
_SCOPE = "(standalone|consolidated)?"
PAGE_TITLES = (
    ("Auditor's Report", rf"(?:report on the audit of the |independent auditor['’]?s? report)\s*(?:.{{0,80}}{_SCOPE[:-1]})?"), ("Balance Sheet", rf"{_SCOPE}\s*balance sheet"), ("Statement of P&L", rf"{_SCOPE}\s*statement of (?:profit|financial position)"),
    ("Cash Flow", rf"{_SCOPE}\s*(?:statement of )?cash flow"), ("Changes in Equity", rf"{_SCOPE}\s*statement of changes in equity"), ("Notes", rf"notes to (?:the )?{_SCOPE} ?financial statements?"), ("PPE schedule", r"()property,?\s+plant\s+(?:&|and)\s+equipment"),
    ("Investments schedule", r"()investments?\b"), ("Borrowings schedule", r"()borrowings?\b"), ("Trade Receivables schedule", r"()trade receivables?\b"), ("Revenue note", r"()revenue from operations?\b"), ("Employee Benefits note", r"()employee benefits?\s+expense"),
    ("Other Expenses note", r"()other expenses?\b"), ("Finance Costs note", r"()finance costs?\b"), ("Tax note", r"()tax expense\b|income tax expense\b"), ("Segment Reporting", r"()segment (?:reporting|information)"), ("Contingent Liabilities", r"()contingent liabilities?"),
    ("Related Party", r"()related party transactions?"), ("MD&A", r"()management discussion (?:and|&) analysis|md&a|mda\b"), ("Director's Report", r"()director['’]?s? report"), ("Corporate Governance", r"()corporate governance"),
    ("Notice of AGM", r"()notice of (?:the )?annual general"), ("Sustainability/BRSR", r"()sustainability|brsr"), ("Chairman's Statement", r"()chairman['’]?s? (?:message|letter|statement)"),
)
# Sectors by the name of a company.
SECTORS = (
    ("bank", r"\bBANK\b|BNK$|BNKLTD$|SFB|FINANCE BANK|PAYMENTSBANK"), ("insurance", r"INSURANCE|INSUR\b|\bLIFE\b|LIFEINS|GENINS|GIC\b|REINSUR"), ("amc", r"\bAMC\b|MUTUAL\s*FUND|ASSET\s*MANAGE"),
    ("broker", r"BROKING|SECURITIES|EXCHANGE|DEPOSITORY|CDSL|NSDL"), ("nbfc", r"FINSERV|HOUSING\s*FIN|FINCORP|HSGFIN|HOMEFIN|CREDIT|CAPITAL|MICROFIN|GOLDFIN|FINANCE\b|FIN\s*LTD\b|\bFIN$|NBFC"),
    ("it", r"\bINFOTECH|TECHNOLOG|SYSTEMS|SOFTWARE|TECH\b|INFOSYS|TCS|WIPRO|HCL"), ("pharma", r"PHARMA|DRUG|BIOTEC|HOSPITAL|HEALTHCARE|LAB(?:S|ORATORIES)|MEDIC"), ("fmcg", r"FOODS|BEVERAGE|CONSUMER\s*PROD|HOUSEHOLD|PERSONAL\s*CARE"),
    ("auto", r"MOTORS|AUTOMOB|AUTO\s*PARTS|TYRE|TYRES|CYCLES|VEHICLE"), ("metals", r"STEEL|ALUMIN|COPPER|ZINC|METAL|MINING|MINERAL|IRON\s*ORE"), ("oil_gas", r"PETROLEUM|REFINER|OIL\b|GAS\b|LNG|HYDROCARB"),
    ("power", r"POWER|ENERGY|ELECTRIC|RENEW|GRID|HYDEL"), ("realty", r"REALTY|REAL\s*EST|DEVELOPERS|PROPERT|REIT|INFRA(?:STRUCT)?"), ("telecom", r"TELECOM|TOWERS|COMMUNICAT|WIRELESS|TELESERV"),
    ("media", r"MEDIA|BROADCAST|ENTERTAIN|TELEVIS|MUSIC"), ("chemicals", r"CHEM|FERTI|PESTICID|AGROCHEM|POLYMER|RESIN|DYE"), ("cement", r"CEMENT|ASBESTOS"), ("capital_goods", r"ENGINEER|ELECTRIC|MACHINE\s*TOOL|FORGING|SHIPYARD|DEFENCE"),
    ("logistics", r"LOGISTIC|SHIPPING|PORT|AIRWAY|AIRLINE|FREIGHT|COURIER|TRANSPORT"),
)

# Starts and end of the parts of a filing, by scope.
SCOPE_STARTS = tuple(
    (scope, rf"(?i){scope} (?:balance sheet|statement of (?:profit|financial position|cash flow)|cash flow|financial statement)|audit of the {scope}|notes to (?:the )?{scope} financial") for scope in ("standalone", "consolidated")
)
FILING_END = r"(?i)notice of (?:the )?annual general meeting|notice to (?:the )?members|agm notice"
# Headings that put a scope in force for what follows.
SCOPE_HEADINGS = tuple((scope, rf"(?i){scope} (?:balance sheet|statement of (?:profit|financial position)|cash flow|financial statement)") for scope in ("consolidated", "standalone"))
SCOPE_MARK = r"\[SCOPE=([A-Z_]+)\]"
# Lines that begin a statement, and those that begin a part of a balance sheet.
STATEMENT_STARTS = (
    ("standalone", "bs", r"(?i)^(?:standalone\s+)?balance\s+sheet$"), ("consolidated", "bs", r"(?i)^consolidated\s+balance\s+sheet$"), ("standalone", "pl", r"(?i)^(?:standalone\s+)?statement\s+of\s+profit"),
    ("consolidated", "pl", r"(?i)^consolidated\s+statement\s+of\s+profit"), ("standalone", "cf", r"(?i)^(?:standalone\s+)?statement\s+of\s+cash"), ("consolidated", "cf", r"(?i)^consolidated\s+statement\s+of\s+cash"),
)
BALANCE_PARTS = (
    ("non_current_assets", r"(?i)^non.current\s+assets?$"), ("current_assets", r"(?i)^current\s+assets?$"), ("equity", r"(?i)^equity\s*:?$"), ("non_current_liabilities", r"(?i)^non.current\s+liabilit"),
    ("current_liabilities", r"(?i)^(?:total\s+)?current\s+liabilit"),
)
# Bare labels whose field depends on the part of the balance sheet.
FIELDS_BY_PART = (
    (r"(?i)^borrowings?\b", {"non_current_liabilities": "Borrowings (Non-Current)", "current_liabilities": "Borrowings (Current)"}),
    (r"(?i)^lease\s+liabilit", {"non_current_liabilities": "Lease Liabilities (Non-Current)", "current_liabilities": "Lease Liabilities (Current)"}),
    (r"(?i)^provisions?\b", {"non_current_liabilities": "Provisions (Non-Current)", "current_liabilities": "Provisions (Current)"}),
    (r"(?i)^other\s+financial\s+assets?\b", {"non_current_assets": "Other Financial Assets", "current_assets": "Other Financial Assets"}),
    (r"(?i)^other\s+(?:non.current|noncurrent)\s+assets?\b", {"non_current_assets": "Other non-current assets"}),
    (r"(?i)^investments?\b", {"non_current_assets": "Investments - equity method", "current_assets": "Other Investments"}),
)
# What a cover must not and must say, by kind of document.
COVER_REJECTS = (
    r"(?i)intimation|outcome\s+of\s+(?:the\s+)?board\s+meeting|board\s+meeting\s+outcome|notice\s+of\s+(?:meeting|board\s+meeting|postal\s+ballot)|transcript|verbatim|recording\s+of|remuneration\s+policy"
    r"|nomination\s+and\s+remuneration|whistle.?blower|code\s+of\s+conduct|loss\s+of\s+share|duplicate\s+share|appointment\s+of|resignation\s+of"
)
COVER_NEEDS = {
    "annual": r"(?i)annual\s+report|integrated\s+(?:annual\s+)?report|annual\s+accounts|notice\s+of\s+(?:the\s+)?(?:\d+\w*\s+)?annual\s+general|board['’]?s?\s+report|director['’]?s?\s+report|year\s+ended\s+(?:march|31[\s-]?march)"
    r"|(?:standalone|consolidated)\s+(?:balance\s+sheet|statement\s+of\s+profit)|management\s+discussion\s+and\s+analysis|md&a|mda|corporate\s+overview|financial\s+statements?\b|chairman['’]?s?\s+(?:message|letter|statement)|notice\s+to\s+(?:the\s+)?(?:members|shareholders)",
    "quarterly": r"(?i)statement\s+of\s+(?:unaudited|audited|standalone|consolidated).{0,30}financial\s+results?|results?\s+for\s+the\s+(?:quarter|three\s+months|half[\s-]year|year)\s+ended|(?:un)?audited\s+financial\s+results?",
    "presentation": r"(?i)investor[\s'’]+(?:presentation|deck|update|brief)|earnings\s+presentation|results?\s+presentation|q[1-4]\s*fy\d{2,4}.{0,30}(?:presentation|deck)|fy\d{2,4}\s+(?:annual\s+)?(?:results?\s+)?presentation|analyst\s+(?:day|meet)\s+presentation",
}
# Words of slides with figures.
SLIDE_WORDS = (
    "revenue", "ebitda", "pat ", "profit", "loss", "segment", "%", "₹", "rs.", "rs ", "crore", "fy2", "growth", "margin", "yoy", "qoq", "balance sheet", "cash flow", "operating", "nim", "casa", "gnpa", "advances", "deposits",
    "vnb", "ape", "persistency", "store", "sssg", "volume", "arpu", "utilization", "attrition", "units", "capacity", "plf",
)
# What a sheet needs by its name, the titles of pages that have it, and the kinds of sheets to search.
SHEET_NEEDS = (("cash_flow", ("cash flow", "cashflow")), ("balance_sheet", ("balance",)), ("quarterly", ("quarter",)), ("operating_metrics", ("operating", "metric", "segment", "ratio")))
TITLE_NEEDS = (
    ("balance_sheet", ("balance sheet", "financial position")), ("p_and_l", ("statement of p&l", "p & l", "statement of profit", "p&l")), ("cash_flow", ("cash flow",)), ("quarterly", ("quarter", "three months")),
    ("operating_metrics", ("segment", "kpi", "operating", "ratio", "schedule")),
)
SHEET_ROUTES = (
    ("P&L", ("p&l", "income statement")), ("Balance Sheet", ("balance sheet", " bs")), ("Cash Flow", ("cash flow",)), ("Operating Metrics,Quarterly,P&L,Balance Sheet", ("operating", "kpi", "metric", "ratio", "spread", "asset quality")),
    ("Quarterly,P&L,Balance Sheet,Operating Metrics", ("quarter",)),
)
# Lines of cash flow statements, tried in this order on lower-case labels.
CASH_FLOW_LINES = (
    ("cf operating", r"\bnet cash (?:flow )?(?:generated )?from operating|\bcash (?:flow )?from operating|\bcash generated from operations|\boperating activities\b"),
    ("cf investing", r"\bnet cash (?:flow )?(?:used )?in investing|\bcash (?:flow )?from investing|\binvesting activities\b"), ("cf financing", r"\bnet cash (?:flow )?(?:used )?in financing|\bcash (?:flow )?from financing|\bfinancing activities\b"),
    ("cf cash beg", r"\bcash.*beginning(?: of)?(?: the)? (?:year|period)|\bcash.*at(?: the)? beginning|\bopening (?:balance of )?cash|\bcash and bank balances? beginning"),
    ("cf cash end", r"\bcash.*end(?: of)?(?: the)? (?:year|period)|\bcash.*at(?: the)? end|\bclosing (?:balance of )?cash|\bcash and bank balances? end"),
    ("cf net change", r"\bnet (?:increase|decrease|change|change/?\(decrease\)).{0,30}in cash|\bnet increase\s+decrease.{0,30}in cash|\bnet change in cash"),
    ("cf depreciation", r"\bdepreciation and amortis(?:ation|ation expense)|\bdepreciation amortisation and impairment"), ("cf finance cost", r"\bfinance cost(?:s)?\b|\binterest expense\b"),
    ("cf working capital", r"\bworking capital changes|\bchanges in working capital"), ("cf tax paid", r"\bincome tax(?:es)? paid|\bdirect taxes? paid"),
)
# Other wordings of a label, added to a search.
WORDINGS = {
    "revenue from operations": ("revenue", "net revenue", "sales", "income from operations", "turnover"), "cost of goods sold": ("cost of materials consumed", "purchases of stock", "changes in inventories", "raw material cost"),
    "employee benefits expense": ("staff cost", "personnel cost", "salaries"), "finance cost": ("finance costs", "interest expense", "borrowing cost"), "depreciation": ("depreciation and amortisation", "depreciation amortization impairment"),
    "other income": ("other operating income", "miscellaneous income", "interest income", "dividend income"), "tax": ("tax expense", "current tax", "deferred tax", "income tax expense"),
    "diluted eps": ("diluted earnings per share", "earnings per share diluted"), "share of profit of associates": ("share of associates", "share of net profit of associates"), "property plant equipment": ("ppe", "fixed assets", "tangible assets"),
    "capital work in progress": ("cwip", "capital work-in-progress"), "intangible assets": ("intangibles", "intangible asset"), "right of use": ("rou", "rou assets", "right-of-use assets"), "inventories": ("stock", "inventory"),
    "trade receivables": ("debtors", "receivables"), "cash and cash equivalents": ("cash", "bank balances", "cash and bank"), "equity share capital": ("share capital", "issued capital"), "other equity": ("reserves and surplus", "retained earnings"),
    "borrowings": ("loans", "debt", "long-term borrowings", "short-term borrowings"), "trade payables": ("creditors", "payables", "sundry creditors"), "deferred tax": ("deferred tax liability", "deferred tax asset"),
}
