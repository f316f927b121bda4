"""Rule tables of the library: concepts, totals, identities, margins, checks and patterns.

All of it is data. Expressions are SQL over concept names that Spark compiles and Catalyst optimises; a user passes tables of the same form instead."""

from __future__ import annotations

# Concepts in order, each with the display label and the phrases that name it; the first concept in order wins.
CONCEPT_PHRASES = (
    ("revenue_from_operations", ("revenue from operations", "revenue from operation", "total revenue from operations", "net sales", "revenue from contracts with customers")),
    ("cost_of_goods_sold", ("cost of goods sold", "cost of materials consumed", "cogs", "raw materials consumed")),
    ("gross_profit", ("gross profit",)),
    ("employee_benefits_expense", ("employee benefits expense", "employee benefit expense", "employee cost", "personnel cost", "staff cost")),
    ("other_expenses", ("other expenses (net)", "other expenses", "other operating expenses")),
    ("ebitda", ("ebitda",)),
    ("depreciation_amortization", ("depreciation, amortization & impairment", "depreciation and amortisation", "depreciation and amortization", "depreciation, amortisation", "depreciation amortization", "depreciation amortisation")),
    ("ebit", ("ebit", "operating profit")),
    ("finance_cost", ("finance cost", "finance costs", "interest expense")),
    ("other_income", ("other income (net)", "other income")),
    ("share_of_associates", ("share of net profit of associates", "share of profit of associate", "share of associate", "associate profit")),
    ("exceptional_items", ("exceptional item", "exceptional")),
    ("pbt", ("profit before tax", "pbt", "profit/(loss) before tax")),
    ("tax_expense", ("total tax expense", "tax expense", "income tax expense", "less: tax")),
    ("pat", ("profit after tax", "pat", "profit/(loss) for the period", "profit for the year", "profit for the period", "net profit", "net income")),
    ("diluted_eps", ("diluted eps", "diluted earnings per share")),
    ("gross_margin", ("gross margin",)),
    ("ebitda_margin", ("ebitda margin", "ebitda %")),
    ("ppe", ("property, plant and equipment", "property plant and equipment", "property, plant & equipment", "fixed assets")),
    ("cwip", ("capital work in progress", "capital work-in-progress", "cwip")),
    ("goodwill", ("goodwill",)),
    ("intangible_assets", ("intangible asset",)),
    ("intangible_under_dev", ("intangible assets under development", "intangibles under development")),
    ("rou_assets", ("right of use asset", "right-of-use asset")),
    ("nc_investments", ("non-current investments", "investments - non-current")),
    ("other_investments", ("other investments",)),
    ("nc_other_financial_assets", ("other financial assets (non-current)", "non-current financial assets", "other non-current financial assets")),
    ("nc_income_tax_asset", ("income tax asset (net)", "income tax assets (net)", "non-current income tax asset")),
    ("deferred_tax_assets", ("deferred tax assets (net)", "deferred tax asset")),
    ("nc_other_assets", ("other non-current assets",)),
    ("inventories", ("inventories", "inventory")),
    ("c_investments", ("current investments", "investments - current")),
    ("trade_receivables", ("trade receivable",)),
    ("cash_and_equivalents", ("cash & cash equivalents", "cash and cash equivalents")),
    ("bank_balances_other", ("bank balances other than above", "other bank balances")),
    ("c_other_financial_assets", ("other financial assets (current)", "current financial assets")),
    ("c_income_tax_asset", ("income tax asset (current)",)),
    ("c_other_assets", ("other current assets",)),
    ("total_nc_assets", ("total non-current assets",)),
    ("total_c_assets", ("total current assets",)),
    ("total_assets", ("total assets",)),
    ("equity_share_capital", ("equity share capital",)),
    ("other_equity", ("other equity",)),
    ("total_equity", ("total equity",)),
    ("nc_borrowings", ("non-current borrowings", "long-term borrowings")),
    ("nc_lease_liabilities", ("lease liabilities (non-current)", "non-current lease liabilities")),
    ("nc_other_financial_liabilities", ("other non-current financial liabilities",)),
    ("nc_provisions", ("non-current provisions",)),
    ("deferred_tax_liabilities", ("deferred tax liabilities (net)", "deferred tax liability")),
    ("nc_other_liabilities", ("other non-current liabilities",)),
    ("c_borrowings", ("current borrowings", "short-term borrowings")),
    ("c_lease_liabilities", ("lease liabilities (current)", "current lease liabilities")),
    ("trade_payables_micro", ("dues of micro and small enterprises", "dues of micro")),
    ("trade_payables_others", ("dues of other creditors", "dues of others")),
    ("trade_payables_total", ("trade payables", "trade payable")),
    ("c_other_financial_liabilities", ("other financial liabilities (current)",)),
    ("c_other_liabilities", ("other current liabilities",)),
    ("c_provisions", ("current provisions",)),
    ("c_tax_liabilities", ("current tax liabilities",)),
    ("total_nc_liabilities", ("total non-current liabilities",)),
    ("total_c_liabilities", ("total current liabilities",)),
    ("total_equity_liabilities", ("total equity & liabilities", "total equity and liabilities")),
)
# Concepts of banks, lenders and insurers, and lines that only checks and identities read.
SECTOR_CONCEPTS = (
    "net_sales", "net_worth", "interest_earned", "interest_expended", "net_interest_income", "total_income", "operating_expenses", "operating_profit", "provisions",
    "deposits", "casa_deposits", "gross_npa", "net_npa", "interest_income", "gross_stage_3", "net_stage_3", "gross_written_premium", "net_written_premium",
    "total_borrowings", "enterprise_value", "market_capitalisation", "capital_employed", "cash_flow_from_operations", "capital_expenditure", "minority_interest", "gross_block", "accumulated_depreciation",
)
CONCEPTS = (*(c for c, _ in CONCEPT_PHRASES), *SECTOR_CONCEPTS)


def summed_sql(parts: tuple[str, ...], least: int) -> str:
    """Sum of the parts that are there; null with fewer than least."""
    count = " + ".join(f"case when {p} is null then 0 else 1 end" for p in parts)
    return f"case when {count} >= {least} then {' + '.join(f'coalesce({p}, 0.0)' for p in parts)} end"


def plus_minus(plus: tuple[str, ...], minus: tuple[str, ...]) -> str:
    return " ".join([" + ".join(plus), *(f"- {m}" for m in minus)])


NC_ASSETS = ("ppe", "cwip", "goodwill", "intangible_assets", "intangible_under_dev", "rou_assets", "nc_investments", "other_investments", "nc_other_financial_assets", "nc_income_tax_asset", "deferred_tax_assets", "nc_other_assets")
C_ASSETS = ("inventories", "c_investments", "trade_receivables", "cash_and_equivalents", "bank_balances_other", "c_other_financial_assets", "c_income_tax_asset", "c_other_assets")
NC_LIABILITIES = ("nc_borrowings", "nc_lease_liabilities", "nc_other_financial_liabilities", "nc_provisions", "deferred_tax_liabilities", "nc_other_liabilities")
C_LIABILITIES = ("c_borrowings", "c_lease_liabilities", "f_trade_payables_total", "c_other_financial_liabilities", "c_other_liabilities", "c_provisions", "c_tax_liabilities")
# Derived totals (concept, expression), in order of dependence; f_x is the filled value of concept x, given or derived by a rule before.
TOTALS = (
    ("gross_profit", plus_minus(("revenue_from_operations",), ("cost_of_goods_sold",))),
    ("ebitda", plus_minus(("f_gross_profit",), ("employee_benefits_expense", "other_expenses"))),
    ("ebit", plus_minus(("f_ebitda",), ("depreciation_amortization",))),
    ("pbt", "f_ebit - finance_cost + other_income + coalesce(share_of_associates, 0.0) + coalesce(exceptional_items, 0.0)"),
    ("pat", plus_minus(("f_pbt",), ("tax_expense",))),
    ("gross_margin", "f_gross_profit / nullif(revenue_from_operations, 0.0)"),
    ("ebitda_margin", "f_ebitda / nullif(revenue_from_operations, 0.0)"),
    ("total_equity", "equity_share_capital + other_equity"),
    ("trade_payables_total", summed_sql(("trade_payables_micro", "trade_payables_others"), 1)),
    ("total_nc_assets", summed_sql(NC_ASSETS, 5)),
    ("total_c_assets", summed_sql(C_ASSETS, 4)),
    ("total_assets", "f_total_nc_assets + f_total_c_assets"),
    ("total_nc_liabilities", summed_sql(NC_LIABILITIES, 3)),
    ("total_c_liabilities", summed_sql(C_LIABILITIES, 4)),
    ("total_equity_liabilities", "f_total_equity + f_total_nc_liabilities + f_total_c_liabilities"),
)
#: Derived and given value disagree beyond this share of the larger.
DISAGREE = 0.01

# Ordered identities (patterns of the target label, patterns of each input in order, expression over v0, v1, v2).
IDENTITIES = (
    (("ebit",), (("ebitda", "operating profit"), ("depreciation", "amortis", "d&a", "da ")), "v0 - abs(v1)"),
    (("ebitda", "operating profit"), (("ebit",), ("depreciation", "amortis", "d&a")), "v0 + abs(v1)"),
    (("gross profit",), (("revenue from operations", "net sales", "revenue"), ("cost of goods sold", "cogs", "cost of material", "raw material cost")), "v0 - abs(v1)"),
    (("cost of goods sold", "cogs"), (("revenue from operations", "net sales", "revenue"), ("gross profit",)), "v0 - v1"),
    (("pat", "profit after tax", "net profit"), (("pbt", "profit before tax"), ("tax", "income tax expense", "tax expense")), "v0 - abs(v1)"),
    (("pbt", "profit before tax"), (("pat", "profit after tax", "net profit"), ("tax", "income tax expense")), "v0 + abs(v1)"),
    (("ebit",), (("pbt", "profit before tax"), ("finance cost", "interest expense", "finance charges"), ("other income",)), "v0 + abs(v1) - abs(v2)"),
    (("pbt", "profit before tax"), (("ebit",), ("finance cost", "interest expense"), ("other income",)), "v0 - abs(v1) + abs(v2)"),
    (("pat (before minority", "pat before minority", "profit before minority"), (("pat", "profit after tax", "net profit"), ("minority interest", "non-controlling interest")), "v0 + abs(v1)"),
    (("minority interest", "non-controlling interest"), (("pat (before minority", "profit before minority"), ("pat", "profit after tax", "net profit")), "v0 - v1"),
    (("total income",), (("revenue from operations", "net sales"), ("other income",)), "v0 + abs(v1)"),
    (("ebitda margin", "ebitda %", "% of sales"), (("ebitda", "operating profit"), ("revenue from operations", "net sales", "revenue")), "round(v0 / nullif(v1, 0.0) * 100, 2)"),
    (("gross margin", "gross profit margin", "gpm"), (("gross profit",), ("revenue from operations", "net sales", "revenue")), "round(v0 / nullif(v1, 0.0) * 100, 2)"),
    (("pat margin", "net profit margin", "npm"), (("pat", "profit after tax", "net profit"), ("revenue from operations", "net sales", "revenue")), "round(v0 / nullif(v1, 0.0) * 100, 2)"),
    (("net block", "net fixed assets", "property plant & equipment net"), (("gross block", "gross fixed assets"), ("accumulated depreciation", "less: depreciation", "depreciation on fixed")), "v0 - abs(v1)"),
    (("net debt",), (("total borrowing", "total debt", "long-term borrowing"), ("cash and cash equivalent", "cash & equivalent")), "v0 - abs(v1)"),
    (("total assets",), (("total non-current assets", "non current assets total"), ("total current assets", "current assets total")), "v0 + v1"),
    (("free cash flow", "fcf"), (("cash from operations", "cfo", "operating activities"), ("capital expenditure", "capex", "purchase of fixed assets")), "v0 - abs(v1)"),
)
# Signed sums (target, ((component, sign), ...)), in order; the first complete one gives a target.
SIGNED_SUMS = (
    ("Gross Profit", (("Revenue From Operations", 1), ("Cost of Goods Sold", -1))),
    ("Gross Profit", (("Net Revenue", 1), ("Cost of Goods Sold", -1))),
    ("Gross Profit", (("Revenue From Operations", 1), ("COGS", -1))),
    ("EBITDA", (("Gross Profit", 1), ("Other Income", 1), ("Employee Benefit Expense", -1), ("Other Expenses", -1), ("Selling General And Admin Expenses", -1))),
    ("EBIT", (("EBITDA", 1), ("Depreciation And Amortization", -1))),
    ("EBIT", (("EBITDA", 1), ("Depreciation", -1))),
    ("EBIT", (("Revenue From Operations", 1), ("Total Operating Expenses", -1))),
    ("PBT", (("EBIT", 1), ("Finance Cost", -1), ("Other Income", 1))),
    ("PBT", (("EBIT", 1), ("Interest Expense", -1), ("Other Income", 1))),
    ("PAT", (("PBT", 1), ("Tax Expense", -1))),
    ("PAT", (("PBT", 1), ("Current Tax", -1), ("Deferred Tax", -1))),
    ("Free Cash Flow", (("Cash Flow From Operations", 1), ("Capital Expenditure", -1))),
    ("Free Cash Flow", (("CFO", 1), ("Capex", -1))),
    ("Working Capital", (("Total Current Assets", 1), ("Total Current Liabilities", -1))),
    ("Net Debt", (("Total Borrowings", 1), ("Cash And Cash Equivalents", -1))),
    ("Net Worth", (("Share Capital", 1), ("Reserves And Surplus", 1))),
    ("Net Worth", (("Total Shareholders Equity", 1),)),
    ("Capital Employed", (("Total Assets", 1), ("Total Current Liabilities", -1))),
)
# Names of revenue in the order in which they are tried, margins in percent and ratios.
REVENUE = ("Revenue From Operations", "Net Revenue", "Total Revenue", "Revenue", "Net Sales", "Total Income From Operations", "Total Net Revenue")
MARGINS = (
    ("EBITDA Margin %", "EBITDA", None), ("EBIT Margin %", "EBIT", None), ("PAT Margin %", "PAT", None), ("Gross Profit Margin %", "Gross Profit", None), ("Net Profit Margin %", "PAT", None),
    ("ROCE %", "EBIT", "Capital Employed"), ("ROE %", "PAT", "Net Worth"), ("ROA %", "PAT", "Total Assets"),
)
RATIOS = (
    ("Debt To Equity", "Total Borrowings", "Net Worth"), ("Current Ratio", "Total Current Assets", "Total Current Liabilities"), ("Interest Coverage Ratio", "EBIT", "Finance Cost"),
    ("EV/EBITDA", "Enterprise Value", "EBITDA"), ("P/E Ratio", "Market Capitalisation", "PAT"),
)


def apart(a: str, b: str, slack: float) -> str:
    """a and b differ by more than slack of the larger; two values near zero do not."""
    most = f"greatest(abs({a}), abs({b}))"
    return f"({most} >= 1e-6 and abs(({a}) - ({b})) > {slack} * {most})"


_REV, _EQUITY, _DUE = "coalesce(revenue_from_operations, net_sales)", "coalesce(total_equity, net_worth)", "(coalesce(total_nc_liabilities, 0.0) + coalesce(total_c_liabilities, 0.0))"
_LENT, _GROSS3, _NET3 = "coalesce(interest_income, revenue_from_operations)", "coalesce(gross_stage_3, gross_npa)", "coalesce(net_stage_3, net_npa)"
# Checks (query, sector or None for all, rule, concept blamed, severity, condition, value suggested).
CHECKS = (
    ("v05_ebitda_over_revenue", None, "ebitda_gt_rev", "ebitda", "high", f"ebitda > {_REV}", None),
    ("v06_ebit_over_ebitda", None, "ebit_gt_ebitda", "ebit", "high", "ebit > ebitda + 1", None),
    ("v07_pat_over_pbt", None, "pat_gt_pbt", "pat", "medium", "pbt > 0 and pat > pbt + 1", None),
    ("v08_balance", None, "bs_imbalance", "total_assets", "high", f"{_DUE} > 0 and {apart('total_assets', f'{_EQUITY} + {_DUE}', 0.02)}", None),
    ("v09_bank_interest", "bank", "nii_identity", "net_interest_income", "medium", apart("interest_earned - interest_expended", "net_interest_income", 0.05), "interest_earned - interest_expended"),
    ("v10_bank_income", "bank", "total_income_identity", "total_income", "medium", apart("net_interest_income + other_income", "total_income", 0.05), "net_interest_income + other_income"),
    ("v11_bank_operating", "bank", "op_identity", "operating_profit", "medium", apart("total_income - operating_expenses", "operating_profit", 0.05), "total_income - operating_expenses"),
    ("v12_bank_pbt", "bank", "pbt_identity", "pbt", "medium", apart("operating_profit - provisions", "pbt", 0.05), "operating_profit - provisions"),
    ("v13_casa", "bank", "casa_gt_deposits", "casa_deposits", "high", "casa_deposits > deposits + 1", None),
    ("v14_npa", "bank", "nnpa_gt_gnpa", "net_npa", "high", "net_npa > gross_npa + 0.5", None),
    ("v15_stage3", "nbfc", "nbfc_nii_identity", "net_interest_income", "medium", apart(f"{_LENT} - finance_cost", "net_interest_income", 0.05), f"{_LENT} - finance_cost"),
    ("v15_stage3", "nbfc", "ns3_gt_gs3", "net_stage_3", "high", f"{_NET3} > {_GROSS3} + 0.5", None),
    ("v16_premium", "insurance", "nwp_gt_gwp", "net_written_premium", "high", "net_written_premium > gross_written_premium + 1", None),
)
# The waterfall (upper, lower), lines that must not be negative, and bounds of the margin in percent.
WATERFALL = ((_REV, "ebitda", "revenue"), ("ebitda", "ebit", "ebitda"), ("ebit", "pbt", "ebit"), ("pbt", "pat", "pbt"))
NOT_NEGATIVE = (("revenue", _REV), ("depreciation_amortization", "depreciation_amortization"), ("finance_cost", "finance_cost"), ("tax_expense", "tax_expense"))
MARGIN_BOUNDS = (-30, 70)
TOOL_CHECKS = (
    ("EBITDA", "high", f"ebitda > {_REV}"), ("EBIT", "high", "ebit > ebitda"), ("PBT", "medium", "abs(pbt) > 2 * abs(ebit)"), ("PAT", "medium", "pbt > 0 and pat > pbt"),
    ("Balance Sheet", "high", "abs(total_assets - (total_nc_liabilities + total_c_liabilities + total_equity)) > total_assets * 0.02"),
)
