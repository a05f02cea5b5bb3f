"""Labelled fields of a document's text as Column functions: identifiers, amounts, statement rows, probes.

All are built-in expressions. Null text gives null (probes too); a field that isn't found is null. Classes such as
`\\s` and `\\d` are ASCII, as everywhere in the engine's expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint.functions.text import DATE, EMAIL, plain_number, strip

# Patterns whose matches are part of the results.
PHONE = r"\+?[\d\s\-\(\)]{7,15}(?=\s|$)"
TAX_ID = r"(?i)\b(?:VAT|GST|EIN|TIN)\s*(?:No\.?|Number|#)?\s*[:\-]?\s*([A-Z0-9]{5,20})\b"
INVOICE_NUMBER = r"(?i)(?:Invoice\s*(?:No\.?|Number|#)\s*[:\-]?\s*)([A-Z0-9\-]+)"
PO_NUMBER = r"(?i)(?:P\.?O\.?\s*(?:No\.?|Number|#)\s*[:\-]?\s*)([A-Z0-9\-]+)"
CURRENCY_CODE = r"\b(USD|GBP|EUR|CAD|AUD|INR|SGD)\b"
CURRENCY_SYMBOL = r"(£|\$|€)"
AMOUNT_LABELS = {
    "subtotal": r"(?:sub\s*[-]?total|net\s+amount)",
    "tax_amount": r"(?:tax|vat|gst)(?:\s+amount)?(?:\s+\d+%)?",
    "discount": r"discount",
    "total_amount": r"(?:total\s+(?:amount\s+)?due|total\s+payable|amount\s+due|grand\s+total|total)",
}
#: Words of which a text with the label has one.
AMOUNT_WORDS = {"subtotal": ("sub", "net"), "tax_amount": ("tax", "vat", "gst"), "discount": ("discount",), "total_amount": ("total", "amount")}
AMOUNT_TAIL = r"[:\s]*([£\$€]?\s*[\d,]+(?:\.\d{1,2})?)"
BANK = {
    "bank_name": r"(?i)(?:bank\s*name|bank)[:\s]+([A-Za-z\s&]+?)(?:\n|,|$)",
    "account_number": r"(?i)(?:account\s*(?:no\.?|number|#))[:\s]+([\d\s\-]+)",
    "sort_code": r"(?i)sort\s*code[:\s]+([\d\-]+)",
    "iban": r"(?i)\b((?:[A-Z]{2}\d{2}[\s\-]?){4,}[A-Z0-9]*)\b",
    "swift": r"(?i)\b(?:SWIFT|BIC)[:\s]+([A-Z]{6}[A-Z0-9]{2,5})\b",
}
BANK_WORDS = {"bank_name": ("bank",), "account_number": ("account",), "sort_code": ("sort",), "swift": ("swift", "bic")}
STATEMENT_LABELS = {
    "income_statement": {
        "revenue": ("revenue", "total revenue", "net revenue", "sales", "turnover"),
        "cost_of_goods_sold": ("cost of goods sold", "cogs", "cost of sales", "cost of revenue"),
        "gross_profit": ("gross profit",),
        "operating_expenses": ("operating expenses", "opex", "total operating expenses"),
        "ebitda": ("ebitda",),
        "ebit": ("ebit", "operating income", "operating profit"),
        "interest_expense": ("interest expense", "finance costs", "finance charges"),
        "tax_expense": ("income tax", "tax expense", "provision for taxes"),
        "net_income": ("net income", "net profit", "net earnings", "profit after tax", "profit for the year"),
        "earnings_per_share": ("earnings per share", "eps", "basic eps", "diluted eps"),
    },
    "balance_sheet": {
        "total_assets": ("total assets",),
        "current_assets": ("total current assets", "current assets"),
        "cash_and_equivalents": ("cash and cash equivalents", "cash & equivalents", "cash"),
        "accounts_receivable": ("accounts receivable", "trade receivables"),
        "inventory": ("inventory", "inventories"),
        "total_liabilities": ("total liabilities",),
        "current_liabilities": ("total current liabilities", "current liabilities"),
        "accounts_payable": ("accounts payable", "trade payables"),
        "long_term_debt": ("long-term debt", "long term debt", "long-term borrowings"),
        "total_equity": ("total equity", "shareholders equity", "stockholders equity", "net assets"),
        "retained_earnings": ("retained earnings",),
    },
    "cash_flow": {
        "operating_cash_flow": ("operating activities", "cash from operations", "net cash from operating"),
        "investing_cash_flow": ("investing activities", "cash used in investing"),
        "financing_cash_flow": ("financing activities", "cash from financing"),
        "free_cash_flow": ("free cash flow",),
        "capital_expenditures": ("capital expenditures", "capex", "purchase of property", "additions to property"),
    },
}
ROW_TAIL = r"\b.*?([\(\-]?\s*[\d,]+(?:\.\d+)?\s*\)?)"
HAS_INCOME = r"(?i)\b(?:revenue|net\s+income|gross\s+profit)\b"
HAS_BALANCE = r"(?i)\b(?:total\s+assets|total\s+liabilities|equity)\b"
HAS_CASH_FLOW = r"(?i)\b(?:operating\s+activities|investing\s+activities)\b"
AUDITED = r"(?i)\baudited\b|\bindependent\s+auditor\b"
AUTO_RENEWAL = r"(?i)\bauto(?:matically)?\s*renew(?:s|ed|al)?\b|\brenews?\s+automatically\b"
SIGNED = r"(?i)\bsignature[s]?\b|\bsigned\s+by\b|\b(?:IN\s+WITNESS|EXECUTED)\b"
SIGNED_NDA = r"(?i)\bsignature[s]?\b|\bsigned\s+by\b"
MUTUAL = r"(?i)\bmutual\b|\bbilateral\b|\bboth\s+parties\s+(?:agree|shall)\b"
MANDATORY = r"(?i)\b(?:must|shall|required|mandatory)\b"
UNIT = r"(?i)(?:in|expressed\s+in)\s+(thousands?|millions?|billions?)"
PERIOD = r"(?i)(?:year|period|quarter)\s+ended?\s+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[\/\-]\d{1,2}[\/\-]\d{4})"
RFP_TITLE = r"(?i)(?:Request\s+for\s+Proposal|RFP)[:\s]+(.{5,120}?)(?:\n|$)"
RFP_NUMBER = r"(?i)RFP\s*(?:No\.?|Number|#|Ref\.?)[:\s]+([\w\-\/]+)"
RFP_DEADLINE = r"(?i)(?:submission\s+deadline|proposals?\s+(?:must\s+be\s+)?(?:received|submitted)\s+by)[:\s]+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4}[^\n]{0,30})"
RFP_BUDGET = r"(?i)(?:budget|contract\s+value|estimated\s+value)[:\s]+([\$£€]?\s*[\d,]+(?:\.\d+)?(?:\s*(?:million|k))?)"
CRITERIA = r"(?is)(?:evaluation\s+criteria?|scoring\s+criteria?)[:\n](.{50,800}?)(?:\n\n|\z)"
FACT = r"(?m)^([A-Z][A-Za-z\s]{2,50}?)\s*:\s*(.{3,200}?)$"


def holds(text: Column, *words: str, low: Column | None = None) -> Column:
    """Whether a text has one of some words, whatever the case: a cheap test before a pattern that can't match without. low: the text in
    lower case, where it is at hand."""
    low = F.lower(text) if low is None else low
    return reduce(Column.__or__, (low.contains(w) for w in words))


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """What a group of the first match holds, trimmed; null without a match."""
    # nullif would run the pattern twice.
    return F.get(F.array_remove(F.array(strip(F.regexp_extract(text, pattern, n))), ""), F.lit(0))


def email(text: Column, nth: int) -> Column:
    """The nth address, from 1, or from the end, from -1."""
    return F.when(text.contains("@"), F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b" + EMAIL + r"\b"), F.lit(0)), F.lit(nth)))


def phone(text: Column) -> Column:
    """The first run of 7 to 15 digits, blanks, dashes and brackets, trimmed: empty where it is blank all through."""
    return strip(F.regexp_substr(text, F.lit(PHONE)))


def currency(text: Column) -> Column:
    return F.coalesce(group(text, CURRENCY_CODE), group(text, CURRENCY_SYMBOL))


def labelled_amount(text: Column, field: str, low: Column | None = None) -> Column:
    """The amount after the first place of a label, which has no scale. `total` has no boundary before it, so `Subtotal: 100` answers for it too."""
    where, pattern = (text, "(?i)" + AMOUNT_LABELS[field]) if low is None else (low, AMOUNT_LABELS[field])
    return F.when(holds(text, *AMOUNT_WORDS[field], low=low), plain_number(F.regexp_extract(where, pattern + AMOUNT_TAIL, 1)))


def bank(text: Column, field: str, low: Column | None = None) -> Column:
    found = group(text, BANK[field])
    return F.when(holds(text, *BANK_WORDS[field], low=low), found) if field in BANK_WORDS else found


def total_from_whole_word(text: Column) -> Column:
    """The total whose label doesn't stand within another word."""
    return plain_number(F.regexp_extract(text, r"(?i)(?<![a-z\-])" + AMOUNT_LABELS["total_amount"] + AMOUNT_TAIL, 1))


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), F.lit(0))


def statement_row(text: Column, labels: tuple[str, ...], low: Column | None = None) -> Column:
    """First number after the first label that a line holds, brackets as minus; a label whose match is no number passes on."""
    found = []
    for label in labels:
        raw = F.regexp_extract(text, r"(?imd)^.*\b" + label.replace("-", r"\-") + ROW_TAIL, 1)
        value = F.translate(F.replace(F.nullif(raw, F.lit("")), F.lit("("), F.lit("-")), "), ", "").try_cast("double")
        found.append(F.when(holds(text, label, low=low), value))
    return F.coalesce(*found)


def statement_type(text: Column) -> Column:
    income, balance, flow = text.rlike(HAS_INCOME), text.rlike(HAS_BALANCE), text.rlike(HAS_CASH_FLOW)
    return F.when(income & balance, "combined").when(income, "income_statement").when(balance, "balance_sheet").when(flow, "cash_flow_statement").otherwise("other")


def first_sentence(text: Column, chars: int = 150) -> Column:
    return F.substring(F.split(strip(text), r"(?<=[.!?])\s+")[0], 1, chars)


def title_case(name: Column) -> Column:
    """payment_terms as Payment Terms."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def money_text(amount: Column) -> Column:
    """$1,234.50"""
    return F.concat(F.when(amount < 0, "$-").otherwise("$"), F.format_number(F.abs(amount), 2))


def fixed_text(x: Column, decimals: int) -> Column:
    """1234.50: so many decimals, halves of the binary value to even, no groups."""
    return F.call_function("format_number", x.cast("double"), F.lit("0" + ("." + "0" * decimals if decimals else "")))


def grouped_text(x: Column) -> Column:
    """1,234: whole, in groups of three."""
    return F.call_function("format_number", x.cast("double"), F.lit("#,##0"))


def percent_text(x: Column, decimals: int = 1) -> Column:
    return F.concat(fixed_text(x, decimals), F.lit("%"))


def float_text(x: Column) -> Column:
    """A double in the shortest way: 2.0, 0.5, 12345678.5; without an exponent below 1e16."""
    x = x.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16)
    plain = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(whole, F.concat(x.cast("long").cast("string"), F.lit(".0"))).when((F.abs(x) >= 1e7) | (F.abs(x) < 1e-3), plain).otherwise(x.cast("string"))


def new_id(prefix: str, *key: str) -> Column:
    """prefix and 8 hexadecimal digits: of the key's hash, so that a task that runs again gives the same; at random without a key."""
    if key:
        return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *key), 256), 1, 8))
    return F.concat(F.lit(prefix), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))


def around(text: Column, pattern: str, before: int, after: int, cap: int = 200) -> Column:
    """The text around the first match, trimmed and capped; null without a match."""
    at, hit = F.regexp_instr(text, F.lit(pattern)), F.regexp_substr(text, F.lit(pattern))
    start = F.greatest(at - F.lit(1 + before), F.lit(0))
    piece = F.substr(text, start + 1, at - 1 + F.char_length(hit) + after - start)
    return F.when(hit.isNotNull(), F.substring(strip(piece), 1, cap))


def first_line(text: Column) -> Column:
    """A name up to its first line end."""
    return F.regexp_replace(text, r"(?s)\n.*", "")
