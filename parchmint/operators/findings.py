"""Anomaly rules as Column functions: each gives a finding, a struct of FIELDS, or null, from the fields that it judges.

Rules over tables (operators.rules) explode them; the run over whole documents (operators.analysis) gathers them in the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint import dims
from parchmint.functions.fields import fixed_text, float_text, grouped_text, percent_text, title_case
from parchmint.functions.text import parse_date_loose, parse_days

FIELDS = ("title", "severity", "category", "explanation", "evidence", "clause_type")
TOLERANCE = 0.11
_MONEY = "decimal(18,2)"
_KEPT: ContextVar[tuple[str, ...]] = ContextVar("kept", default=FIELDS)


@contextmanager
def keeping(fields: tuple[str, ...]) -> Iterator[None]:
    """Rules written within give findings of these fields only: who counts findings has none of their texts made."""
    token = _KEPT.set(fields)
    try:
        yield
    finally:
        _KEPT.reset(token)


def _say(*parts: str | Column) -> Column:
    """Texts and columns joined; null if one is."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def found(test: Column, *values: str | Column | None) -> Column:
    """A finding of FIELDS, or of those kept, where the test holds."""
    columns = [F.lit(v).cast("string") if v is None or isinstance(v, str) else v for v in values]
    return F.when(test, F.struct(*(c.alias(n) for c, n in zip(columns, FIELDS, strict=True) if n in _KEPT.get())))


def these(*rules: Column) -> Column:
    """What applies of some findings, as an array in order."""
    return F.array_compact(F.array(*rules))


def amount(c: Column) -> Column:
    """Money in cents, null as 0."""
    return F.coalesce(c, F.lit(0.0)).cast(_MONEY)


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


# Titles, severities, categories and texts of the findings.


def line_math(quantity: Column, price: Column, total: Column, description: Column, strict: bool = False) -> Column:
    n = F.coalesce(F.nullif(quantity, F.lit(0.0)), F.lit(1.0))
    # Rounding is dear: what is off by less than the tolerance and half a unit of the last place needs none.
    most, gap = 0.1 if strict else TOLERANCE, n * price - total
    off = (F.abs(gap) > most - 1e-6) & (F.abs(F.round(gap, 6)) > most)
    shown = F.when(F.coalesce(quantity, F.lit(0.0)) == 0, "1").otherwise(float_text(quantity))
    if strict:
        text = _say("The quantity (", shown, ") multiplied by unit price (", float_text(price), ") does not equal the stated line amount (", float_text(total), ").")
    else:
        text = _say("Quantity (", shown, ") × unit price (", fixed_text(price, 2), ") = ", fixed_text(n * price, 2), ", but stated amount is ", fixed_text(total, 2), ".")
    return found((price > 0) & (total > 0) & off, "Line Item Math Mismatch", "critical", "Financial", text, description, "line_items")


def zero_amount(price: Column, total: Column, description: Column) -> Column:
    none = (F.coalesce(price, F.lit(0.0)) == 0) & (F.coalesce(total, F.lit(0.0)) == 0) & ~_blank(description)
    text = "A line item has no price or amount. This may be intentional (complimentary item) or a data entry error."
    return found(none, "Zero-Amount Line Item", "informational", "Financial", text, description, "line_items")


def duplicate_line(repeated: Column, description: Column, strict: bool = False) -> Column:
    text = "This line item appears to be billed multiple times identically." if strict else "An identical line item (same description and amount) appears more than once."
    return found(repeated & ~_blank(description), "Duplicate Line Item", "warning", "Operational" if strict else "Financial", text, description, "line_items")


def _slack(strict: bool) -> Column:
    return F.lit("0.10" if strict else "0.11").cast(_MONEY)


def subtotal(line_sum: Column, stated: Column, strict: bool = False) -> Column:
    cents, show = amount(stated), (float_text if strict else lambda x: fixed_text(x, 2))
    summed = _say("The sum of the line items (" if strict else "Sum of line items (", show(line_sum), ") does not match ", "the " if strict else "", "stated subtotal (", show(cents), ").")
    evidence = _say("Calculated: ", show(line_sum), ", Stated: ", show(cents))
    return found((cents > 0) & (F.abs(line_sum - cents) > _slack(strict)), "Subtotal Reconciliation Failed", "critical", "Financial", summed, evidence, "subtotal")


def total(line_sum: Column, stated: Column, tax: Column, discount: Column, whole: Column, strict: bool = False) -> Column:
    base = amount(stated) if strict else F.coalesce(F.nullif(amount(stated), F.lit(0).cast(_MONEY)), line_sum)
    expected = base + amount(tax) - amount(discount)
    off, two = (amount(whole) > 0) & (F.abs(expected - amount(whole)) > _slack(strict)), lambda x: fixed_text(x, 2)
    if strict:
        text = "Subtotal plus tax minus discount does not equal the final total amount."
        return found(off, "Total Reconciliation Failed", "critical", "Financial", text, _say("Stated Total: ", float_text(whole)), "total_amount")
    text = _say("Subtotal (", two(base), ") + Tax (", two(amount(tax)), ") − Discount (", two(amount(discount)), ") = ", two(expected), ", but stated total is ", two(amount(whole)), ".")
    return found(off, "Total Amount Reconciliation Failed", "critical", "Financial", text, _say("Expected: ", two(expected), ", Stated: ", two(amount(whole))), "total_amount")


def days_late(due: Column, as_of: Column, is_text: bool) -> Column:
    return F.datediff(as_of, parse_date_loose(due) if is_text else due)


def overdue(due: Column, late: Column) -> Column:
    """late: days_late."""
    text = _say("The due date (", due.cast("string"), ") is ", late.cast("string"), " day(s) in the past.")
    return found(late > 0, "Invoice Overdue", "critical", "Financial", text, due.cast("string"), "due_date")


def missing_due(due: Column) -> Column:
    return found(_blank(due), "Missing Due Date", "warning", "Financial", "No payment due date is specified on this invoice.", "due_date: absent", "due_date")


def missing_vendor(name: Column) -> Column:
    text = "No vendor name is present on this invoice. Accounting attribution is impossible."
    return found(_blank(name), "Missing Vendor Name", "warning", "Compliance", text, "vendor.name: absent", None)


def missing_clause(test: Column, kind: str | Column, severity: str | Column, category: str | Column) -> Column:
    """kind: a clause type, as a constant or as a column of types."""
    named = F.lit(kind) if isinstance(kind, str) else kind
    text = dims.MISSING_TEXTS[kind] if isinstance(kind, str) else F.coalesce(*(F.when(named == k, v) for k, v in dims.MISSING_TEXTS.items()))
    return found(test, _say("Missing Clause: ", title_case(named)), severity, category, text, "Clause not found in document.", named)


def no_law(law: Column, nda: bool = False) -> Column:
    text = "No governing law is specified in this NDA. Enforcement jurisdiction is undefined." if nda else "No governing law is specified. It is unclear which jurisdiction's laws apply."
    return found(_blank(law), "Missing Governing Law", "warning", "Legal", text, "governing_law: absent" if nda else "No governing law field extracted.", None)


def short_notice(value: Column) -> Column:
    days = parse_days(value)
    text = _say("The notice period is only ", days.cast("string"), " day(s). Industry standard is at least 30 days, giving parties inadequate time to make arrangements.")
    return found(days < 30, "Unusually Short Notice Period", "warning", "Legal", text, value, "notice_period")


def long_terms(value: Column) -> Column:
    days = parse_days(value)
    text = _say("Payment terms of ", days.cast("string"), " days exceed the typical 90-day maximum, creating significant cash-flow risk for the payee.")
    return found(days > 90, "Extended Payment Terms", "warning", "Financial", text, value, "payment_terms")


def renewal_without_exit(test: Column) -> Column:
    text = (
        "The contract auto-renews but no explicit opt-out window or termination-for-convenience clause is present. A party could be locked in for another full term unintentionally."
    )
    return found(test, "Auto-Renewal Without Explicit Opt-Out", "warning", "Operational", text, "auto_renewal: true, termination_for_convenience: absent", "auto_renewal")


def no_ip_clause(test: Column) -> Column:
    text = "A payment amount is defined but neither an IP assignment nor IP license clause was found. Ownership of work product is ambiguous."
    return found(test, "No IP Ownership Clause", "informational", "Legal", text, "ip_assignment: absent, ip_license: absent", None)


def secrecy_length(value: Column) -> Column:
    """Secrecy without an end, or of over five years."""
    low = F.lower(value)
    endless = low.contains("perpetual") | low.contains("indefinite") | low.contains("no expir")
    forever = "The confidentiality obligation is stated as perpetual or indefinite. This may be unenforceable in some jurisdictions and creates an indefinite burden."
    long = _say("The confidentiality period of ", value, " exceeds 5 years, which may be difficult to enforce.")
    return F.coalesce(
        found(endless, "Perpetual Confidentiality Obligation", "warning", "Legal", forever, value, "confidentiality_period"),
        found((value != "") & (parse_days(value) > 365 * 5), "Very Long Confidentiality Period", "informational", "Legal", long, value, "confidentiality_period"),
    )


def one_sided(test: Column) -> Column:
    text = "This NDA is unilateral (one party discloses, one receives). Ensure the receiving party's permitted use is clearly scoped."
    return found(test, "One-Sided NDA — Limited Receiving-Party Protections", "informational", "Legal", text, "mutual: false", None)


def statement(get) -> Column:
    """Findings of a statement and its ratios, as an array. get: name of a field -> its Column."""
    equity, assets, owed, revenue, income = (get(k) for k in ("total_equity", "total_assets", "total_liabilities", "revenue", "net_income"))
    current, debt, margin = (get(k) for k in ("current_ratio", "debt_to_equity", "gross_margin_pct"))
    loss, both, whole = F.abs(income) / F.nullif(revenue, F.lit(0.0)) * 100, owed + equity, grouped_text
    return these(
        found(
            equity < 0, "Negative Equity (Technical Insolvency)", "critical", "Financial",
            _say("Total equity is negative (", whole(equity), "), indicating total liabilities exceed total assets. This is a technical insolvency signal."), _say("total_equity: ", whole(equity)), None,
        ),
        found(
            current < 1, "Low Current Ratio", "warning", "Financial",
            _say("Current ratio of ", fixed_text(current, 2), " indicates current liabilities exceed current assets. The entity may struggle to meet short-term obligations."),
            _say("current_ratio: ", fixed_text(current, 2)), None,
        ),
        found(
            debt > 3, "High Debt-to-Equity Ratio", "warning", "Financial",
            _say("Debt-to-equity ratio of ", fixed_text(debt, 2), " is above the typical threshold of 3.0, indicating high financial leverage."), _say("debt_to_equity: ", fixed_text(debt, 2)), None,
        ),
        found(
            margin < 0, "Negative Gross Margin", "critical", "Financial",
            _say("Gross margin of ", percent_text(margin), " means the entity is selling goods/services below their direct cost."), _say("gross_margin_pct: ", percent_text(margin)), None,
        ),
        found(
            (revenue > 0) & (income < 0) & (loss > 20), "Large Net Loss Relative to Revenue", "warning", "Financial",
            _say("Net loss is ", percent_text(loss), " of revenue, which is unusually large and may indicate structural cost problems."),
            _say("net_income: ", whole(income), ", revenue: ", whole(revenue)), None,
        ),
        found(
            (assets > 0) & (F.abs(assets - both) / F.nullif(assets, F.lit(0.0)) > 0.02), "Balance Sheet Does Not Balance", "critical", "Financial",
            _say("Total assets (", whole(assets), ") ≠ Total liabilities (", whole(owed), ") + Equity (", whole(equity), ") = ", whole(both), ". This suggests extraction error or misstatement."),
            _say("Δ = ", whole(F.abs(assets - both))), None,
        ),
        found(
            get("audited") == F.lit(False), "Unaudited Financial Statement", "informational", "Compliance",
            "This financial statement does not appear to be independently audited. Figures should be treated as management representations.", "audited: false", None,
        ),
    )


def missing_deadline(deadline: Column) -> Column:
    text = "No submission deadline is specified. Vendors cannot determine when proposals are due."
    return found(_blank(deadline), "Missing Submission Deadline", "critical", "Compliance", text, "submission_deadline: absent", None)


def missing_contact(email: Column, phone: Column) -> Column:
    text = "No contact email or phone number is present. Vendors have no way to submit clarification questions."
    return found(_blank(email) & _blank(phone), "Missing Contact Information", "warning", "Operational", text, "contact.email: absent, contact.phone: absent", None)


def weights(summed: Column) -> Column:
    """summed: the sum of the weights that are stated, null without any."""
    per_cent = percent_text(summed, 0)
    text = _say("The stated evaluation criteria weights sum to ", per_cent, ", not 100%. This creates scoring ambiguity.")
    return found(F.abs(summed - 100) > 2, "Evaluation Criteria Weights Don't Sum to 100%", "warning", "Compliance", text, _say("Sum of weights: ", per_cent), None)
