"""Documents of all six types rendered into one table, and queries that take them from text to record, with SQL from the same facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint import dims
from parchmint.operators import analysis
from parchmint.operators.records import NO_FIELDS
from parchmint.plans import extraction_queries as eq
from parchmint.plans import fixtures as fx
from parchmint.plans.queries import AS_OF, query

#: Lines of a page.
PAGE = 6
#: Sections of a rendered agreement of secrecy: (type, heading, body).
NDA_SECTIONS = (
    ("confidentiality_definition", "Definition", "Secrets are what is marked as such."),
    ("confidentiality_period", "Duration Of", "Kept {p}."),
    ("exclusions", "Exclusions", "Public facts are free."),
    ("remedies", "Remedies", "A court may stop a breach."),
    ("return_or_destruction", "Return Of Information", "Papers go back on demand."),
)
PERIODS = ("for a perpetual 99 years", "for 7 years in all", "for 24 months", "without end", "for 6 years")


def _paged(text):
    """Elements of a text: its lines, PAGE a page."""
    none = lambda t: F.lit(None).cast(t)
    return F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(
        F.floor(i / PAGE).cast("int").alias("page_no") + 1, i.alias("el_no"), F.lit("paragraph").alias("type"), line.alias("text"), none("array<string>").alias("items"),
        none("array<string>").alias("headers"), none("array<array<string>>").alias("rows"),
    )).cast(f"array<{analysis.ELEMENT}>")


def contract_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("doc_id"), F.col("text")
    t = F.when(k % 4 == 0, F.replace(t, F.lit("Between the parties."), F.lit("It renews automatically."))).otherwise(t)
    return fx.contracts(spark, sf_dir).select("doc_id", F.when(k % 6 == 0, F.replace(t, F.lit("governed by the laws of"), F.lit("silent on the law of"))).otherwise(t).alias("full_text"))


def nda_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    parts = [F.lit("NON DISCLOSURE AGREEMENT"), F.when(k % 2 == 0, "Both parties shall keep secrets.").otherwise("One party keeps secrets.")]
    for i, (_, head, body) in enumerate(NDA_SECTIONS):
        said = F.replace(F.lit(f"{head}\n{body}"), F.lit("{p}"), F.element_at(F.array(*map(F.lit, PERIODS)), (k % len(PERIODS) + 1).cast("int")))
        parts.append(F.when(k % 6 != i, said))
    parts.append(F.when(k % 3 != 0, "Law\nThis is governed by the laws of Utopia.").otherwise("Law\nNone is named."))
    return fx.spread(fx.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.cast("long").alias("doc_id"), F.concat_ws("\n", *parts).alias("full_text"))


def invoice_heads(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """Texts of invoices with dates in three forms; one in four has no due date. wanted: doc_id of those that are rendered, all without it."""
    k = F.col("doc_id")
    form = lambda d: F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    due = F.when(k % 4 != 0, F.concat(F.lit(" due "), form("due_date"))).otherwise("")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    text = F.concat_ws(
        "\n", F.lit("INVOICE"), F.concat(F.lit("Invoice No: INV-"), k.cast("string")), F.concat(F.lit("Issued "), form("invoice_date"), due),
        F.concat(F.lit("Grand Total: "), money("total_amount")), F.concat(F.lit("Subtotal: "), money("subtotal")), F.lit("Tax: 0.00"), F.lit("Amounts in EUR"),
    )
    header = fx.invoice_header(spark, sf_dir)
    header = header if wanted is None else header.join(wanted, "doc_id", "left_semi")
    return header.select("doc_id", fx.once(text).alias("full_text"))


def invoice_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their texts, and the lines of the order as a table."""
    table = eq.invoice_tables(spark, sf_dir)
    cells = F.array(F.struct(*(F.col(c) for c in ("page_no", "el_no", "type", "text", "items", "headers", "rows")))).cast(f"array<{analysis.ELEMENT}>")
    return invoice_heads(spark, sf_dir).join(table.select("doc_id", cells.alias("elements")), "doc_id", "left")


def other_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are with a line of fact; one in fifty is blank."""
    k = F.col("doc_id")
    return fx.spread(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.when(k % 50 == 0, " \n").otherwise(F.concat(F.lit("Reference: R"), k.cast("string"), F.lit("\n"), "text")).alias("full_text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (type and key), doc_type, full_text, elements of documents of all types."""
    kinds = {
        "contract": contract_docs(spark, sf_dir), "nda": nda_docs(spark, sf_dir), "invoice": invoice_docs(spark, sf_dir), "financial_statement": eq.statement_texts(spark, sf_dir),
        "rfp": eq.rfp_texts(spark, sf_dir), "other": other_docs(spark, sf_dir),
    }
    named = []
    for kind, rows in kinds.items():
        elements = F.col("elements") if "elements" in rows.columns else _paged(F.col("full_text"))
        named.append(rows.select(F.concat(F.lit(f"{kind}-"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit(kind).alias("doc_type"), "full_text", elements.alias("elements")))
    # Rendered once: what reads a text several times doesn't render it each time.
    return reduce(DataFrame.unionByName, named).withColumn("full_text", fx.once(F.col("full_text")))


def analysed(spark: SparkSession, sf_dir: str, **kept) -> DataFrame:
    return analysis.analyse(documents(spark, sf_dir), AS_OF, fuzzy=False, **kept)


#: What points and counts are made of.
COUNTED = ("severity", "category")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _row(rule: str, title, severity, category, text, evidence, clause_type, table: str, test: str = "true", line: str = "0") -> str:
    """A finding in SQL; texts in quotes are expressions already."""
    return f"SELECT {rule} AS r, {line} AS l, id, {title}, {severity}, {category}, {text}, {evidence}, {clause_type} FROM {table} WHERE {test}"


def _findings_sql() -> str:
    q = _quoted
    head = {
        "payment_terms": "k % 7 = 0", "payment_amount": "false", "termination_for_cause": "k % 7 = 2", "liability_cap": "k % 7 = 4", "confidentiality": "k % 7 = 5", "warranty": "k % 7 = 6", "force_majeure": "false",
    }
    named = lambda t: q("Missing Clause: " + " ".join(w.capitalize() for w in t.split("_")))
    gone = lambda i, t, s, c, table, test: _row(str(i), named(t), q(s), q(c), q(dims.MISSING_TEXTS[t]), q("Clause not found in document."), q(t), table, test)
    rows = [gone(i, t, s, c, "con", head.get(t, "true")) for i, (t, s, c) in enumerate(dims.CONTRACT_REQUIRED)]
    rows += [
        _row("20", q("Missing Governing Law"), "'warning'", "'Legal'", q("No governing law is specified. It is unclear which jurisdiction's laws apply."), q("No governing law field extracted."), "NULL", "con", "k % 6 = 0"),
        _row("21", q("Unusually Short Notice Period"), "'warning'", "'Legal'",
             "'The notice period is only ' || (5 + k % 60) || ' day(s). Industry standard is at least 30 days, giving parties inadequate time to make arrangements.'", "'Give ' || (5 + k % 60) || ' days'", "'notice_period'", "con", "k % 7 <> 3 AND 5 + k % 60 < 30"),
        _row("22", q("Extended Payment Terms"), "'warning'", "'Financial'",
             "'Payment terms of ' || (10 + k % 110) || ' days exceed the typical 90-day maximum, creating significant cash-flow risk for the payee.'", "'payable within ' || (10 + k % 110) || ' days'", "'payment_terms'", "con", "k % 7 <> 0 AND 10 + k % 110 > 90"),
        _row("23", q("Auto-Renewal Without Explicit Opt-Out"), "'warning'", "'Operational'",
             q("The contract auto-renews but no explicit opt-out window or termination-for-convenience clause is present. A party could be locked in for another full term unintentionally."),
             q("auto_renewal: true, termination_for_convenience: absent"), "'auto_renewal'", "con", "k % 4 = 0"),
        _row("24", q("No IP Ownership Clause"), "'informational'", "'Legal'",
             q("A payment amount is defined but neither an IP assignment nor IP license clause was found. Ownership of work product is ambiguous."), q("ip_assignment: absent, ip_license: absent"), "NULL", "con"),
    ]
    order = {t: i for i, (t, _, _) in enumerate(NDA_SECTIONS)}
    rows += [gone(i, t, s, c, "nda", f"k % 6 = {order[t]}") for i, (t, s, c) in enumerate(dims.NDA_REQUIRED)]
    forever = "The confidentiality obligation is stated as perpetual or indefinite. This may be unenforceable in some jurisdictions and creates an indefinite burden."
    rows += [
        _row("20", q("Perpetual Confidentiality Obligation"), "'warning'", "'Legal'", q(forever), "'perpetual 99 years'", "'confidentiality_period'", "nda", "k % 6 <> 1 AND k % 5 = 0"),
        _row("20", q("Very Long Confidentiality Period"), "'informational'", "'Legal'",
             "'The confidentiality period of ' || CASE k % 5 WHEN 1 THEN 'for 7 years' ELSE 'for 6 years' END || ' exceeds 5 years, which may be difficult to enforce.'",
             "CASE k % 5 WHEN 1 THEN 'for 7 years' ELSE 'for 6 years' END", "'confidentiality_period'", "nda", "k % 6 <> 1 AND k % 5 IN (1, 4)"),
        _row("21", q("Missing Governing Law"), "'warning'", "'Legal'", q("No governing law is specified in this NDA. Enforcement jurisdiction is undefined."), q("governing_law: absent"), "NULL", "nda", "k % 3 = 0"),
    ]
    two, none = (lambda x: f"printf('%.2f', CAST({x} AS DOUBLE))"), "NULL"
    late = f"date_diff('day', due_date, DATE '{AS_OF}')"
    rows += [
        _row("0", q("Line Item Math Mismatch"), "'critical'", "'Financial'",
             f"'Quantity (' || CAST(quantity AS INTEGER) || '.0) × unit price (' || {two('unit_price')} || ') = ' || {two('quantity * unit_price')} || ', but stated amount is ' || {two('amount')} || '.'",
             "trim(description)", "'line_items'", "items", "unit_price > 0 AND amount > 0 AND abs(round(coalesce(nullif(quantity, 0), 1) * unit_price - amount, 6)) > 0.11", "line_no"),
        _row("1", q("Zero-Amount Line Item"), "'informational'", "'Financial'", q("A line item has no price or amount. This may be intentional (complimentary item) or a data entry error."),
             "trim(description)", "'line_items'", "items", "unit_price = 0 AND amount = 0", "line_no"),
        _row("2", q("Duplicate Line Item"), "'warning'", "'Financial'", q("An identical line item (same description and amount) appears more than once."), "trim(description)", "'line_items'", "items", "nth > 1", "line_no"),
        _row("10", q("Subtotal Reconciliation Failed"), "'critical'", "'Financial'",
             f"'Sum of line items (' || {two('line_sum')} || ') does not match stated subtotal (' || {two('subtotal')} || ').'", f"'Calculated: ' || {two('line_sum')} || ', Stated: ' || {two('subtotal')}", "'subtotal'", "inv",
             "subtotal > 0 AND abs(line_sum - subtotal) > 0.11", "1000000"),
        _row("11", q("Total Amount Reconciliation Failed"), "'critical'", "'Financial'",
             f"'Subtotal (' || {two('base')} || ') + Tax (0.00) − Discount (0.00) = ' || {two('base')} || ', but stated total is ' || {two('total_amount')} || '.'",
             f"'Expected: ' || {two('base')} || ', Stated: ' || {two('total_amount')}", "'total_amount'", "inv", "total_amount > 0 AND abs(base - total_amount) > 0.11", "1000000"),
        _row("12", q("Invoice Overdue"), "'critical'", "'Financial'", f"'The due date (' || due || ') is ' || {late} || ' day(s) in the past.'", "due", "'due_date'", "inv", f"due IS NOT NULL AND {late} > 0", "1000000"),
        _row("13", q("Missing Due Date"), "'warning'", "'Financial'", q("No payment due date is specified on this invoice."), q("due_date: absent"), "'due_date'", "inv", "due IS NULL", "1000000"),
        _row("14", q("Missing Vendor Name"), "'warning'", "'Compliance'", q("No vendor name is present on this invoice. Accounting attribution is impossible."), q("vendor.name: absent"), none, "inv", "true", "1000000"),
    ]
    whole, pct = (lambda x: f"format('{{:,.0f}}', {x})"), (lambda x: f"printf('%.1f', {x}) || '%'")
    loss, rhs = "abs(net_income) / revenue * 100", "total_liabilities + total_equity"
    rows += [
        _row("0", q("Negative Equity (Technical Insolvency)"), "'critical'", "'Financial'",
             f"'Total equity is negative (' || {whole('total_equity')} || '), indicating total liabilities exceed total assets. This is a technical insolvency signal.'", f"'total_equity: ' || {whole('total_equity')}", none, "sta", "total_equity < 0"),
        _row("1", q("Low Current Ratio"), "'warning'", "'Financial'",
             f"'Current ratio of ' || {two('current_ratio')} || ' indicates current liabilities exceed current assets. The entity may struggle to meet short-term obligations.'", f"'current_ratio: ' || {two('current_ratio')}", none, "sta", "current_ratio < 1"),
        _row("2", q("High Debt-to-Equity Ratio"), "'warning'", "'Financial'",
             f"'Debt-to-equity ratio of ' || {two('debt_to_equity')} || ' is above the typical threshold of 3.0, indicating high financial leverage.'", f"'debt_to_equity: ' || {two('debt_to_equity')}", none, "sta", "debt_to_equity > 3"),
        _row("3", q("Negative Gross Margin"), "'critical'", "'Financial'",
             f"'Gross margin of ' || {pct('gross_margin_pct')} || ' means the entity is selling goods/services below their direct cost.'", f"'gross_margin_pct: ' || {pct('gross_margin_pct')}", none, "sta", "gross_margin_pct < 0"),
        _row("4", q("Large Net Loss Relative to Revenue"), "'warning'", "'Financial'",
             f"'Net loss is ' || {pct(loss)} || ' of revenue, which is unusually large and may indicate structural cost problems.'", f"'net_income: ' || {whole('net_income')} || ', revenue: ' || {whole('revenue')}", none, "sta",
             f"revenue > 0 AND net_income < 0 AND {loss} > 20"),
        _row("5", q("Balance Sheet Does Not Balance"), "'critical'", "'Financial'",
             f"'Total assets (' || {whole('total_assets')} || ') ≠ Total liabilities (' || {whole('total_liabilities')} || ') + Equity (' || {whole('total_equity')} || ') = ' || {whole(rhs)} || '. This suggests extraction error or misstatement.'",
             f"'Δ = ' || {whole(f'abs(total_assets - ({rhs}))')}", none, "sta", f"total_assets > 0 AND abs(total_assets - ({rhs})) / total_assets > 0.02"),
        _row("6", q("Unaudited Financial Statement"), "'informational'", "'Compliance'",
             q("This financial statement does not appear to be independently audited. Figures should be treated as management representations."), q("audited: false"), none, "sta", "NOT audited"),
        _row("0", q("Missing Submission Deadline"), "'critical'", "'Compliance'", q("No submission deadline is specified. Vendors cannot determine when proposals are due."), q("submission_deadline: absent"), none, "rfp", "k % 3 = 0"),
        _row("1", q("Missing Contact Information"), "'warning'", "'Operational'", q("No contact email or phone number is present. Vendors have no way to submit clarification questions."),
             q("contact.email: absent, contact.phone: absent"), none, "rfp", "k % 4 = 0"),
        _row("2", q("Evaluation Criteria Weights Don't Sum to 100%"), "'warning'", "'Compliance'",
             "'The stated evaluation criteria weights sum to ' || w || '%, not 100%. This creates scoring ambiguity.'", "'Sum of weights: ' || w || '%'", none, "rfp", "abs(w - 100) > 2"),
    ]
    form = lambda d: f"CASE doc_id % 3 WHEN 0 THEN strftime({d}, '%Y-%m-%d') WHEN 1 THEN strftime({d}, '%B %-d, %Y') ELSE strftime({d}, '%d/%m/%Y') END"
    return f"""{fx.LINES_SQL}, {fx.HEADER_SQL}, {fx.STATEMENTS_SQL},
con AS (SELECT 'contract-' || s_suppkey AS id, s_suppkey AS k FROM supplier), nda AS (SELECT 'nda-' || c_custkey AS id, c_custkey AS k FROM customer),
items AS (SELECT 'invoice-' || doc_id AS id, *, row_number() OVER (PARTITION BY doc_id, lower(trim(description)), CAST(amount AS DECIMAL(18,2)) ORDER BY line_no) AS nth FROM lines),
inv AS (SELECT 'invoice-' || doc_id AS id, doc_id, due_date, coalesce(line_sum, 0) AS line_sum, subtotal, total_amount, coalesce(nullif(subtotal, 0), line_sum, 0) AS base,
  CASE WHEN doc_id % 4 <> 0 THEN {form('due_date')} END AS due FROM header LEFT JOIN sums USING (doc_id)),
sta AS (SELECT 'financial_statement-' || doc_id AS id, * FROM fs), rfp AS (SELECT 'rfp-' || s_suppkey AS id, s_suppkey AS k, 20 + s_suppkey % 30 + 30 + 50 - s_suppkey % 40 AS w FROM supplier),
oth AS (SELECT 'other-' || doc_id AS id, doc_id % 50 = 0 AS blank FROM documents),
found(r, l, doc_id, title, severity, category, explanation, evidence, clause_type) AS ({" UNION ALL ".join(rows)})"""


FINDINGS_SQL = _findings_sql()


@query("document_findings", f"""WITH {FINDINGS_SQL}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l, r) AS INTEGER) AS ord, title, severity, category, explanation, evidence, clause_type FROM found""")
def document_findings(spark, sf_dir):
    rows = analysed(spark, sf_dir).select("doc_id", F.posexplode("findings").alias("pos", "f"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("ord"), "f.*")


_WHOLE = "CAST(CAST({0} AS BIGINT) AS VARCHAR) || '.0'"
_FIGURES = (("Revenue", "revenue"), ("Net Profit", "net_income"), ("Assets", "total_assets"), ("Liabilities", "total_liabilities"))
_CENTS = "CASE WHEN {0} % 1 = 0 THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) || '.0' ELSE rtrim(CAST(CAST({0} AS DECIMAL(18,2)) AS VARCHAR), '0') END"
RECORDS_SQL = f"""{FINDINGS_SQL},
docs(doc_id, doc_type, base, error, key_fields) AS (
  SELECT id, 'contract', 15, NULL, '• Payment Terms: ' || CASE WHEN k % 7 = 0 THEN 'Present' ELSE 'payable within ' || (10 + k % 110) || ' days' END
    || chr(10) || '• Liability Cap: ' || CASE WHEN k % 7 = 4 THEN 'Present' ELSE '$ ' || (1 + k % 900) || ',500' END || chr(10) || '• Ip Assignment: Present' || chr(10) || '• Non Compete: Present'
    || chr(10) || '• Confidentiality: ' || CASE WHEN k % 7 = 5 THEN 'Present' ELSE 'for 24 months' END || chr(10) || '• Confidentiality Period: Present' FROM con
  UNION ALL SELECT id, 'nda', 10, NULL, '• Non Compete: Present' || chr(10) || '• Confidentiality: Present' || chr(10) || '• Confidentiality Period: '
    || CASE WHEN k % 6 = 1 OR k % 5 = 3 THEN 'Present' ELSE ['perpetual 99 years', 'for 7 years', 'for 24 months', '', 'for 6 years'][1 + k % 5] END FROM nda
  UNION ALL SELECT id, 'invoice', 5, NULL, concat_ws(chr(10), '• Invoice Number: INV-' || doc_id, '• Due Date: ' || due, CASE WHEN total_amount <> 0 THEN '• Total Amount: ' || {_CENTS.format("total_amount")} END, '• Currency: EUR') FROM inv
  UNION ALL SELECT id, 'financial_statement', 10, NULL, coalesce(nullif(concat_ws(chr(10), {", ".join(f"CASE WHEN {c} <> 0 THEN '• {k}: ' || " + _WHOLE.format(c) + " END" for k, c in _FIGURES)}), ''), '{NO_FIELDS}') FROM sta
  UNION ALL SELECT id, 'rfp', 5, NULL, CASE WHEN k % 3 <> 0 THEN '• Deadline: March 5, 2024 at noon' ELSE '{NO_FIELDS}' END FROM rfp
  UNION ALL SELECT id, 'other', 5, CASE WHEN blank THEN 'no text' END, '{NO_FIELDS}' FROM oth
), pts AS (
  SELECT doc_id, CAST(sum(CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END) AS BIGINT) AS penalty, count(*) FILTER (severity = 'critical') AS critical,
    count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'informational') AS informational,
    {", ".join(f"CAST(coalesce(sum(CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END) FILTER (category = '{c}'), 0) AS BIGINT) AS {c.lower()}" for c in dims.CATEGORIES)} FROM found GROUP BY doc_id
), scored AS (
  SELECT docs.*, coalesce(penalty, 0) AS penalty, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(informational, 0) AS informational,
    {", ".join(f"coalesce({c.lower()}, 0) AS {c.lower()}" for c in dims.CATEGORIES)}, CAST(least(100, greatest(floor(100 * (1 - pow(0.98, coalesce(penalty, 0)))), base)) AS INTEGER) AS score FROM docs LEFT JOIN pts USING (doc_id)
)"""
_PARTIES = "CASE doc_type WHEN 'invoice' THEN 'Unknown -> Unknown' ELSE 'Unknown' END"
_NAMES = "CASE doc_type WHEN 'financial_statement' THEN 'Financial Statement' ELSE upper(doc_type[1]) || substr(doc_type, 2) END"


@query("document_records", f"""WITH {RECORDS_SQL}
SELECT doc_id, doc_type, error, CASE WHEN error IS NULL THEN {_NAMES} END AS document_type, CASE WHEN error IS NULL THEN {_PARTIES} END AS parties, CASE WHEN error IS NULL THEN key_fields END AS key_fields,
  CASE WHEN error IS NULL THEN score END AS risk_score, CASE WHEN error IS NULL THEN critical END AS critical, CASE WHEN error IS NULL THEN warning END AS warning, CASE WHEN error IS NULL THEN informational END AS informational
FROM scored""")
def document_records(spark, sf_dir):
    long = lambda c: F.col(f"record.{c}").cast("long").alias(c)
    return analysed(spark, sf_dir, fields=COUNTED).select("doc_id", "doc_type", "error", "record.document_type", "record.parties", "record.key_fields", "record.risk_score", long("critical"), long("warning"), long("informational"))


@query("document_risk", f"""WITH {RECORDS_SQL}
SELECT doc_id, score AS overall_score, CASE WHEN score < 40 THEN 'Low' WHEN score < 75 THEN 'Medium' ELSE 'High' END AS risk_level, legal, financial, compliance, operational, critical + warning + informational AS total_anomalies FROM scored WHERE error IS NULL""")
def document_risk(spark, sf_dir):
    rows = analysed(spark, sf_dir, fields=COUNTED).filter("error IS NULL")
    return rows.select("doc_id", *(f"risk.{c}" for c in ("overall_score", "risk_level", "legal", "financial", "compliance", "operational", "total_anomalies")))


_CLAUSE_ROW = "array<struct<clause_type:string,status:string,value:string,page:int>>"
_TERMS = ("'payable within ' || (10 + k % 110) || ' days'", "'$ ' || (1 + k % 900) || ',000.00'", "'Either party may end this agreement upon breach.'", "'Give ' || (5 + k % 60) || ' days'", "'$ ' || (1 + k % 900) || ',500'", "'for 24 months'", "'Work is free of defects.'", "'Present'")


def _clauses_sql() -> str:
    # A body stands a line below its heading; headings follow the two first lines, two lines each, one of them left out.
    page = lambda i: f"CAST(1 + (3 + 2 * ({i} - CASE WHEN k % 7 < {i} THEN 1 ELSE 0 END)) // {PAGE} AS INTEGER)"
    rows = [f"SELECT id, '{t}', {_TERMS[i]}, {page(i)} FROM con WHERE k % 7 <> {i}" for i, (t, _, _) in enumerate(fx.CLAUSES)]
    rows.append(f"SELECT id, 'payment_amount', {_TERMS[4]}, {page(4)} FROM con WHERE k % 7 = 1")
    period = "CASE k % 5 WHEN 0 THEN 'perpetual 99 years' WHEN 1 THEN 'for 7 years' WHEN 2 THEN 'for 24 months' WHEN 4 THEN 'for 6 years' END"
    own = lambda i: f"CAST(1 + (3 + 2 * ({i} - CASE WHEN k % 6 < {i} THEN 1 ELSE 0 END)) // {PAGE} AS INTEGER)"
    rows += [f"SELECT id, '{t}', {period if '{p}' in body else _quoted(body)}, {own(i)} FROM nda WHERE k % 6 <> {i}" for i, (t, _, body) in enumerate(NDA_SECTIONS)]
    law = "CASE WHEN k % 3 <> 0 THEN 'This is governed by the laws of Utopia.' ELSE 'None is named.' END"
    rows.append(f"SELECT id, 'dispute_resolution', {law}, {own(5)} FROM nda")
    return f"""WITH con AS (SELECT 'contract-' || s_suppkey AS id, s_suppkey AS k FROM supplier), nda AS (SELECT 'nda-' || c_custkey AS id, c_custkey AS k FROM customer),
c(doc_id, clause_type, value, page) AS ({" UNION ALL ".join(rows)}) SELECT doc_id, clause_type, 'present' AS status, value, page FROM c"""


@query("document_clauses", _clauses_sql())
def document_clauses(spark, sf_dir):
    """The clauses that are there, out of the Variant payloads, with the page that each stands on."""
    listed = F.try_variant_get("payload", "$.clauses", _CLAUSE_ROW)
    rows = analysis.variants(documents(spark, sf_dir), fuzzy=False).select("doc_id", F.explode(listed).alias("c")).filter("c.status = 'present'")
    return rows.select("doc_id", "c.*")


@query("document_payloads", f"""WITH {RECORDS_SQL}
SELECT 'contract-' || s_suppkey AS doc_id, CASE WHEN s_suppkey % 6 <> 0 THEN trim(translate(n_name, '_0123456789', ' ABCDEFGHIJ')) END AS law, NULL AS number, NULL AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT id, CASE WHEN k % 3 <> 0 THEN 'Utopia' END, NULL, NULL FROM nda
UNION ALL SELECT inv.id, NULL, 'INV-' || inv.doc_id, CAST(coalesce(n, 0) AS INTEGER) FROM inv LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) c USING (doc_id)
UNION ALL SELECT id, NULL, NULL, NULL FROM sta UNION ALL SELECT id, NULL, 'R/' || k, 3 FROM rfp UNION ALL SELECT id, NULL, NULL, CASE WHEN NOT blank THEN 1 END FROM oth""")
def document_payloads(spark, sf_dir):
    """Fields of the Variant payloads: law, number, and how many items, criteria or facts (the first) there are."""
    get = lambda path, kind: F.try_variant_get("payload", path, kind)
    counted = F.coalesce(F.size(get("$.line_items", "array<variant>")), F.size(get("$.evaluation_criteria", "array<variant>")), F.size(F.filter(get("$.key_facts", "array<struct<label:string>>"), lambda f: f["label"] == "Reference")))
    number = F.coalesce(get("$.invoice_number", "string"), get("$.rfp_number", "string"))
    return analysis.variants(documents(spark, sf_dir), fuzzy=False).select("doc_id", get("$.governing_law", "string").alias("law"), number.alias("number"), counted.alias("n"))


@query("document_dates", """WITH d AS (SELECT 'rfp-' || s_suppkey AS doc_id, s_suppkey AS k FROM supplier)
SELECT doc_id, 'March 5, 2024' AS value, 'Date' AS label, CAST(NULL AS INTEGER) AS page FROM d WHERE k % 3 <> 0
UNION ALL SELECT 'invoice-' || o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d'), 'Date', NULL FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'invoice-' || o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) + CAST(15 + o_orderkey % 90 AS INTEGER) AS DATE), '%Y-%m-%d'), 'Date', NULL FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0
UNION ALL SELECT 'invoice-' || o_orderkey, o_orderkey || chr(10) || 'Issued ' || year(o_orderdate), 'Date', NULL FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 100
UNION ALL SELECT 'invoice-' || o_orderkey, strftime(CAST(o_orderdate AS DATE), '%B %-d, %Y'), 'Date', NULL FROM orders WHERE o_orderkey % 3 = 1
UNION ALL SELECT 'invoice-' || o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) + CAST(15 + o_orderkey % 90 AS INTEGER) AS DATE), '%B %-d, %Y'), 'Date', NULL FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 4 <> 0
UNION ALL SELECT 'invoice-' || o_orderkey, strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y'), 'Date', NULL FROM orders WHERE o_orderkey % 3 = 2
UNION ALL SELECT 'invoice-' || o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) + CAST(15 + o_orderkey % 90 AS INTEGER) AS DATE), '%d/%m/%Y'), 'Date', NULL FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey % 4 <> 0""")
def document_dates(spark, sf_dir):
    """Dates of invoices and proposals, each value once. A number, a word and a year count as a date, over a line's end too, as in `12\nIssued 1997`. Contexts
    run over several elements, so none stands on a page."""
    docs = documents(spark, sf_dir).filter("doc_type IN ('invoice', 'rfp')")
    return analysis.classified(docs).select("doc_id", F.explode("dates").alias("d")).select("doc_id", "d.value", "d.label", "d.page")


@query("typed_payloads")
def typed_payloads(spark, sf_dir):
    """Every kind of document through the dispatch by type, with headings matched fuzzily: (doc_id, doc_type, payload, error)."""
    rows = analysis.variants(documents(spark, sf_dir))
    return rows.select("doc_id", "doc_type", F.to_json("payload").alias("payload"), "error")
