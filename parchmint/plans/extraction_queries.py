"""Queries that render documents as text, tables or JSON from the star schema and read them back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.functions import fields as fd
from parchmint.operators import analysis, classify, elements, extract, records, rules, validators
from parchmint import dims
from parchmint.plans import fixtures as fx
from parchmint.plans.queries import _SECTIONS_SQL, query
from parchmint.streaming import stages


def rx(pattern: str, col: str = "t", n: int = 1) -> str:
    """First match of a pattern's group in SQL, null without one."""
    return f"nullif(trim(regexp_extract({col}, '{pattern}', {n})), '')"


def amount_sql(field: str) -> str:
    return f"TRY_CAST(regexp_replace({rx('(?i)' + fd.AMOUNT_LABELS[field] + fd.AMOUNT_TAIL)}, '[^0-9.]', '', 'g') AS DOUBLE)"


# Invoices as text


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, money = F.col("o_orderkey"), lambda x: x.cast("decimal(18,2)").cast("string")
    s = lambda c: c.cast("string")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    text = F.concat_ws(
        "\n", F.lit("INVOICE"), F.concat(F.lit("Invoice No: INV-"), s(k)), F.when(k % 3 == 0, F.concat(F.lit("PO Number: PO-"), s(k % 977))), F.concat(F.lit("VAT No: GB"), s(100000 + k)),
        F.concat(F.lit("Issued "), s(F.to_date("o_orderdate")), F.when(k % 4 != 0, F.concat(F.lit(" due "), s(F.date_add(F.to_date("o_orderdate"), 30)))).otherwise("")),
        F.when(k % 2 == 0, F.lit("Amounts in EUR")), F.concat(F.lit("billing@vendor"), s(k % 7), F.lit(".com payer@client"), s(k % 11), F.lit(".org")), F.when(k % 5 != 0, F.lit("Net 45 days")),
        F.concat(F.lit("Subtotal: "), money(price)), F.concat(F.lit("Tax: $"), money(price)), F.concat(F.lit("Grand Total: "), money(price)), F.lit("Sort Code: 12-34-56"), F.lit("SWIFT: ABCDGB2L"),
    )
    orders = fx.spread(fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderkey")
    return orders.select(k.alias("doc_id"), fx.once(text).alias("full_text"))


INVOICE_TEXTS_SQL = """
inv AS (
  SELECT o_orderkey AS doc_id, concat_ws(chr(10), 'INVOICE', 'Invoice No: INV-' || o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'PO Number: PO-' || (o_orderkey % 977) END, 'VAT No: GB' || (100000 + o_orderkey),
    'Issued ' || CAST(o_orderdate AS DATE) || CASE WHEN o_orderkey % 4 <> 0 THEN ' due ' || CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) ELSE '' END,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Amounts in EUR' END, 'billing@vendor' || (o_orderkey % 7) || '.com payer@client' || (o_orderkey % 11) || '.org', CASE WHEN o_orderkey % 5 <> 0 THEN 'Net 45 days' END,
    'Subtotal: ' || CAST(o_totalprice AS DECIMAL(18,2)), 'Tax: $' || CAST(o_totalprice AS DECIMAL(18,2)), 'Grand Total: ' || CAST(o_totalprice AS DECIMAL(18,2)), 'Sort Code: 12-34-56', 'SWIFT: ABCDGB2L') AS t
  FROM orders
)"""
_DATE_SQL = r"(?i)\b\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b|\b\d{4}[\/\-]\d{1,2}[\/\-]\d{1,2}\b"


@query("invoice_header_extract", f"""WITH {INVOICE_TEXTS_SQL}
SELECT doc_id, {rx(fd.INVOICE_NUMBER)} AS invoice_number, {rx(fd.PO_NUMBER)} AS purchase_order, {rx(fd.TAX_ID)} AS vendor_tax_id,
  regexp_extract_all(t, '{_DATE_SQL}')[1] AS invoice_date, regexp_extract_all(t, '{_DATE_SQL}')[2] AS due_date, coalesce({rx(fd.CURRENCY_CODE)}, {rx(fd.CURRENCY_SYMBOL)}) AS currency,
  regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')[1] AS vendor_email, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')[2] AS bill_to_email,
  {rx("(?i)net\\s+\\d+\\s+days", n=0)} AS payment_terms, {amount_sql("subtotal")} AS subtotal, {amount_sql("tax_amount")} AS tax_amount, {amount_sql("total_amount")} AS total_amount,
  {rx(fd.BANK["sort_code"])} AS sort_code, {rx(fd.BANK["swift"])} AS swift FROM inv""")
def invoice_header_extract(spark, sf_dir):
    return extract.invoice_header(invoice_texts(spark, sf_dir)).select(
        "doc_id", "invoice_number", "purchase_order", "vendor_tax_id", "invoice_date", "due_date", "currency", "vendor_email", "bill_to_email", "payment_terms", "subtotal", "tax_amount", "total_amount", "sort_code", "swift"
    )


@query("invoice_missing_fields", f"""WITH {INVOICE_TEXTS_SQL}
SELECT doc_id, 'Missing Due Date' AS title, 'warning' AS severity, 'Financial' AS category FROM inv WHERE regexp_extract_all(t, '{_DATE_SQL}')[2] IS NULL
UNION ALL SELECT doc_id, 'Missing Vendor Name', 'warning', 'Compliance' FROM inv""")
def invoice_missing_fields(spark, sf_dir):
    return rules.missing_invoice_fields(extract.invoice_header(invoice_texts(spark, sf_dir))).select("doc_id", "title", "severity", "category")


def invoice_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements: a table per order with its lines as text, and a row of the total that is no line."""
    cell = lambda c: F.format_number(c, 2)
    row = F.struct("line_no", F.array(F.col("description"), F.col("quantity").cast("int").cast("string"), F.concat(F.lit("$"), cell("unit_price")), cell("amount")).alias("cells"))
    rows = fx.invoice_lines(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("l"))
    none = lambda t: F.lit(None).cast(t)
    return rows.select(
        "doc_id", F.lit(1).alias("page_no"), F.lit(0).alias("el_no"), F.lit("table").alias("type"), none("string").alias("text"), none("array<string>").alias("items"),
        F.array(*map(F.lit, ("Description", "Qty", "Price", "Amount"))).alias("headers"), F.array_append(F.transform("l", lambda x: x["cells"]), F.array(*map(F.lit, ("Total", "", "", "1.00")))).alias("rows"),
    )


@query("invoice_line_extract", f"""WITH {fx.LINES_SQL}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS line_no, trim(description) AS description, quantity, CAST(unit_price AS DOUBLE) AS unit_price, CAST(amount AS DOUBLE) AS amount FROM lines""")
def invoice_line_extract(spark, sf_dir):
    return extract.invoice_lines(invoice_tables(spark, sf_dir)).select("doc_id", "line_no", "description", "quantity", "unit_price", "amount")


@query("table_text", f"""WITH {fx.LINES_SQL}
SELECT doc_id, 'Description | Qty | Price | Amount' || chr(10) || repeat('-', 20) || chr(10) || string_agg(description || ' | ' || CAST(CAST(quantity AS INTEGER) AS VARCHAR) || ' | $' || format('{{:,.2f}}', unit_price) || ' | ' || format('{{:,.2f}}', amount), chr(10) ORDER BY line_no) || chr(10) || 'Total |  |  | 1.00' AS text FROM lines GROUP BY doc_id""")
def table_text(spark, sf_dir):
    return invoice_tables(spark, sf_dir).select("doc_id", elements.element_text().alias("text"))


@query("invoice_exact_duplicates", f"""WITH {fx.LINES_SQL}
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, description, amount ORDER BY line_no) AS nth FROM lines) WHERE nth > 1""")
def invoice_exact_duplicates(spark, sf_dir):
    return rules.exact_duplicate_lines(fx.invoice_lines(spark, sf_dir)).select("doc_id", "line_no")


# Statements as text

_SHOWN = {
    "revenue": "Total Revenue", "gross_profit": "Gross Profit", "net_income": "Net Income", "current_assets": "Total Current Assets", "current_liabilities": "Total Current Liabilities",
    "long_term_debt": "Long-term debt", "total_equity": "Total Equity", "total_assets": "Total Assets", "total_liabilities": "Total Liabilities",
}


def statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda c: F.when(F.col(c) < 0, F.concat(F.lit("("), F.format_number(-F.col(c), 0), F.lit(")"))).otherwise(F.format_number(c, 0))
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), show(c))) for c, label in _SHOWN.items()]
    foot = F.when(F.col("audited"), "Audited by an independent auditor.").otherwise("Unaudited accounts, in thousands")
    return fx.spread(fx.statements(spark, sf_dir), "doc_id").select("doc_id", fx.once(F.concat_ws("\n", *lines, foot)).alias("full_text"))


@query("statement_extract", f"""WITH {fx.STATEMENTS_SQL}
SELECT doc_id, {", ".join(_SHOWN)}, gross_margin_pct, net_margin_pct, current_ratio, debt_to_equity FROM fs""")
def statement_extract(spark, sf_dir):
    return extract.statement_metrics(statement_texts(spark, sf_dir)).select("doc_id", *_SHOWN, "gross_margin_pct", "net_margin_pct", "current_ratio", "debt_to_equity")


@query("statement_header_extract", f"""WITH {fx.STATEMENTS_SQL} SELECT doc_id, 'combined' AS statement_type, CASE WHEN audited THEN 'actual' ELSE 'thousands' END AS unit, audited FROM statements""")
def statement_header_extract(spark, sf_dir):
    return extract.statement_header(statement_texts(spark, sf_dir)).select("doc_id", "statement_type", "unit", "audited")


@query("statement_metrics_long", f"""WITH {fx.STATEMENTS_SQL} SELECT doc_id, metric, value FROM (UNPIVOT statements ON {", ".join(_SHOWN)} INTO NAME metric VALUE value)""")
def statement_metrics_long(spark, sf_dir):
    return extract.metrics_long(extract.statement_metrics(statement_texts(spark, sf_dir))).drop("block")


# Requests for proposals as text

_CRITERIA = (("Technical approach and method", "20 + s_suppkey % 30"), ("Price over the whole term", "30"), ("Experience of the team", "50 - s_suppkey % 40"))


def rfp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    lines = [F.concat(F.lit(f"- {name} "), F.expr(f"CAST({w} AS STRING)"), F.lit("%")) for name, w in _CRITERIA]
    head = F.concat_ws(
        "\n", F.concat(F.lit("Request for Proposal: Supply of goods, lot "), k), F.concat(F.lit("RFP No: R/"), k), F.expr("CASE WHEN s_suppkey % 3 <> 0 THEN 'Submission deadline: March 5, 2024 at noon' END"),
        F.concat(F.lit("Budget: $"), k, F.lit(" million")), F.expr("CASE WHEN s_suppkey % 4 <> 0 THEN 'Questions to ask@buyer.org' END"),
    )
    text = F.concat(head, F.lit("\nEvaluation criteria:\n"), F.concat_ws("\n", *lines), F.lit("\n\nEnd."))
    return fx.spread(fx.table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), fx.once(text).alias("full_text"))


@query("rfp_header_extract", """SELECT s_suppkey AS doc_id, 'Supply of goods, lot ' || s_suppkey AS rfp_title, 'R/' || s_suppkey AS rfp_number, CASE WHEN s_suppkey % 3 <> 0 THEN 'March 5, 2024 at noon' END AS submission_deadline,
  '$' || s_suppkey || ' million' AS contract_value, CASE WHEN s_suppkey % 4 <> 0 THEN 'ask@buyer.org' END AS contact_email FROM supplier""")
def rfp_header_extract(spark, sf_dir):
    return extract.rfp_header(rfp_texts(spark, sf_dir)).drop("contact_phone")


@query("rfp_criteria_extract", " UNION ALL ".join(f"SELECT s_suppkey AS doc_id, CAST({i + 1} AS INTEGER) AS ord, '{n}' AS criterion, CAST({w} AS DOUBLE) AS weight_pct FROM supplier" for i, (n, w) in enumerate(_CRITERIA)))
def rfp_criteria_extract(spark, sf_dir):
    return extract.rfp_criteria(rfp_texts(spark, sf_dir))


@query("rfp_findings", f"""SELECT s_suppkey AS doc_id, 'Missing Submission Deadline' AS title FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'Missing Contact Information' FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT s_suppkey, 'Evaluation Criteria Weights Don''t Sum to 100%' FROM supplier WHERE abs({" + ".join(w for _, w in _CRITERIA)} - 100) > 2""")
def rfp_findings(spark, sf_dir):
    t = rfp_texts(spark, sf_dir)
    return rules.rfp_gaps(extract.rfp_header(t)).unionByName(rules.rfp_weights(extract.rfp_criteria(t)).drop("total_weight")).select("doc_id", "title")


def list_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of orders: lines with even prices are list items, others paragraphs."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = fx.table(spark, sf_dir, "lineitem").withColumn("el_no", F.row_number().over(order))
    listed, text = F.floor("l_extendedprice") % 2 == 0, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.expr("CASE WHEN l_suppkey % 2 = 0 THEN ' must be delivered in time' ELSE '' END"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), "el_no", F.when(listed, "list").otherwise("paragraph").alias("type"), F.when(~listed, text).alias("text"), F.when(listed, F.array(text)).alias("items"))


_LISTS_SQL = """le AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS el_no,
  floor(l_extendedprice) % 2 = 0 AS listed, 'Part ' || l_partkey || CASE WHEN l_suppkey % 2 = 0 THEN ' must be delivered in time' ELSE '' END AS text FROM lineitem),
li AS (SELECT *, sum(CASE WHEN listed AND coalesce(was, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY el_no) AS island FROM (SELECT *, lag(listed) OVER (PARTITION BY doc_id ORDER BY el_no) AS was FROM le))"""


@query("list_merge", f"WITH {_LISTS_SQL} SELECT doc_id, CAST(min(el_no) AS INTEGER) AS el_no, string_agg(text, '|' ORDER BY el_no) AS items FROM li WHERE listed GROUP BY doc_id, island")
def list_merge(spark, sf_dir):
    merged = elements.merge_lists(list_elements(spark, sf_dir))
    return merged.filter("type = 'list'").select("doc_id", "el_no", F.array_join("items", "|").alias("items"))


@query("rfp_requirements", f"""WITH {_LISTS_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY el_no) AS INTEGER) AS ord, text AS description, contains(text, 'must') AS mandatory FROM le WHERE listed AND length(text) > 20
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY el_no) <= 20""")
def rfp_requirements(spark, sf_dir):
    return extract.rfp_requirements(elements.merge_lists(list_elements(spark, sf_dir))).drop("category")


@query("synthetic_pages", "SELECT user_id AS doc_id, CAST(page AS INTEGER) AS page_no, count(*) AS n FROM (SELECT user_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 5) + 1 AS page FROM events) GROUP BY 1, 2")
def synthetic_pages(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("el_no"))
    return elements.paginate(e, 5).groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


@query("preamble_text", """SELECT user_id AS doc_id, substr(string_agg(event_type, chr(10) || chr(10) ORDER BY page, event_id), 1, 4000) AS full_text
FROM (SELECT user_id, event_id, event_type, floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 3) + 1 AS page FROM events) WHERE page <= 2 GROUP BY user_id""")
def preamble_text(spark, sf_dir):
    none = lambda t: F.lit(None).cast(t)
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("el_no"), F.col("event_type").alias("text"), none("array<string>").alias("items"), none("array<string>").alias("headers"), none("array<array<string>>").alias("rows"))
    return elements.assembled(elements.paginate(e, 3), 4000, pages=2)


# Contracts


@query("jurisdiction", f"WITH {fx.CONTRACTS_SQL} SELECT doc_id, {rx(classify.JURISDICTION[0].replace(chr(39), chr(39) * 2), 'text')} AS jurisdiction FROM contracts")
def jurisdiction(spark, sf_dir):
    return fx.contracts(spark, sf_dir).select("doc_id", classify.jurisdiction(F.col("text"))["value"].alias("jurisdiction"))


_CONTRACT_FOUND_SQL = f"""{_SECTIONS_SQL}, req(clause_type, severity) AS (VALUES {", ".join(f"('{c}', '{s}')" for c, s, _ in dims.CONTRACT_REQUIRED)}),
cf AS (
  SELECT doc_id, severity FROM contracts CROSS JOIN req WHERE NOT EXISTS (SELECT 1 FROM firsts WHERE firsts.doc_id = contracts.doc_id AND firsts.clause_type = req.clause_type)
    AND NOT (clause_type = 'payment_amount' AND contains(text, '$ '))
  UNION ALL SELECT doc_id, 'warning' FROM firsts WHERE clause_type = 'notice_period' AND TRY_CAST(regexp_extract(body, '(\\d+)\\s*day', 1) AS INTEGER) < 30
  UNION ALL SELECT doc_id, 'warning' FROM firsts WHERE clause_type = 'payment_terms' AND TRY_CAST(regexp_extract(body, '(\\d+)\\s*day', 1) AS INTEGER) > 90
  UNION ALL SELECT doc_id, 'informational' FROM contracts WHERE contains(text, '$ ') AND NOT EXISTS (SELECT 1 FROM firsts WHERE firsts.doc_id = contracts.doc_id AND clause_type IN ('ip_assignment', 'ip_license'))
), cp AS (SELECT doc_id, CAST(sum(CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END) AS BIGINT) AS penalty, count(*) AS total_anomalies FROM cf GROUP BY doc_id)"""


@query("contract_risk", f"""WITH {_CONTRACT_FOUND_SQL}
SELECT contracts.doc_id, coalesce(total_anomalies, 0) AS total_anomalies, coalesce(penalty, 0) AS penalty, CAST(least(100, greatest(floor(100 * (1 - pow(0.98, coalesce(penalty, 0)))), 15)) AS INTEGER) AS overall_score
FROM contracts LEFT JOIN cp USING (doc_id)""")
def contract_risk(spark, sf_dir):
    """Contracts from text to score: sections, clauses, rules, points, all in the row."""
    none = F.lit(None).cast(f"array<{analysis.ELEMENT}>")
    docs = fx.contracts(spark, sf_dir).select("doc_id", F.lit("contract").alias("doc_type"), F.col("text").alias("full_text"), none.alias("elements"))
    return analysis.judged(analysis.payloads(docs, fuzzy=False), "1998-01-01").select("doc_id", "risk.total_anomalies", "risk.penalty", "risk.overall_score")


@query("header_fuzzy_match")
def header_fuzzy_match(spark, sf_dir):
    from parchmint.operators.documents import sections

    return extract.match_headers_fuzzy(sections(fx.contracts(spark, sf_dir)), dims.clause_headers())


@query("headings_varied")
def headings_varied(spark, sf_dir):
    """Headings with up to two letters left out, doubled, changed or put in, and two headings in one, by the numbers of each line."""
    names = [v for _, v in dims.clause_headers(nda=True)]
    name = lambda k: F.element_at(F.array(*map(F.lit, names)), (F.col(k) % len(names) + 1).cast("int"))

    def edited(text, place, how):
        at = (place % F.length(text) + 1).cast("int")
        head, letter, rest = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.length(text))
        new = F.element_at(F.array(F.lit(""), F.concat(letter, letter), F.lit("x"), F.concat(F.lit(" "), letter), letter), (how % 5 + 1).cast("int"))
        return F.concat(head, new, rest)

    once = edited(name("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"))
    twice = edited(once, F.col("l_suppkey"), F.col("l_partkey"))
    header = F.when(F.col("l_suppkey") % 7 == 0, F.concat(twice, F.lit(" and "), name("l_suppkey"))).otherwise(twice)
    return extract.match_headers_fuzzy(fx.table(spark, sf_dir, "lineitem").select(F.initcap(header).alias("header")), dims.clause_headers(nda=True))


@query("document_metadata")
def document_metadata(spark, sf_dir):
    """Type by the nearest prototypes, jurisdiction, dates, parties and summary of contracts."""
    texts = fx.contracts(spark, sf_dir).select("doc_id", F.col("text").alias("full_text"))
    typed = classify.document_types(texts, dims.PROTOTYPES)
    return classify.classify(texts.join(typed, "doc_id"), F.col("document_type"))


# Answers of a model, records, lists


@query("validated_invoices", """SELECT o_orderkey AS doc_id, CAST(nullif(o_orderkey, 0) AS VARCHAR) AS invoice_number, substr('CURRENCY-' || o_orderstatus || '-LONG', 1, 10) AS currency, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS subtotal,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_items, substr(o_orderpriority, 1, 300) AS description FROM orders""")
def validated_invoices(spark, sf_dir):
    k = F.col("o_orderkey")
    item = F.struct(F.col("o_orderpriority").alias("description"), F.lit("3").alias("quantity"), F.lit("x").alias("amount"))
    items = F.when(k % 2 == 0, F.array(F.to_json(item))).otherwise(F.array(F.to_json(item), F.lit("{}"), F.lit('"noise"')))
    money = F.when(k % 3 == 0, F.lit('"about ten"')).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
    payload = F.concat(F.lit('{"invoice_number": '), k.cast("string"), F.lit(', "currency": "CURRENCY-'), F.col("o_orderstatus"), F.lit('-LONG", "subtotal": '), money, F.lit(', "line_items": ['), F.array_join(items, ","), F.lit("]}"))
    good = validators.invoice(fx.table(spark, sf_dir, "orders").select(k.alias("doc_id"), payload.alias("payload")))
    return good.select("doc_id", "invoice_number", "currency", "subtotal", F.size("line_items").alias("n_items"), F.col("line_items")[0]["description"].alias("description"))


@query("record_key_fields", f"""WITH {INVOICE_TEXTS_SQL}, h AS (SELECT doc_id, {rx(fd.INVOICE_NUMBER)} AS n, regexp_extract_all(t, '{_DATE_SQL}')[2] AS d, coalesce({rx(fd.CURRENCY_CODE)}, {rx(fd.CURRENCY_SYMBOL)}) AS c FROM inv)
SELECT doc_id, concat_ws(chr(10), '• Invoice Number: ' || n, '• Due Date: ' || d, '• Currency: ' || c) AS key_fields, 'Unknown -> Unknown' AS parties FROM h""")
def record_key_fields(spark, sf_dir):
    h = extract.invoice_header(invoice_texts(spark, sf_dir)).drop("total_amount", "tax_amount")
    return records.key_fields(h, "invoice").withColumn("parties", records.invoice_parties(F.lit(None).cast("string"), F.lit("")))


@query("retry_eligible", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0")
def retry_eligible(spark, sf_dir):
    k = F.col("o_orderkey")
    crm = F.when(k % 3 == 0, "synced").when(k % 3 == 1, "failed")
    docs = fx.table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing").alias("status"), crm.alias("crm_status"))
    return records.retry_eligible(docs).select("doc_id")


@query("documents_compared", "SELECT o_orderkey AS doc_id, count(*) OVER (PARTITION BY o_custkey) AS documents_compared, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'complete' ELSE 'skipped' END AS stage_status FROM orders WHERE o_orderstatus = 'F'")
def documents_compared(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing").alias("status"))
    return records.compared(docs).select("doc_id", "documents_compared", "stage_status")


@query("stage_progress", f"""WITH e AS (SELECT user_id AS client_id, event_id AS seq, ts, [{", ".join(f"'{s}'" for s in dims.STAGES)}][event_id % 6 + 1] AS stage, CAST(event_id % 6 AS INTEGER) AS i, CASE WHEN event_id % 5 = 0 THEN 'running' WHEN event_id % 97 = 0 THEN 'error' ELSE 'complete' END AS status FROM events),
f AS (SELECT client_id, i, arg_max(status, (ts, seq)) AS status FROM e GROUP BY 1, 2), g AS (SELECT client_id, max(i) AS top FROM f GROUP BY 1),
m AS (SELECT g.client_id, s.i, CASE WHEN s.i < top AND coalesce(status, 'pending') IN ('pending', 'running') THEN 'complete' ELSE coalesce(status, 'pending') END AS status FROM g CROSS JOIN (SELECT unnest(range(6)) AS i) s LEFT JOIN f ON f.client_id = g.client_id AND f.i = s.i)
SELECT client_id, string_agg(status, ',' ORDER BY i) AS stages, CASE WHEN bool_or(status = 'error') THEN 'failed' WHEN bool_or(i = 4 AND status = 'complete') THEN 'completed' ELSE 'processing' END AS document_status FROM m GROUP BY client_id""")
def stage_progress(spark, sf_dir):
    k = F.col("event_id")
    stage = F.element_at(F.array(*map(F.lit, dims.STAGES)), (k % 6 + 1).cast("int"))
    status = F.when(k % 5 == 0, "running").when(k % 97 == 0, "error").otherwise("complete")
    events = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("client_id"), k.alias("seq"), "ts", stage.alias("stage"), status.alias("status"))
    return stages.progress(events).select("client_id", F.array_join(F.array(*(F.col("stages")[s] for s in dims.STAGES)), ",").alias("stages"), "document_status")
