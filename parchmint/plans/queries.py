"""Named queries over the rendered documents and the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import text as tx
from parchmint.operators import documents as docs_ops
from parchmint.operators import records, rules
from parchmint import dims
from parchmint.plans import fixtures as fx
from parchmint.streaming import workspace

QUERIES, ORACLES = {}, {}
_INVOICE = fx.LINES_SQL + "," + fx.HEADER_SQL


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_RULES_SQL = """
math AS (SELECT doc_id, line_no FROM lines WHERE unit_price > 0 AND amount > 0 AND abs(round(coalesce(nullif(quantity, 0), 1) * unit_price - amount, 6)) > 0.11),
zero AS (SELECT doc_id, line_no FROM lines WHERE unit_price = 0 AND amount = 0 AND description <> ''),
dup AS (SELECT doc_id, line_no FROM (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, lower(trim(description)), CAST(amount AS DECIMAL(18,2)) ORDER BY line_no) AS nth FROM lines) WHERE nth > 1),
sub AS (SELECT header.doc_id FROM header LEFT JOIN sums USING (doc_id) WHERE subtotal > 0 AND abs(coalesce(line_sum, 0) - subtotal) > 0.11),
tot AS (SELECT doc_id FROM header LEFT JOIN sums USING (doc_id) WHERE total_amount > 0 AND abs(coalesce(nullif(subtotal, 0), line_sum, 0) - total_amount) > 0.11),
found AS (
  SELECT doc_id, 'critical' AS severity, 'Financial' AS category FROM math UNION ALL SELECT doc_id, 'informational', 'Financial' FROM zero
  UNION ALL SELECT doc_id, 'warning', 'Financial' FROM dup UNION ALL SELECT doc_id, 'critical', 'Financial' FROM sub UNION ALL SELECT doc_id, 'critical', 'Financial' FROM tot
), scored AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS total_anomalies, CAST(sum(CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END) AS BIGINT) AS penalty FROM found GROUP BY doc_id
), judged AS (
  SELECT o_orderkey AS doc_id, coalesce(total_anomalies, 0) AS total_anomalies, coalesce(penalty, 0) AS penalty,
    CAST(least(100, greatest(floor(100 * (1 - pow(0.98, coalesce(penalty, 0)))), 5)) AS INTEGER) AS overall_score
  FROM orders LEFT JOIN scored ON doc_id = o_orderkey
)"""


@query("invoice_risk", f"""WITH {_INVOICE}, {_RULES_SQL}
SELECT doc_id, total_anomalies, penalty, overall_score, CASE WHEN overall_score < 40 THEN 'Low' WHEN overall_score < 75 THEN 'Medium' ELSE 'High' END AS risk_level FROM judged""")
def invoice_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    header, lines = fx.invoice_header(spark, sf_dir), fx.invoice_lines(spark, sf_dir)
    docs = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("invoice").alias("doc_type"))
    return rules.risk(docs, rules.invoice_findings(header, lines)).select("doc_id", "total_anomalies", "penalty", "overall_score", "risk_level")


@query("line_math_mismatch", f"WITH {_INVOICE}, {_RULES_SQL} SELECT doc_id, line_no FROM math")
def line_math_mismatch(spark, sf_dir):
    return rules.line_math(fx.invoice_lines(spark, sf_dir)).select("doc_id", "line_no")


@query("zero_amount_lines", f"WITH {_INVOICE}, {_RULES_SQL} SELECT doc_id, line_no FROM zero")
def zero_amount_lines(spark, sf_dir):
    return rules.zero_amount(fx.invoice_lines(spark, sf_dir)).select("doc_id", "line_no")


@query("duplicate_lines", f"WITH {_INVOICE}, {_RULES_SQL} SELECT doc_id, line_no FROM dup")
def duplicate_lines(spark, sf_dir):
    return rules.duplicate_lines(fx.invoice_lines(spark, sf_dir)).select("doc_id", "line_no")


@query("subtotal_recon", f"WITH {_INVOICE}, {_RULES_SQL} SELECT doc_id FROM sub")
def subtotal_recon(spark, sf_dir):
    return rules.subtotal_mismatch(fx.invoice_header(spark, sf_dir), fx.invoice_lines(spark, sf_dir)).select("doc_id")


@query("total_recon", f"WITH {_INVOICE}, {_RULES_SQL} SELECT doc_id FROM tot")
def total_recon(spark, sf_dir):
    return rules.total_mismatch(fx.invoice_header(spark, sf_dir), fx.invoice_lines(spark, sf_dir)).select("doc_id")


@query("risk_category_pivot", f"WITH {_INVOICE}, {_RULES_SQL} SELECT doc_id, CAST(penalty AS BIGINT) AS financial, CAST(0 AS BIGINT) AS legal FROM scored")
def risk_category_pivot(spark, sf_dir):
    found = rules.invoice_findings(fx.invoice_header(spark, sf_dir), fx.invoice_lines(spark, sf_dir))
    return rules.points_by_category(found).select("doc_id", "financial", "legal")


@query("severity_counts", f"""WITH {_INVOICE}, {_RULES_SQL}
SELECT doc_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'informational') AS informational FROM found GROUP BY doc_id""")
def severity_counts(spark, sf_dir):
    found = rules.invoice_findings(fx.invoice_header(spark, sf_dir), fx.invoice_lines(spark, sf_dir))
    return found.groupBy("doc_id").agg(*(F.count_if(F.lower("severity") == s).alias(s) for s in dims.POINTS))


AS_OF = "1998-01-01"


@query("overdue_invoices", f"""WITH h AS (SELECT o_orderkey AS doc_id, CAST(CAST(o_orderdate AS DATE) + CAST(15 + o_orderkey % 90 AS INTEGER) AS DATE) AS due_date FROM orders)
SELECT doc_id, CAST(date_diff('day', due_date, DATE '{AS_OF}') AS INTEGER) AS days_late FROM h WHERE due_date < DATE '{AS_OF}'""")
def overdue_invoices(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_add(F.to_date("o_orderdate"), (15 + F.col("o_orderkey") % 90).cast("int")).alias("due_date"))
    return rules.overdue(o, AS_OF).select("doc_id", "days_late")


_SECTIONS_SQL = f"""
{fx.CONTRACTS_SQL}, l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM contracts),
l1 AS (SELECT *, trim(line) <> '' AND length(trim(line)) <= 80 AND trim(line) NOT LIKE '%.' AND ((upper(trim(line)) = trim(line) AND lower(trim(line)) <> trim(line))
    OR regexp_matches(trim(line), '^(#{{1,6}}\\s+)?(\\d+[.)]\\s+)?[A-Z][A-Za-z\\s\\-&/,]{{2,70}}$') OR regexp_matches(trim(line), '^(#{{1,6}}\\s+)?\\d+[.)]\\s+[A-Z]')) AS head FROM l0),
l2 AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l1),
l3 AS (SELECT doc_id, island, coalesce(max(trim(line)) FILTER (head), '') AS header, trim(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head)) AS body, count(*) FILTER (NOT head) AS n FROM l2 GROUP BY doc_id, island),
secs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS section, header, body FROM l3 WHERE n > 0),
dims(type_ord, clause_type, var_ord, variant) AS (VALUES {dims.header_values()}),
names AS (SELECT DISTINCT header, lower(header) AS name FROM secs),
matched AS (SELECT header, clause_type FROM (SELECT header, clause_type, row_number() OVER (PARTITION BY header ORDER BY type_ord, var_ord) AS nth
    FROM names JOIN dims ON name <> '' AND (contains(name, variant) OR contains(variant, name))) WHERE nth = 1),
firsts AS (SELECT doc_id, clause_type, body FROM (SELECT doc_id, clause_type, body, row_number() OVER (PARTITION BY doc_id, clause_type ORDER BY section) AS nth FROM secs JOIN matched USING (header)) WHERE nth = 1)"""


def _sections(spark, sf_dir):
    return docs_ops.sections(fx.contracts(spark, sf_dir))


def _clauses(spark, sf_dir):
    secs = _sections(spark, sf_dir)
    return docs_ops.first_clauses(secs, docs_ops.match_headers(secs, dims.clause_headers()))


@query("section_split", f"WITH {_SECTIONS_SQL} SELECT doc_id, CAST(section AS INTEGER) AS section, header, body FROM secs")
def section_split(spark, sf_dir):
    return _sections(spark, sf_dir)


@query("header_substring_match", f"WITH {_SECTIONS_SQL} SELECT names.header AS header, clause_type FROM names LEFT JOIN matched USING (header)")
def header_substring_match(spark, sf_dir):
    return docs_ops.match_headers(_sections(spark, sf_dir), dims.clause_headers())


@query("section_first_match", f"WITH {_SECTIONS_SQL} SELECT doc_id, clause_type, trim(substr(body, 1, 300)) AS raw_text FROM firsts")
def section_first_match(spark, sf_dir):
    return _clauses(spark, sf_dir).select("doc_id", "clause_type", "raw_text")


_CLAUSE_TYPES = ", ".join(f"('{t}')" for t in dims.CLAUSE_HEADERS)


@query("clause_fill", f"""WITH {_SECTIONS_SQL}, types(clause_type) AS (VALUES {_CLAUSE_TYPES})
SELECT contracts.doc_id, types.clause_type, firsts.body IS NOT NULL AS present FROM contracts CROSS JOIN types LEFT JOIN firsts ON firsts.doc_id = contracts.doc_id AND firsts.clause_type = types.clause_type""")
def clause_fill(spark, sf_dir):
    return docs_ops.fill_clauses(fx.contracts(spark, sf_dir), _clauses(spark, sf_dir), list(dims.CLAUSE_HEADERS)).select("doc_id", "clause_type", "present")


@query("required_clause_anti", f"""WITH {_SECTIONS_SQL}, req(clause_type, severity, category) AS (VALUES {", ".join(map(str, dims.CONTRACT_REQUIRED))})
SELECT doc_id, clause_type, severity, category FROM contracts CROSS JOIN req WHERE NOT EXISTS (SELECT 1 FROM firsts WHERE firsts.doc_id = contracts.doc_id AND firsts.clause_type = req.clause_type)""")
def required_clause_anti(spark, sf_dir):
    return rules.missing_clauses(fx.contracts(spark, sf_dir), _clauses(spark, sf_dir), dims.CONTRACT_REQUIRED)


@query("clause_days", f"""WITH {_SECTIONS_SQL}
SELECT doc_id, clause_type, TRY_CAST(nullif(regexp_extract(body, '(\\d+)\\s*day', 1), '') AS INTEGER) AS days FROM firsts WHERE clause_type IN ('payment_terms', 'notice_period')""")
def clause_days(spark, sf_dir):
    rows = _clauses(spark, sf_dir).filter("clause_type IN ('payment_terms', 'notice_period')")
    return rows.select("doc_id", "clause_type", tx.parse_days(F.col("value")).alias("days"))


@query("notice_short", f"""WITH {_SECTIONS_SQL}
SELECT doc_id, d AS days FROM (SELECT doc_id, TRY_CAST(nullif(regexp_extract(body, '(\\d+)\\s*day', 1), '') AS INTEGER) AS d FROM firsts WHERE clause_type = 'notice_period') WHERE d < 30""")
def notice_short(spark, sf_dir):
    return rules.short_notice(_clauses(spark, sf_dir)).select("doc_id", "days")


@query("terms_long", f"""WITH {_SECTIONS_SQL}
SELECT doc_id, d AS days FROM (SELECT doc_id, TRY_CAST(nullif(regexp_extract(body, '(\\d+)\\s*day', 1), '') AS INTEGER) AS d FROM firsts WHERE clause_type = 'payment_terms') WHERE d > 90""")
def terms_long(spark, sf_dir):
    return rules.long_terms(_clauses(spark, sf_dir)).select("doc_id", "days")


@query("ip_missing", f"""WITH {_SECTIONS_SQL} SELECT doc_id FROM firsts GROUP BY doc_id HAVING bool_or(clause_type = 'payment_amount') AND NOT bool_or(clause_type IN ('ip_assignment', 'ip_license'))""")
def ip_missing(spark, sf_dir):
    return rules.no_ip_clause(_clauses(spark, sf_dir)).select("doc_id")


@query("clause_filter", f"""WITH {_SECTIONS_SQL} SELECT doc_id, clause_type FROM firsts WHERE contains(lower(clause_type), 'pay')""")
def clause_filter(spark, sf_dir):
    return _clauses(spark, sf_dir).filter(F.col("present") & F.contains(F.lower("clause_type"), F.lit("pay"))).select("doc_id", "clause_type")


@query("governing_law", f"""WITH {fx.CONTRACTS_SQL} SELECT doc_id, trim(regexp_extract(text, 'governed by the laws of ([A-Za-z ,]+)\\.', 1)) AS governing_law FROM contracts""")
def governing_law(spark, sf_dir):
    from parchmint.operators.extract import governing_law as law

    return fx.contracts(spark, sf_dir).select("doc_id", law(F.col("text")).alias("governing_law"))


@query("money_first", f"""WITH {fx.CONTRACTS_SQL} SELECT doc_id, nullif(trim(regexp_extract(text, '\\$\\s*[\\d,]+(\\.\\d{{1,2}})?')), '') AS money FROM contracts""")
def money_first(spark, sf_dir):
    return fx.contracts(spark, sf_dir).select("doc_id", tx.first(F.col("text"), tx.MONEY).alias("money"))


@query("payment_terms_first", f"""WITH {fx.CONTRACTS_SQL} SELECT doc_id, nullif(regexp_extract(text, 'payable within \\d+ days'), '') AS terms FROM contracts""")
def payment_terms_first(spark, sf_dir):
    return fx.contracts(spark, sf_dir).select("doc_id", tx.first(F.col("text"), tx.PAYMENT_TERMS).alias("terms"))


@query("payment_terms_violation", f"""WITH {fx.CONTRACTS_SQL}, c AS (SELECT project_id, doc_id AS contract_id, TRY_CAST(nullif(regexp_extract(text, '(\\d+)\\s*days', 1), '') AS INTEGER) AS contract_days FROM contracts WHERE contains(text, 'payable within')),
i AS (SELECT o_custkey AS project_id, o_orderkey AS invoice_id, CAST(15 + o_orderkey % 90 AS INTEGER) AS invoice_days FROM orders)
SELECT project_id, contract_id, contract_days, invoice_id, invoice_days FROM c JOIN i USING (project_id) WHERE invoice_days > contract_days""")
def payment_terms_violation(spark, sf_dir):
    c = fx.contracts(spark, sf_dir).select("project_id", "doc_id", tx.first(F.col("text"), tx.PAYMENT_TERMS).alias("terms"))
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("invoice_date"))
    return rules.terms_violations(c, o.withColumn("due_date", F.date_add("invoice_date", (15 + F.col("doc_id") % 90).cast("int"))))


@query("changed_terms_violation", f"""WITH {fx.CONTRACTS_SQL}, c AS (SELECT project_id, doc_id AS contract_id, TRY_CAST(nullif(regexp_extract(text, '(\\d+)\\s*days', 1), '') AS INTEGER) AS contract_days, s_acctbal < 0 AS c_changed
  FROM contracts JOIN supplier ON s_suppkey = doc_id WHERE contains(text, 'payable within')),
i AS (SELECT o_custkey AS project_id, o_orderkey AS invoice_id, CAST(15 + o_orderkey % 90 AS INTEGER) AS invoice_days, o_orderstatus = 'P' AS i_changed FROM orders WHERE o_orderkey % 4 <> 0)
SELECT project_id, contract_id, contract_days, invoice_id, invoice_days FROM c JOIN i USING (project_id) WHERE invoice_days > contract_days AND (c_changed OR i_changed)""")
def changed_terms_violation(spark, sf_dir):
    """Violations that involve a contract or an invoice that changed, from texts: terms out of contracts, dates out of invoices in three forms."""
    from parchmint.operators import analysis
    from parchmint.plans import mixed

    state = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_acctbal") < 0).alias("changed"))
    c = fx.contracts(spark, sf_dir).join(state, "doc_id").select("project_id", "doc_id", "changed", tx.first(F.col("text"), tx.PAYMENT_TERMS).alias("terms"))
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("project_id"), (F.col("o_orderstatus") == "P").alias("changed"))
    # Only invoices of projects with contracts can violate terms: the others aren't rendered.
    orders = orders.join(c.select("project_id").distinct(), "project_id", "left_semi")
    texts = mixed.invoice_heads(spark, sf_dir, orders.select("doc_id")).select("doc_id", fx.once(analysis.fd.dates(F.col("full_text"))).alias("d"))
    dated = texts.select("doc_id", F.try_element_at("d", F.lit(1)).alias("invoice_date"), F.try_element_at("d", F.lit(2)).alias("due_date"))
    return rules.changed_violations(c, orders.join(dated, "doc_id"))


@query("revenue_discrepancy", """WITH i AS (SELECT o_custkey AS project_id, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS invoiced FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS project_id, CAST(100000 + c_acctbal * 10 AS DECIMAL(18,2)) AS revenue FROM customer)
SELECT project_id, CAST(invoiced AS DOUBLE) AS invoiced FROM i JOIN s USING (project_id) WHERE invoiced > revenue""")
def revenue_discrepancy(spark, sf_dir):
    s = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), (100000 + F.col("c_acctbal") * 10).alias("revenue"))
    i = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_totalprice").alias("total_amount"))
    return rules.revenue_discrepancies(s, i).select("project_id", F.col("invoiced").cast("double").alias("invoiced"))


@query("fs_ratios", f"WITH {fx.STATEMENTS_SQL} SELECT doc_id, gross_margin_pct, net_margin_pct, current_ratio, debt_to_equity, return_on_equity_pct, return_on_assets_pct FROM fs")
def fs_ratios(spark, sf_dir):
    return rules.ratios(fx.statements(spark, sf_dir)).select("doc_id", "gross_margin_pct", "net_margin_pct", "current_ratio", "debt_to_equity", "return_on_equity_pct", "return_on_assets_pct")


@query("fs_anomalies", f"""WITH {fx.STATEMENTS_SQL}
SELECT doc_id, 'Negative Equity (Technical Insolvency)' AS title, 'critical' AS severity FROM fs WHERE total_equity < 0
UNION ALL SELECT doc_id, 'Low Current Ratio', 'warning' FROM fs WHERE current_ratio < 1
UNION ALL SELECT doc_id, 'High Debt-to-Equity Ratio', 'warning' FROM fs WHERE debt_to_equity > 3
UNION ALL SELECT doc_id, 'Negative Gross Margin', 'critical' FROM fs WHERE gross_margin_pct < 0
UNION ALL SELECT doc_id, 'Large Net Loss Relative to Revenue', 'warning' FROM fs WHERE revenue > 0 AND net_income < 0 AND abs(net_income) / revenue * 100 > 20
UNION ALL SELECT doc_id, 'Balance Sheet Does Not Balance', 'critical' FROM fs WHERE total_assets > 0 AND abs(total_assets - (total_liabilities + total_equity)) / total_assets > 0.02
UNION ALL SELECT doc_id, 'Unaudited Financial Statement', 'informational' FROM fs WHERE NOT audited""")
def fs_anomalies(spark, sf_dir):
    return rules.statement_findings(rules.ratios(fx.statements(spark, sf_dir))).select("doc_id", "title", "severity")


@query("rfp_weights", """SELECT p_brand AS doc_id, CAST(sum(p_size) AS BIGINT) AS total_weight FROM part GROUP BY p_brand HAVING abs(sum(p_size) - 100) > 2""")
def rfp_weights(spark, sf_dir):
    c = fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("weight_pct"))
    return rules.rfp_weights(c).select("doc_id", "total_weight")


@query("project_doc_counts", "SELECT c_custkey AS project_id, c_name AS name, count(o_orderkey) AS doc_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def project_doc_counts(spark, sf_dir):
    n = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("doc_count"))
    p = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))
    return p.join(n, "project_id", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("long")))


@query("project_documents_desc", "SELECT o_orderkey AS doc_id, o_custkey AS project_id, 'pending' AS crm_status FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC")
def project_documents_desc(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").filter("o_custkey = 7").orderBy(F.desc("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("project_id"), F.coalesce(F.lit(None).cast("string"), F.lit("pending")).alias("crm_status"))


@query("doc_point_lookup", "SELECT o_orderkey AS doc_id, o_orderstatus AS status FROM orders WHERE o_orderkey = 42")
def doc_point_lookup(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").filter("o_orderkey = 42").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))


@query("contradictions_distinct", f"""WITH {fx.CONTRACTS_SQL}, c AS (SELECT project_id, doc_id AS contract_id, TRY_CAST(nullif(regexp_extract(text, '(\\d+)\\s*days', 1), '') AS INTEGER) AS contract_days FROM contracts WHERE contains(text, 'payable within')),
i AS (SELECT o_custkey AS project_id, o_orderkey AS invoice_id, CAST(15 + o_orderkey % 90 AS INTEGER) AS invoice_days FROM orders),
sums AS (SELECT o_custkey AS project_id, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS invoiced FROM orders GROUP BY 1),
v AS (SELECT project_id, 'Payment Terms Violation' AS title, 'The invoice demands payment in ' || invoice_days || ' days, but the governing contract mandates a ' || contract_days || '-day term.' AS description,
  CAST(contract_id AS VARCHAR) AS doc1_name, contract_days || ' days' AS doc1_value, CAST(invoice_id AS VARCHAR) AS doc2_name, invoice_days || ' days' AS doc2_value FROM c JOIN i USING (project_id) WHERE invoice_days > contract_days
  UNION ALL SELECT project_id, 'Revenue Discrepancy', 'The sum of project invoices exceeds the total revenue reported in the financial statement.', c_name, '$' || format('{{:,.2f}}', 100000 + c_acctbal * 10), 'Sum of Invoices', '$' || format('{{:,.2f}}', CAST(invoiced AS DOUBLE))
  FROM sums JOIN customer ON c_custkey = project_id WHERE invoiced > CAST(100000 + c_acctbal * 10 AS DECIMAL(18,2)))
SELECT project_id, title, description, doc1_name, doc1_value, doc2_name, doc2_value FROM (SELECT *, row_number() OVER (PARTITION BY project_id, description ORDER BY title, doc1_name, doc2_name) AS nth FROM v) WHERE nth = 1""")
def contradictions_distinct(spark, sf_dir):
    v, name = payment_terms_violation(spark, sf_dir), lambda c: F.col(c).cast("string")
    terms = v.select("project_id", name("contract_id").alias("contract_name"), F.concat("contract_days", F.lit(" days")).alias("contract_value"), name("invoice_id").alias("invoice_name"), "invoice_days")
    s = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), (100000 + F.col("c_acctbal") * 10).alias("revenue"))
    i = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_totalprice").alias("total_amount"))
    found = rules.distinct_descriptions(records.contradictions(terms, rules.revenue_discrepancies(s, i)))
    return found.select("project_id", "title", "description", "doc1_name", "doc1_value", "doc2_name", "doc2_value")


@query("json_stage_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_stage_extract(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("content_hash_dedup", "SELECT sha256(text) AS content_hash, max(doc_id) AS doc_id, count(*) AS n_versions FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return docs_ops.latest_by_key(d, "content_hash", "doc_id")


@query("email_counts", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS n_emails FROM documents")
def email_counts(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.size(tx.emails(F.col("text"))).cast("long").alias("n_emails"))


@query("summary_squash", "SELECT doc_id, substr(trim(regexp_replace(substr(text, 1, 400), '[ \\t\\n\\r]+', ' ', 'g')), 1, 500) AS summary FROM documents")
def summary_squash(spark, sf_dir):
    t = F.trim(F.regexp_replace(F.substring("text", 1, 400), r"[ \t\n\r]+", " "))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.substring(t, 1, 500).alias("summary"))


_EVENTS_SQL = """ev AS (SELECT user_id AS client_id, event_id AS seq, ts, ['ingestion', 'classification', 'extraction', 'anomaly', 'risk', 'cross_document'][1 + event_id % 6] AS stage,
  CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'complete' ELSE 'error' END AS status, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS detail FROM events),
folded AS (SELECT client_id, stage, arg_max(status, (ts, seq)) AS status, arg_max(detail, (ts, seq)) FILTER (detail <> '') AS detail FROM ev GROUP BY 1, 2)"""


def _events(spark, sf_dir):
    stage = F.element_at(F.array(*map(F.lit, dims.STAGES)), (1 + F.col("event_id") % 6).cast("int"))
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "complete").otherwise("error")
    return fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("client_id"), F.col("event_id").alias("seq"), "ts", stage.alias("stage"), status.alias("status"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("detail"))


@query("stage_latest", f"WITH {_EVENTS_SQL} SELECT * FROM folded")
def stage_latest(spark, sf_dir):
    return docs_ops.stage_fold(_events(spark, sf_dir))


@query("stage_catch_up", f"""WITH {_EVENTS_SQL}, i AS (SELECT *, list_position(['ingestion', 'classification', 'extraction', 'anomaly', 'risk', 'cross_document'], stage) AS p FROM folded)
SELECT client_id, stage, CASE WHEN p < max(p) OVER (PARTITION BY client_id) AND status IN ('pending', 'running') THEN 'complete' ELSE status END AS status FROM i""")
def stage_catch_up(spark, sf_dir):
    return docs_ops.stage_catch_up(docs_ops.stage_fold(_events(spark, sf_dir))).select("client_id", "stage", "status")


@query("stage_durations", f"WITH {_EVENTS_SQL} SELECT client_id, stage, CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS seconds FROM ev GROUP BY 1, 2")
def stage_durations(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("client_id", "stage").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))


_WORKSPACE_SQL = f"""{_EVENTS_SQL}, e2 AS (SELECT ev.*, CASE WHEN status = 'error' THEN 'failed ' || seq END AS error, CASE WHEN seq % 5 = 0 THEN props ELSE '' END AS data FROM ev JOIN events ON event_id = seq),
w AS (SELECT client_id, stage, arg_max(status, (ts, seq)) AS status, arg_max(coalesce(error, ''), (ts, seq)) AS error, max((ts, seq)) AS at, arg_max(detail, (ts, seq)) FILTER (detail <> '') AS detail, arg_max(data, (ts, seq)) FILTER (data <> '') AS data FROM e2 GROUP BY 1, 2),
g AS (SELECT DISTINCT client_id FROM ev), d AS (SELECT client_id, bool_or(stage = 'risk' AND status = 'complete') AS done FROM ev GROUP BY 1),
s AS (SELECT g.client_id, n.i, n.stage, coalesce(w.status, CASE WHEN n.i = 1 THEN 'running' ELSE 'pending' END) AS status, w.error, w.at, w.detail, w.data FROM g CROSS JOIN
  (SELECT unnest(range(1, 7)) AS i, unnest(['ingestion', 'classification', 'extraction', 'anomaly', 'risk', 'cross_document']) AS stage) n LEFT JOIN w ON w.client_id = g.client_id AND w.stage = n.stage),
u AS (SELECT s.*, status IN ('pending', 'running') AND EXISTS (SELECT 1 FROM s l WHERE l.client_id = s.client_id AND l.i > s.i AND l.at IS NOT NULL AND (s.at IS NULL OR l.at > s.at)) AS up FROM s),
f AS (SELECT client_id, stage, CASE WHEN up THEN 'complete' ELSE status END AS status, CASE WHEN up THEN 'Completed successfully' ELSE detail END AS detail, data, nullif(error, '') AS error FROM u)"""


@query("workspace_fold", f"""WITH {_WORKSPACE_SQL}
SELECT f.*, CASE WHEN done THEN 'completed' WHEN bool_or(status = 'error') OVER (PARTITION BY client_id) THEN 'failed' ELSE 'processing' END AS document_status FROM f JOIN d USING (client_id)""")
def workspace_fold(spark, sf_dir):
    props = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "props")
    events = _events(spark, sf_dir).join(props, "seq").withColumns({
        "error": F.when(F.col("status") == "error", F.concat(F.lit("failed "), F.col("seq").cast("string"))), "data": F.when(F.col("seq") % 5 == 0, F.col("props")).otherwise(""),
    })
    return workspace.fold(events).select("client_id", F.explode("stages").alias("s"), "document_status").select("client_id", "s.*", "document_status")


@query("stage_runs", f"""WITH {_EVENTS_SQL}, n AS (SELECT *, lead(status) OVER w AS nxt, lead(ts) OVER w AS ended, count(*) FILTER (status = 'running') OVER w AS run FROM ev WINDOW w AS (PARTITION BY client_id, stage ORDER BY ts, seq))
SELECT client_id, stage, run, CASE WHEN nxt = 'running' THEN 'restarted' WHEN nxt IS NULL THEN 'running' ELSE nxt END AS outcome, CASE WHEN nxt IN ('complete', 'error') THEN (epoch_us(ended) - epoch_us(ts)) / 1e6 END AS seconds FROM n WHERE status = 'running'""")
def stage_runs(spark, sf_dir):
    return workspace.runs(_events(spark, sf_dir))


@query("ocr_block_agg", """WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS block_num, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS word_no,
  l_shipmode AS text FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
q AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS block_num, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT w.doc_id, w.block_num, string_agg(text, ' ' ORDER BY word_no) AS text, max(s * 2 < 50 * n) AND length(string_agg(text, ' ')) > 5 AS low_quality FROM w JOIN q ON w.doc_id = q.doc_id AND w.block_num = q.block_num GROUP BY 1, 2""")
def ocr_block_agg(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey", F.col("l_linenumber") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    w = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("l_linenumber") % 2).alias("block_num"), F.lit(1).alias("par_num"), F.row_number().over(order).alias("word_no"),
        F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_quantity") * 2).alias("conf"), *(F.lit(1.0).alias(c) for c in ("left", "top", "width", "height")),
    )
    return docs_ops.ocr_blocks(w).select("doc_id", "block_num", "text", "low_quality")


@query("centroids", """WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) AS n FROM embeddings),
m AS (SELECT label, pos, avg(CAST(x AS DOUBLE) / n) AS x FROM u GROUP BY 1, 2), s AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT m.label, CAST(pos - 1 AS INTEGER) AS pos, round(x / n, 6) AS x FROM m JOIN s USING (label)""")
def centroids(spark, sf_dir):
    c = docs_ops.centroids(fx.table(spark, sf_dir, "embeddings"))
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("nearest_centroid", """WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))) AS n FROM embeddings),
m AS (SELECT label, pos, avg(CAST(x AS DOUBLE) / n) AS x FROM u GROUP BY 1, 2), s AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1),
c AS (SELECT m.label, list(x / n ORDER BY pos) AS v FROM m JOIN s USING (label) GROUP BY 1),
d AS (SELECT vec_id, c.label, list_inner_product(CAST(embedding AS DOUBLE[]), v) AS score FROM embeddings CROSS JOIN c)
SELECT vec_id, arg_max(label, (score, -label)) AS nearest FROM d GROUP BY vec_id""")
def nearest_centroid(spark, sf_dir):
    v = fx.table(spark, sf_dir, "embeddings")
    return docs_ops.nearest_centroid(v, docs_ops.centroids(v)).select("vec_id", "nearest")
