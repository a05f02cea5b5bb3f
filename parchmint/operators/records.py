"""What goes to a customer record and to lists: severity counts, parties, key fields, retries, project contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.fields import money_text, title_case
from parchmint.functions.text import strip

# Clause types among key fields; fields of the other types with their names.
KEY_CLAUSES = ("payment terms", "termination", "liability cap", "ip assignment", "confidentiality period", "non compete", "confidentiality")
KEY_FIELDS = {
    "invoice": {"Invoice Number": "invoice_number", "Due Date": "due_date", "Total Amount": "total_amount", "Tax": "tax_amount", "Currency": "currency"},
    "financial_statement": {
        "Revenue": "revenue", "Expenses": "operating_expenses", "Net Profit": "net_income", "Assets": "total_assets", "Liabilities": "total_liabilities", "Reporting Period": "reporting_period",
    },
    "rfp": {"Issuer": "issuer", "Deadline": "submission_deadline", "Budget": "budget", "Project Title": "project_title"},
}
NO_FIELDS = "No specific key fields extracted."


def severity_counts(findings: DataFrame) -> DataFrame:
    low = F.lower("severity")
    return findings.groupBy("doc_id").agg(
        F.count_if(low == "critical").alias("critical"), F.count_if(low == "warning").alias("warning"), F.count_if(low.isin("informational", "info")).alias("informational")
    )


def invoice_parties(vendor: Column, bill_to: Column) -> Column:
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))
    return F.concat(name(vendor), F.lit(" -> "), name(bill_to))


def joined_parties(names: Column) -> Column:
    """Names joined by &, Unknown for none."""
    clean = F.transform(names, lambda n: strip(F.replace(F.coalesce(n, F.lit("Unknown")), F.lit("\n"), F.lit(" "))))
    return F.when(F.size(names) > 0, F.array_join(clean, " & ")).otherwise("Unknown")


def field_lines(pairs: list[tuple[str, Column]]) -> Column:
    """A line per field that has a value and isn't zero."""
    line = lambda k, v: F.when((v.cast("string") != "") & ~F.coalesce(v.cast("string").try_cast("double") == 0, F.lit(False)), F.concat(F.lit(f"• {k}: "), v.cast("string")))
    made = F.array_compact(F.array(*(line(k, v) for k, v in pairs)))
    return F.when(F.size(made) > 0, F.array_join(made, "\n")).otherwise(NO_FIELDS)


def key_fields(rows: DataFrame, doc_type: str) -> DataFrame:
    """(doc_id, key_fields) of invoices, statements or proposals: a line per field that has a value and isn't zero.

    Fields that the rows don't have are left out.
    """
    kinds = dict(rows.dtypes)
    plain = lambda c: F.regexp_replace(F.col(c).cast("decimal(30,10)").cast("string"), r"(\.\d+?)0+$", "$1") if kinds[c] == "double" else F.col(c)
    return rows.select("doc_id", field_lines([(k, plain(c)) for k, c in KEY_FIELDS[doc_type].items() if c in kinds]).alias("key_fields"))


def clause_lines(clauses: Column) -> Column:
    """A line per key clause of an array of clauses, in its order; Present where it has no value, found or not."""
    named = F.filter(F.transform(clauses, lambda c: F.struct(title_case(c["clause_type"]).alias("k"), c["value"].alias("v"))), lambda c: F.lower(c["k"]).isin(*KEY_CLAUSES))
    line = lambda c: F.concat(F.lit("• "), c["k"], F.lit(": "), F.coalesce(F.nullif(c["v"], F.lit("")), F.lit("Present")))
    return F.when(F.size(named) > 0, F.array_join(F.transform(named, line), "\n")).otherwise(NO_FIELDS)


def key_clauses(clauses: DataFrame) -> DataFrame:
    """(doc_id, key_fields) of contracts: a line per key clause type in its order (column ord), Present where it has no value, found or not."""
    rows = clauses.withColumn("k", title_case(F.col("clause_type"))).withColumn("hit", F.lower("k").isin(*KEY_CLAUSES))
    line = F.when(F.col("hit"), F.struct("ord", F.concat(F.lit("• "), "k", F.lit(": "), F.coalesce(F.nullif("value", F.lit("")), F.lit("Present"))).alias("line")))
    made = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return made.select("doc_id", F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).otherwise(NO_FIELDS).alias("key_fields"))


def record(docs: DataFrame, parties: DataFrame, fields: DataFrame, risk: DataFrame, findings: DataFrame) -> DataFrame:
    """One record per document, keyed by content_hash for an upsert; texts capped at 2000, absent parts by their defaults.

    docs: doc_id, name, doc_type, content_hash, processed_at; parties: doc_id, parties; fields: doc_id, key_fields; risk: doc_id, overall_score.
    """
    rows = docs.join(parties, "doc_id", "left").join(fields, "doc_id", "left").join(risk.select("doc_id", "overall_score"), "doc_id", "left").join(severity_counts(findings), "doc_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "content_hash", "doc_id", "name", F.substring(title_case(F.coalesce("doc_type", F.lit("Unknown"))), 1, 100).alias("document_type"),
        F.substring(F.coalesce("parties", F.lit("Unknown")), 1, 2000).alias("parties"), F.substring(F.coalesce("key_fields", F.lit(NO_FIELDS)), 1, 2000).alias("key_fields"),
        n("overall_score").alias("risk_score"), n("critical").alias("critical"), n("warning").alias("warning"), n("informational").alias("informational"), "processed_at",
    )


def simulated_sync(docs: DataFrame) -> DataFrame:
    """Without a service to send to, documents count as sent."""
    return docs.withColumn("crm_status", F.lit("synced"))


def retry_eligible(docs: DataFrame) -> DataFrame:
    return docs.filter("status = 'completed' AND coalesce(crm_status, 'pending') IN ('failed', 'pending')")


def contradictions(terms: DataFrame, revenue: DataFrame) -> DataFrame:
    """Rows of both cross-document checks in one shape, with their texts.

    terms: project_id, contract_name, contract_value, invoice_name, invoice_days; revenue: project_id, name, revenue, invoiced.
    """
    days = F.concat(F.col("invoice_days").cast("string"), F.lit(" days"))
    most = F.regexp_extract(F.lower("contract_value"), r"(\d+)\s*days", 1)
    # The texts of the findings.
    late = F.concat(F.lit("The invoice demands payment in "), days, F.lit(", but the governing contract mandates a "), most, F.lit("-day term."))
    more = F.lit("The sum of project invoices exceeds the total revenue reported in the financial statement.")
    a = terms.select("project_id", F.lit("Payment Terms Violation").alias("title"), late.alias("description"),
                     F.col("contract_name").alias("doc1_name"), F.concat(most, F.lit(" days")).alias("doc1_value"), F.col("invoice_name").alias("doc2_name"), days.alias("doc2_value"))
    b = revenue.select("project_id", F.lit("Revenue Discrepancy").alias("title"), more.alias("description"),
                       F.col("name").alias("doc1_name"), money_text(F.col("revenue")).alias("doc1_value"), F.lit("Sum of Invoices").alias("doc2_name"), money_text(F.col("invoiced")).alias("doc2_value"))
    return a.unionByName(b)


def compared(docs: DataFrame) -> DataFrame:
    """docs of a project that are completed, with how many take part in a comparison; a lone document is skipped."""
    n = F.count("*").over(Window.partitionBy("project_id"))
    return docs.filter("status = 'completed'").withColumn("documents_compared", n).withColumn("stage_status", F.when(F.col("documents_compared") > 1, "complete").otherwise("skipped"))


def stages_of(docs: DataFrame) -> DataFrame:
    """docs with analysis_data parsed as a variant: null where it isn't JSON."""
    return docs.withColumn("stages", F.try_parse_json("analysis_data")).drop("analysis_data")
