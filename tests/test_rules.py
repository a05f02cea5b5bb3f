"""Hand-derived fixtures of the rules."""

from pyspark.sql import functions as F

from parchmint.functions import text as tx
from parchmint.operators import documents, rules


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_days(spark):
    for text, days in (("30 days", 30), ("3 months", 90), ("2 years", 730), ("within 2 weeks", 14), ("thirty (30) days", None), ("30 calendar days", None), ("Net 30", None), ("", None)):
        assert value(spark, tx.parse_days, text) == days


def test_numbers(spark):
    for text, number in (("£1,200,000", 1200000.0), ("42.5 million", 42500000.0), ("5k", 5000.0), ("2 M", 2000000.0), ("-5", 5.0), ("1.2.3", None), ("", None)):
        assert value(spark, tx.parse_number, text) == number


def test_dates(spark):
    strict = lambda c: tx.parse_date_strict(c).cast("string")
    loose = lambda c: tx.parse_date_loose(c).cast("string")
    for text, a, b in (
        ("March 15, 2024", "2024-03-15", "2024-03-15"), ("March 15 2024", "2024-03-15", None), ("15/03/2024", "2024-03-15", "2024-03-15"),
        ("03/15/2024", "2024-03-15", None), ("15-Jun-2026", None, "2026-06-15"), ("15.03.2024", "2024-03-15", "2024-03-15"), ("2024/03/15", None, "2024-03-15"), ("5/3/24", None, None),
    ):
        assert (value(spark, loose, text), value(spark, strict, text)) == (a, b), text


def test_invoice_and_risk(spark):
    lines = spark.createDataFrame(
        [(1, 1, "Widget", 2.0, 10.0, 20.0), (1, 2, " widget ", 1.0, 20.0, 20.0), (1, 3, "Gadget", 3.0, 5.0, 16.0), (1, 4, "Freebie", 1.0, 0.0, 0.0)],
        "doc_id long, line_no int, description string, quantity double, unit_price double, amount double",
    )
    header = spark.createDataFrame([(1, 60.0, 6.0, 0.0, 66.0)], "doc_id long, subtotal double, tax_amount double, discount double, total_amount double")
    found = rules.invoice_findings(header, lines)
    assert sorted(r["severity"] for r in found.collect()) == ["critical", "critical", "informational", "warning"]
    docs = spark.createDataFrame([(1, "invoice"), (2, "contract"), (3, "other")], "doc_id long, doc_type string")
    risk = {r["doc_id"]: r for r in rules.risk(docs, found).collect()}
    assert (risk[1]["penalty"], risk[1]["overall_score"], risk[1]["risk_level"]) == (36, 51, "Medium")
    assert [risk[i]["overall_score"] for i in (2, 3)] == [15, 5] and risk[2]["risk_level"] == "Low"


def test_sections(spark):
    text = "\n".join(["ACME SERVICES AGREEMENT", "", "1. Payment Terms", "Net 45 days from invoice.", "2. Term", "TERMINATION", "Either party may terminate on 60 days notice.", "Governing"])
    got = documents.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()
    assert [(r["header"], r["body"]) for r in got] == [
        ("ACME SERVICES AGREEMENT", ""), ("1. Payment Terms", "Net 45 days from invoice."), ("TERMINATION", "Either party may terminate on 60 days notice."),
    ]


def test_ocr_cleanup(spark):
    assert value(spark, tx.clean_ocr, "docu- ment b|ock , ok") == "document block, ok"


def test_centroid(spark):
    protos = spark.createDataFrame([("A", [1.0, 0.0]), ("A", [0.6, 0.8]), ("B", [0.0, 1.0])], "label string, embedding array<double>")
    got = {r["label"]: [round(x, 6) for x in r["centroid"]] for r in documents.centroids(protos).collect()}
    assert got == {"A": [0.894427, 0.447214], "B": [0.0, 1.0]}


def test_upsert_keeps_the_latest(spark):
    rows = spark.createDataFrame([("h", 1, "a"), ("h", 2, "b"), ("g", 1, "c")], "content_hash string, version int, name string")
    got = {r["content_hash"]: (r["name"], r["n_versions"]) for r in documents.latest_by_key(rows, "content_hash", "version").collect()}
    assert got == {"h": ("b", 2), "g": ("c", 1)}
