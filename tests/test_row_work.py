"""Work on a row is done once, is dealt out over tasks, and runs no pattern or format that can't match."""

from pyspark.sql import functions as F

from parchmint.functions import fields as fd
from parchmint.functions import text as tx
from parchmint.operators import analysis, rules, validators
from parchmint.plans import extraction_queries, mixed, queries, varied_records
from parchmint.plans import fixtures as fx

TEXTS = (
    "March 5, 2024", "march 5 2024", "5 March 2024", "5 March, 2024", "05/03/2024", "3/25/2024", "2024-03-05", "5-3-2024", "3-25-2024", "5.3.2024", "5 Mar 2024", "5-Mar-2024", "May 5, 2024", "5 May 2024",
    "March  5, 2024", "+12024-03-05", "2024-3", "31/02/2024", "", " ", "x", "12024-01-01", "5--3-2024", "a, b, c", "1 2 3", "2024/03/05", "-", "5/3/24", "March 5th, 2024",
)


def test_shapes_of_dates_lose_none(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for formats, parse, clean in (
        (tx.LOOSE_FORMATS, tx.parse_date_loose, lambda t: F.rtrim(tx.strip(t), F.lit(".,;"))),
        (tx.STRICT_FORMATS, tx.parse_date_strict, lambda t: F.trim(F.regexp_replace(t, r"[^A-Za-z0-9]", "-"), F.lit("-"))),
    ):
        every = F.coalesce(*(F.to_date(F.try_to_timestamp(clean(F.col("t")), F.lit(f))) for f in formats))
        assert rows.filter(~parse(F.col("t")).eqNullSafe(every)).collect() == []
        assert rows.filter(parse(F.col("t")).isNotNull()).count() >= 8


def test_answers_are_parsed_once(spark):
    """The clauses of an answer were read again for each of the types."""
    raw = spark.createDataFrame([(1, "{}")], "doc_id long, payload string")
    assert len(validators.contract(raw).collect()[0]["clauses"]) == 18
    value = validators._clauses(F.parse_json(F.lit('{"clauses": [{"clause_type": "term", "status": "present"}]}')), ("term", "fees"), "status")
    assert [c["status"] for c in spark.range(1).select(value.alias("c")).collect()[0]["c"]] == ["present", "missing"]
    assert not value._jc.toString().startswith("transform(array(term")


def test_small_files_are_dealt_out(spark, sf_dir):
    """All rows of a small file were one task's."""
    for rows in (mixed.nda_docs(spark, sf_dir), mixed.contract_docs(spark, sf_dir), mixed.other_docs(spark, sf_dir), extraction_queries.invoice_texts(spark, sf_dir), varied_records._raw(spark, sf_dir, varied_records._NDA)):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_numbers_make_their_text_once(spark):
    """The match of an amount's pattern was made again for each look at its scale."""
    column = tx.parse_number(F.regexp_substr("t", F.lit("[0-9.]+ ?[a-zA-Z]*")))
    assert column._jc.toString().count("regexp_substr") == 1
    rows = spark.createDataFrame([("1.5 Million",), ("2k",), ("7",), ("x",), (None,), ("1.2.3",), ("3 b",)], "t string")
    assert [r[0] for r in rows.select(column).collect()] == [1.5e6, 2000.0, 7.0, None, None, None, 3e9]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_and_types_are_made_once(spark, sf_dir):
    """What a lambda names once was made within it, for each type of clause or each date."""
    contracts = analysis.payloads(mixed.contract_docs(spark, sf_dir).selectExpr("doc_id", "'contract' AS doc_type", "full_text", f"CAST(NULL AS array<{analysis.ELEMENT}>) AS elements"), fuzzy=False)
    dated = analysis.classified(mixed.documents(spark, sf_dir)).select("dates")
    parted = lambda df, made: any("Generate " in line and f"[{made}#" in line for line in _plan(df).splitlines())
    assert parted(contracts.select("contract"), "secs") and parted(dated, "pages")


def test_a_group_runs_its_pattern_once(spark):
    rows = spark.createDataFrame([("No: A1",), ("No: ",), (None,)], "t string").select(F.when(F.col("t") != "", fd.group(F.col("t"), r"No: *(\w*)")).alias("g"))
    assert _plan(rows).count("regexp_extract") == 1
    assert [r[0] for r in rows.collect()] == ["A1", None, None]


def test_amounts_of_lower_case_text(spark):
    texts = ("SUBTOTAL: $1,250.50", "Sub-Total 7", "Grand TOTAL:\n12.345", "total", "x", "", None, "Subtotal: ,", "VAT amount 20% 3.5", "TAX: .5")
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for field in fd.AMOUNT_LABELS:
        assert rows.filter(~fd.labelled_amount(F.col("t"), field).eqNullSafe(fd.labelled_amount(F.col("t"), field, F.lower("t")))).count() == 0
    assert [r[0] for r in rows.select(fd.labelled_amount(F.col("t"), "subtotal", F.lower("t"))).collect()] == [1250.5, 7.0, *[None] * 8]


def test_findings_are_made_once(spark, sf_dir):
    """The findings were made for their documents and again for the points; invoices of projects without contracts were rendered."""
    assert _plan(queries.risk_category_pivot(spark, sf_dir)).count("l_extendedprice") < _plan(rules.risk(*_twice(spark, sf_dir))).count("l_extendedprice")
    every, some = mixed.invoice_heads(spark, sf_dir), mixed.invoice_heads(spark, sf_dir, spark.createDataFrame([(1,)], "doc_id long"))
    assert some.count() == 1 < every.count()


def _twice(spark, sf_dir):
    found = rules.invoice_findings(fx.invoice_header(spark, sf_dir), fx.invoice_lines(spark, sf_dir))
    return found.select("doc_id", F.lit("invoice").alias("doc_type")).distinct(), found


def test_payloads_are_not_judged(spark, sf_dir):
    """Findings were made for queries that return none of them, and their texts for queries that count them."""
    assert all("Subtotal Reconciliation Failed" not in _plan(f(spark, sf_dir)) for f in (mixed.document_payloads, mixed.document_clauses, mixed.typed_payloads, mixed.document_records, mixed.document_risk))
    docs = mixed.documents(spark, sf_dir).filter("crc32(doc_id) % 40 = 0").persist()
    whole = analysis.analyse(docs, "1998-01-01", fuzzy=False)
    brief = analysis.analyse(docs, "1998-01-01", fuzzy=False, fields=mixed.COUNTED)
    shown = lambda df, *columns: sorted(map(repr, df.selectExpr("doc_id", "doc_type", "error", *columns).collect()))
    same = ("record", "risk", "transform(findings, f -> struct(f.severity, f.category)) AS found")
    assert shown(whole, *same) == shown(brief, *same)
    assert shown(whole, "to_json(payload) AS p") == shown(analysis.variants(docs, fuzzy=False), "to_json(payload) AS p")
