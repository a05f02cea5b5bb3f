"""Extractors, validators, files and streams on hand-made inputs."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from parchmint.functions import fields as fd
from parchmint.operators import classify, elements, extract, records, rules, validators
from parchmint.operators import documents as dc
from parchmint import dims
from parchmint.sources import office
from parchmint.streaming import stages, upserts

ELEMENT = "doc_id int, page_no int, el_no int, type string, text string, items array<string>, headers array<string>, rows array<array<string>>"


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id int, full_text string")


def brute_ratio(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    short, long = sorted((a, b), key=len)
    windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
    return max(200 * lcs(short, w) / (len(short) + len(w)) for w in windows)


def test_partial_ratio_equals_brute_force():
    for a in ("termination", "fees & payment", "payments", "6. limitation of liabilty", "x", "recitals of the agreement"):
        for b in ("termination for cause", "fees and payment", "limitation of liability", "liability cap", "term"):
            assert abs(extract.partial_ratio(a, b) - brute_ratio(a, b)) < 1e-9, (a, b)
    assert extract.partial_ratio("", "term") == 0


def test_headers(spark):
    heads = spark.createDataFrame([("2. Fees and Payment",), ("Termination for Convenience",), ("Confidentiality Period",), ("Term",), ("Limitaton of Liabilty",), ("Zyx Qwk",), ("",)], "header string")
    found = {r.header: r.clause_type for r in extract.match_headers_fuzzy(heads, dims.clause_headers()).collect()}
    assert found == {"2. Fees and Payment": "payment_terms", "Termination for Convenience": "termination_for_cause", "Confidentiality Period": "confidentiality", "Term": "payment_terms", "Limitaton of Liabilty": "liability_cap", "Zyx Qwk": None}
    plain = {r.header: r.clause_type for r in dc.match_headers(heads.filter("header <> ''"), dims.clause_headers()).collect()}
    assert plain["Term"] == "payment_terms" and plain["2. Fees and Payment"] == "payment_terms" and plain["Zyx Qwk"] is None


def test_sections(spark):
    lines = ["ACME SERVICES AGREEMENT", "", "1. Payment Terms", "Net 45 days from invoice.", "2. Term", "TERMINATION", "Either party may terminate on 60 days notice.", "Governing"]
    got = [(r.header, r.body) for r in dc.sections(texts(spark, "\n".join(lines)), "full_text").orderBy("section").collect()]
    assert got == [("ACME SERVICES AGREEMENT", ""), ("1. Payment Terms", lines[3]), ("TERMINATION", lines[6])]


def test_nda(spark):
    t = texts(spark, "MUTUAL AGREEMENT\nBoth parties agree.\nExclusions\nPublic facts.\nConfidentiality Period\nKept for 10 years.\nThis is governed by the laws of Utopia.", "", None)
    clauses, head = extract.nda(t)
    assert clauses.groupBy("doc_id").count().filter("count <> 14").count() == 0
    assert {r.clause_type for r in clauses.filter("doc_id = 0 AND present").collect()} == {"exclusions", "confidentiality"}
    first = head.filter("doc_id = 0").first()
    assert first.mutual and first.governing_law == "Utopia" and first.signed is False
    titles = {r.title for r in rules.nda_findings(head, clauses).filter("doc_id = 0").collect()}
    assert titles == {"Missing Clause: Confidentiality Definition", "Missing Clause: Confidentiality Period", "Missing Clause: Remedies", "Missing Clause: Return Or Destruction"}


def test_secrecy_length(spark):
    rows = spark.createDataFrame([(1, "confidentiality_period", True, "Perpetual"), (2, "confidentiality_period", True, "6 years"), (3, "confidentiality_period", True, "2 years"), (4, "confidentiality_period", True, None)], "doc_id int, clause_type string, present boolean, value string")
    assert {(r.doc_id, r.severity) for r in rules.secrecy_length(rows).collect()} == {(1, "warning"), (2, "informational")}


def test_totals_and_rows(spark):
    r = extract.invoice_header(texts(spark, "Subtotal: 100\nTax: 20\nTotal: 120")).first()
    assert (r.subtotal, r.tax_amount, r.total_amount) == (100, 20, 100)
    assert texts(spark, "Subtotal: 100\nTotal: 120").select(fd.total_from_whole_word(F.col("full_text"))).first()[0] == 120
    m = extract.statement_metrics(texts(spark, "Net income (1,200)\nRevenue: $1,200", "Net loss 5", "Sales , 7", None)).orderBy("doc_id").collect()
    assert (m[0].net_income, m[0].revenue, m[0].net_margin_pct) == (-1200, 1200, -100) and m[1].net_income is None and m[3].revenue is None


def test_other(spark):
    r = extract.other(texts(spark, "Project Name: Alpha  \nlower: no\nDue On: 2024-01-02 and 2024-01-02\n\n text")).first()
    assert [(f.label, f.value) for f in r.key_facts] == [("Project Name", "Alpha"), ("Due On", "2024-01-02 and 2024-01-02")] and r.dates == ["2024-01-02"]


def test_dispatch(spark):
    docs = spark.createDataFrame([(1, "invoice", "Invoice No: 7"), (2, "memo", "Some Text: here"), (3, "rfp", " "), (4, None, None)], "doc_id int, doc_type string, full_text string")
    table = spark.createDataFrame([(1, 1, 0, "table", None, None, ["Item", "Amount"], [["A", "5"], ["Total", "5"]])], ELEMENT)
    got = {r.doc_id: r for r in extract.extract(docs, table).collect()}
    assert json.loads(got[1].payload)["line_items"][0]["amount"] == 5.0
    assert got[2].doc_type == "other" and got[3].error and got[3].payload is None and got[4].error


def test_metadata(spark):
    t = "Agreement between Acme Works Ltd (the vendor) and Beta Goods Inc as client. Effective Date: March 5, 2024. Later 2024-06-01 and 2024-06-01. Governed by the laws of Utopia, always."
    r = classify.classify(texts(spark, t, "", None), F.lit("contract")).orderBy("doc_id").collect()
    assert [(d.value, d.label) for d in r[0].dates] == [("March 5, 2024", "Effective Date"), ("2024-06-01", "Date")]
    assert r[0].jurisdiction.value == "Utopia" and [p.name for p in r[0].parties] == ["Acme Works Ltd", "Beta Goods Inc"]
    assert r[0].document_summary.endswith("dated March 5, 2024. Governed by the laws of Utopia.") and r[1].error == r[2].error == "no text"


def test_embed(spark):
    v = texts(spark, "alpha beta", "", None).select(classify.embed(F.col("full_text"), classify.hashed_encoder).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-6 and sum(v[1].v) == 0


def test_validators(spark):
    answers = {
        "contract": {"clauses": [{"clause_type": "warranty", "status": "TRUE", "value": "x" * 600}, {"clause_type": "warranty", "status": "missing"}, {"clause_type": "magic"}, 5], "milestones": [{"name": "M", "amount": "$75,000"}, {}], "signed": 0},
        "nda": {"clauses": [{"clause_type": "term", "status": "odd", "present": True}], "mutual": "false"},
        "financial_statement": {"statement_type": "odd", "income_statement": {"revenue": "12"}, "balance_sheet": [], "additional_metrics": [{"name": "a"}, {}]},
        "rfp": {"requirements": [{"description": "d"}, {"category": "c"}], "evaluation_criteria": [{"criterion": "c", "weight_pct": "no"}], "contact": {"email": "a@b.c"}},
        "other": {"key_facts": [{"label": "a", "value": 5}], "dates": "none"},
    }
    got = {}
    for kind, answer in answers.items():
        raw = spark.createDataFrame([(1, json.dumps(answer)), (2, "no json"), (3, None)], "doc_id int, payload string")
        rows = validators.VALIDATORS[kind](raw).orderBy("doc_id").collect()
        assert len(rows) == 3
        got[kind] = rows[0]
    c = {x.clause_type: x for x in got["contract"].clauses}
    assert len(c) == 18 and c["warranty"].status == "present" and len(c["warranty"].value) == 500 and c["assignment"].status == "missing"
    assert [m.amount for m in got["contract"].milestones] == [75000.0] and got["contract"].signed is False and got["contract"].auto_renewal is None
    assert {x.clause_type for x in got["nda"].clauses if x.status == "present"} == {"term"} and got["nda"].mutual is True
    f = got["financial_statement"]
    assert f.statement_type == "other" and f.income_statement.revenue == 12 and f.balance_sheet.total_assets is None and len(f.additional_metrics) == 1
    assert [r.description for r in got["rfp"].requirements] == ["d"] and got["rfp"].evaluation_criteria[0].weight_pct is None and got["rfp"].contact.email == "a@b.c"
    assert got["other"].key_facts[0].value == "5" and got["other"].dates == []


def test_classification_validator(spark):
    answer = {"document_type": "novel", "primary_parties": [{"name": " A ", "role": "King"}, {"name": ""}, {"name": "C"}], "dates": [{"value": "d", "label": "Due Date"}, {"value": "d"}, {"value": ""}], "jurisdiction": {"value": " Here.; "}}
    r = validators.classification(spark.createDataFrame([(1, json.dumps(answer))], "doc_id int, payload string")).first()
    assert (r.document_type, [(p.name, p.role) for p in r.primary_parties], [(d.value, d.label) for d in r.dates], r.jurisdiction.value) == ("other", [("A", "Party")], [("d", "Due Date")], "Here")


def test_markdown_table(spark):
    t = "| A | B |\n|---|---|\n| 1 | **2** |\nplain\n| 3 | 4 |"
    from parchmint.functions.text import clean_markdown

    r = texts(spark, t, "| one |\n| two |").select(elements.markdown_table(F.col("full_text"), clean_markdown).alias("m")).collect()
    assert (r[0].m.headers, r[0].m.rows) == (["A", "B"], [["1", "2"], ["3", "4"]]) and r[1].m.rows == []


def test_pages(spark):
    pages = elements.page_texts(spark.createDataFrame([(1, 1, 0, "paragraph", "Alpha Beta", None, None, None), (1, 2, 0, "paragraph", "Gamma-delta", None, None, None)], ELEMENT))
    rows = spark.createDataFrame([(1, "alpha beta"), (1, "gamma delta"), (1, ""), (1, None)], "doc_id int, raw_text string")
    assert [r.page_no for r in elements.attach_page(pages, rows, "raw_text").orderBy("raw_text").collect()] == [None, None, 1, None]
    assert {r.raw_text: r.page_no for r in elements.attach_page(pages, rows, "raw_text", 50, True).collect()}["gamma delta"] == 2


def test_layout_and_words(spark):
    e = spark.createDataFrame([(1, 1, 0, (1.0, 9.0)), (1, 1, 1, (5.0, 2.0)), (1, 1, 2, (1.0, 2.0))], "doc_id int, page_no int, el_no int, bbox struct<x0:double,y0:double>")
    assert [(r.bbox.x0, r.bbox.y0) for r in elements.layout_order(e).orderBy("el_no").collect()] == [(1, 2), (5, 2), (1, 9)]
    w = spark.createDataFrame([(30.0, 60.0, 9.0, 3.0, 100.0, None)], "left double, top double, width double, height double, origin_x double, origin_y double")
    assert tuple(elements.rescale_words(w).first()) == (110, 20, 3, 1)


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Title", "H1") + p("- one") + p("• two") + p("text") + f"<w:tbl><w:tr>{cell('Item')}{cell('Amount')}</w:tr><w:tr>{cell('A')}{cell('5')}</w:tr></w:tbl>" + p(" ")
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 2"/></w:style></w:styles>'
    (tmp_path / "a.docx").write_bytes(zipped(**{"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles}))
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = f'<workbook {s} {r}><sheets><sheet name="Empty" r:id="r1"/><sheet name="Data" r:id="r2"/></sheets></workbook>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>'
    data = f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2"><v>5</v></c></row><row r="4"><c r="B4"><v>7</v></c></row></sheetData></worksheet>'
    files = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/s1.xml": f"<worksheet {s}><sheetData/></worksheet>", "xl/worksheets/s2.xml": data, "xl/sharedStrings.xml": f"<sst {s}><si><t>key</t></si></sst>"}
    (tmp_path / "b.xlsx").write_bytes(zipped(**files))
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"text")
    found = office.files(spark, str(tmp_path))
    assert {r.path.rsplit("/")[-1]: r.error for r in found.collect()}["c.txt"] == "unsupported format"
    blocks = office.docx_blocks(found.filter("format = 'docx'"))
    assert blocks.filter("error IS NOT NULL").count() == 1
    got = [(r.type, r.level, r.text, r["items"], r.headers, r["rows"]) for r in office.docx_elements(blocks).orderBy("el_no").collect()]
    assert got == [("heading", 2, "Title", None, None, None), ("list", None, None, ["one", "two"], None, None), ("paragraph", None, "text", None, None, None), ("table", None, None, None, ["Item", "Amount"], [["A", "5"]])]
    made, skipped = office.xlsx_elements(office.xlsx_cells(found.filter("format = 'excel'")))
    row = made.first()
    assert (row.page_no, row.headers, row["rows"]) == (1, ["key", "Unnamed: 1"], [["5", ""], ["", "7"]]) and [x.sheet for x in skipped.collect()] == ["Empty"]
    assert office.read_elements(spark, str(tmp_path)).count() == 5
    torn = bytearray(zipped(**{"word/document.xml": "x"}))
    (tmp_path / "d.docx").write_bytes(bytes(torn[:40]))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    errors = {(r.path.rsplit("/")[-1], r.error.split(":")[0]) for r in office.read_errors(spark, str(tmp_path)).collect()}
    assert errors == {("bad.docx", "BadZipFile"), ("d.docx", "BadZipFile"), ("c.txt", "unsupported format"), ("e.pdf", "no reader for pdf"), ("b.xlsx", "sheet without rows")}


def test_dates_in_sheets(spark, tmp_path):
    """Numbers whose style shows a date or a time become text of it, by built-in and by own formats, in both calendars."""
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>'
    formats = ((164, "dd/mm/yyyy"), (165, '0.00 "days"'), (166, "[Red]#,##0"), (167, "[h]:mm"))
    styles = f'<styleSheet {s}><numFmts>{"".join(f"<numFmt numFmtId=\'{i}\' formatCode=\'{c.replace(chr(34), "&quot;")}\'/>" for i, c in formats)}</numFmts><cellXfs>' + "".join(f'<xf numFmtId="{i}"/>' for i in (0, 14, 164, 165, 166, 20)) + "</cellXfs></styleSheet>"
    cells = "".join(f'<c r="{c}2" s="{i}"><v>{v}</v></c>' for c, i, v in (("A", 0, 45366), ("B", 1, 45366), ("C", 2, 45366.75), ("D", 3, 5), ("E", 4, 6), ("F", 5, 0.4375), ("G", 1, 1), ("H", 1, 9e9), ("I", 99, 7)))
    data = f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>n</t></is></c></row><row r="2">{cells}</row></sheetData></worksheet>'
    for name, later in (("a", ""), ("b", '<workbookPr date1904="1"/>')):
        book = f'<workbook {s} {r}>{later}<sheets><sheet name="Data" r:id="r1"/></sheets></workbook>'
        (tmp_path / f"{name}.xlsx").write_bytes(zipped(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/s1.xml": data, "xl/styles.xml": styles}))
    made, _ = office.xlsx_elements(office.xlsx_cells(office.files(spark, str(tmp_path))))
    rows = sorted(r["rows"][0] for r in made.collect())
    assert rows == [
        ["45366", "2024-03-15 00:00:00", "2024-03-15 18:00:00", "5", "6", "10:30:00", "1900-01-01 00:00:00", "9000000000.0", "7"],
        ["45366", "2028-03-16 00:00:00", "2028-03-16 18:00:00", "5", "6", "10:30:00", "1904-01-02 00:00:00", "9000000000.0", "7"],
    ]


def test_streams(spark, tmp_path):
    source, table, point = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "cp")
    source.mkdir()
    (source / "a.docx").write_bytes(b"one")
    for _ in range(2):  # the second run finds the second file only
        upserts.upsert(stages.uploads(spark, str(source), "proj_1"), table, point).awaitTermination()
        (source / "b.txt").write_bytes(b"one")
    rows = upserts.current(spark, table).collect()
    assert [(r.name, r.status, r.n_versions) for r in rows] == [("b.txt", "failed", 2)]


def test_event_stream(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    event = lambda seq, stage, status, detail="": json.dumps({"client_id": "c", "seq": seq, "ts": f"2024-01-01T00:00:0{seq}Z", "stage": stage, "status": status, "detail": detail})
    (source / "1.json").write_text("\n".join([event(1, "ingestion", "running", "pages"), event(2, "classification", "running"), event(3, "risk", "complete")]))
    events = stages.read_events(spark, str(source))
    for name, df in (("folded", stages.fold(events)), ("seen", stages.progress(events))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.stage, r.status, r.detail) for r in spark.table("folded").collect()} == {("ingestion", "running", "pages"), ("classification", "running", None), ("risk", "complete", None)}
    r = spark.table("seen").first()
    assert r.stages.ingestion == "complete" and r.stages.cross_document == "pending" and r.document_status == "completed"
    stages.emit(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_records(spark):
    clauses = spark.createDataFrame([(1, "payment_terms", "Net 5", 1), (1, "non_compete", None, 2), (1, "warranty", "x", 3), (2, "warranty", "x", 1)], "doc_id int, clause_type string, value string, ord int")
    assert {r.doc_id: r.key_fields for r in records.key_clauses(clauses).collect()} == {1: "• Payment Terms: Net 5\n• Non Compete: Present", 2: records.NO_FIELDS}
    fs = spark.createDataFrame([(1, 12345678.5, 0.0, None), (2, None, None, None)], "doc_id int, revenue double, net_income double, total_assets double")
    assert [r.key_fields for r in records.key_fields(fs, "financial_statement").orderBy("doc_id").collect()] == ["• Revenue: 12345678.5", records.NO_FIELDS]
    one = spark.createDataFrame([(["A\nB ", "C"],), ([],), (None,)], "n array<string>").select(records.joined_parties(F.col("n")).alias("p"))
    assert [r.p for r in one.collect()] == ["A B & C", "Unknown", "Unknown"]
    docs = spark.createDataFrame([(1, "f", "nda", "h", "2024")], "doc_id int, name string, doc_type string, content_hash string, processed_at string")
    none = docs.filter("false")
    r = records.record(docs, none.selectExpr("doc_id", "name AS parties"), none.selectExpr("doc_id", "name AS key_fields"), none.selectExpr("doc_id", "1 AS overall_score"), none.selectExpr("doc_id", "name AS severity")).first()
    assert (r.document_type, r.parties, r.risk_score, r.critical) == ("Nda", "Unknown", 0, 0)


def test_document_types(spark):
    from parchmint.plans import extraction_queries as q

    for rendered, kind in ((q.invoice_texts, "invoice"), (q.statement_texts, "financial_statement"), (q.rfp_texts, "rfp")):
        got = classify.document_types(rendered(spark, "/root/testdata/sf0.001"), dims.PROTOTYPES).groupBy("document_type").count().orderBy(F.desc("count")).first()
        assert got.document_type == kind


def test_findings_by_type(spark):
    head = texts(spark, "Subtotal: 100\nTax: 20\nTotal: 120").select("doc_id", F.lit(100.0).alias("subtotal"), F.lit(0.0).alias("tax_amount"), F.lit(0.0).alias("discount"), F.lit(100.0).alias("total_amount"), F.lit("2024-01-01").cast("date").alias("due_date"), F.lit("A\nB").alias("vendor_name"))
    lines = spark.createDataFrame([(0, 1, "a", 1.0, 100.0, 100.0)], "doc_id int, line_no int, description string, quantity double, unit_price double, amount double")
    rfp = spark.createDataFrame([(9, None, None, "a@b.c")], "doc_id int, submission_deadline string, contact_phone string, contact_email string")
    criteria = spark.createDataFrame([(9, "x", 40.0), (9, "y", 50.0)], "doc_id int, criterion string, weight_pct double")
    got = rules.findings({"invoice": (head, lines, "2024-02-01"), "rfp": (rfp, criteria), "other": ()})
    assert {(r.doc_id, r.title) for r in got.collect()} == {(0, "Invoice Overdue"), (9, "Missing Submission Deadline"), (9, "Evaluation Criteria Weights Don't Sum to 100%")}
    assert head.select(fd.first_line(F.col("vendor_name")).alias("v")).first().v == "A"
