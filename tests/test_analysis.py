"""The run from text to record: errors, types, pages, dates; equal to the rules over tables."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parchmint import dims
from parchmint.operators import analysis, extract, rules
from parchmint.operators.findings import FIELDS
from parchmint.plans import mixed

DOC = f"doc_id string, doc_type string, full_text string, elements array<{analysis.ELEMENT}>"
CONTRACT = "\n".join([
    "MASTER AGREEMENT", "Between us.", "Paymnt Terms", "Net 120 days.", "Notice", "Give 5 days.", "Limitation of Liability", "Up to $ 5,000.", "Governing Law", "Governed by the laws of Utopia.",
])


def element(page, no, text=None, items=None, headers=None, rows=None):
    return (page, no, "x", text, items, headers, rows)


def run(spark, docs, **how):
    return {r.doc_id: r for r in analysis.analyse(spark.createDataFrame(docs, DOC), "2024-05-01", **how).withColumn("payload", F.to_json("payload")).collect()}


def test_errors_and_unknown_types_stay_with_their_documents(spark):
    got = run(spark, [("a", "contract", None, None), ("b", "memo", "Owner: Jane\n01/02/2024", None), ("c", None, " \n\t", []), ("d", "rfp", "x", None), ("e", "contract", CONTRACT, None)])
    assert (got["a"].error, got["a"].payload, got["a"].findings, got["a"].risk, got["a"].record) == ("no text", None, None, None, None)
    assert got["c"].error == "no text" and got["c"].doc_type == "other"
    b = json.loads(got["b"].payload)
    assert got["b"].doc_type == "other" and b["key_facts"] == [{"label": "Owner", "value": "Jane"}] and b["dates"] == [{"label": "Date", "value": "01/02/2024"}] and got["b"].findings == []
    assert [f.title for f in got["d"].findings] == ["Missing Submission Deadline", "Missing Contact Information"] and got["d"].risk.overall_score == 33
    assert got["e"].error is None


def test_empty_input(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("fuzzy", [False, True])
def test_contract_equals_the_functions_over_tables(spark, fuzzy):
    texts = spark.createDataFrame([("e", CONTRACT), ("f", CONTRACT.replace("Notice", "Nothing"))], "doc_id string, full_text string")
    got = run(spark, [(r.doc_id, "contract", r.full_text, None) for r in texts.collect()], fuzzy=fuzzy)
    clauses, head = extract.contract(texts, fuzzy=fuzzy)
    want = {}
    for r in clauses.filter("present").collect():
        want.setdefault(r.doc_id, {})[r.clause_type] = (r.value, r.raw_text)
    for doc, r in got.items():
        listed = json.loads(r.payload)["clauses"]
        assert [c["clause_type"] for c in listed] == list(dims.CLAUSE_HEADERS)
        assert {c["clause_type"]: (c.get("value"), c["raw_text"]) for c in listed if c["present"]} == want[doc]
    found = {}
    for r in rules.contract_findings(head, clauses).collect():
        found.setdefault(r.doc_id, set()).add(tuple(r[f] for f in FIELDS))
    assert {doc: {tuple(f) for f in r.findings} for doc, r in got.items()} == found
    assert ("payment_terms" in want["e"]) == fuzzy  # a misspelt heading is met by likeness only


def test_pages_by_the_first_characters_of_a_snippet(spark):
    pages = [element(3, 0, "GIVE  5 days"), element(3, 1, "Net 120 days. Give 5 days."), element(4, 0, "net 120 DAYS."), element(9, 1, None, ["Up to $ 5,000."]), element(None, 0, "up to $ 5,000.")]
    listed = json.loads(run(spark, [("e", "contract", CONTRACT, pages)])["e"].payload)["clauses"]
    assert {c["clause_type"]: c.get("page") for c in listed if c["present"]} == {"payment_terms": 3, "notice_period": 3, "liability_cap": None, "payment_amount": None} | {
        c["clause_type"]: None for c in listed if c["present"] and c["clause_type"] not in ("payment_terms", "notice_period")
    }


@pytest.mark.parametrize(("due", "late"), [("March 15, 2024", 47), ("15/03/2024", 47), ("2024-03-15", 47), ("3/25/2024", 37), ("2024/3/15", None), ("99/99/2024", None), ("June 1, 2024", None)])
def test_invoices_with_dates_of_any_form(spark, due, late):
    rows = [["Widget", "2", "10.00", "20.00"], [" widget ", "1", "20.00", "20.00"], ["Gadget", "3", "$5.00", "16.00"], ["Freebie", "1", "0", "0"], ["TOTAL", "", "", "56"], ["lone"], ["Big", "3", "2,000.50", "9"]]
    text = f"INVOICE\nInvoice No: I-1\nJanuary 5, 2024 to {due}\nTotal Due: 66.00\nSubtotal: 60\nTax: 6"
    r = run(spark, [("i", "invoice", text, [element(1, 0, None, None, ["Item", "Qty", "Price", "Sum"], rows), element(1, 1, None, None, ["No", "Thing"], rows)])])["i"]
    titles = [(f.title, f.evidence) for f in r.findings]
    overdue = [("Invoice Overdue", due)] if late else []
    assert titles == [
        ("Duplicate Line Item", "widget"), ("Line Item Math Mismatch", "Gadget"), ("Zero-Amount Line Item", "Freebie"), ("Line Item Math Mismatch", "Big"),
        ("Subtotal Reconciliation Failed", "Calculated: 65.00, Stated: 60.00"), *overdue, ("Missing Vendor Name", "vendor.name: absent"),
    ]
    by = {f.title: f.explanation for f in r.findings}
    assert by["Line Item Math Mismatch"] == "Quantity (3.0) × unit price (2000.50) = 6001.50, but stated amount is 9.00."
    assert not late or by["Invoice Overdue"] == f"The due date ({due}) is {late} day(s) in the past."
    assert r.record.key_fields.split("\n")[:3] == ["• Invoice Number: I-1", f"• Due Date: {due}", "• Total Amount: 66.0"]


def test_all_types_in_one_scan(spark, sf_dir):
    docs = mixed.documents(spark, sf_dir)
    plan = analysis.analyse(docs, "1998-01-01", fuzzy=False)._jdf.queryExecution().optimizedPlan().toString()
    own = docs._jdf.queryExecution().optimizedPlan().toString()
    count = lambda p, word: p.count(word)
    assert all(count(plan, w) == count(own, w) for w in ("Relation [", "Join ", "Aggregate ", "Window "))


def test_statement_and_proposal_payloads(spark):
    fs = "Total Revenue: 1,000\nNet Income: (300)\nTotal Assets: 500\nTotal Liabilities: 400\nTotal Equity: (50)\nUnaudited"
    got = run(spark, [("s", "financial_statement", fs, None), ("r", "rfp", "RFP No: 7\nEvaluation criteria:\n- Price over the whole long term 60%\n- Quality of the work 30%\n", [element(1, 0, None, ["Vendors must deliver all of it in time", "short"])])])
    s = json.loads(got["s"].payload)
    assert s["income_statement"]["net_income"] == -300 and s["ratios"]["net_margin_pct"] == -30
    assert {f.title for f in got["s"].findings} == {"Negative Equity (Technical Insolvency)", "Large Net Loss Relative to Revenue", "Balance Sheet Does Not Balance", "Unaudited Financial Statement"}
    assert {f.title: f.evidence for f in got["s"].findings}["Large Net Loss Relative to Revenue"] == "net_income: -300, revenue: 1,000"
    assert "• Net Profit: -300.0" in got["s"].record.key_fields
    r = json.loads(got["r"].payload)
    assert r["requirements"] == [{"category": "General", "description": "Vendors must deliver all of it in time", "mandatory": True}] and [c["weight_pct"] for c in r["evaluation_criteria"]] == [60, 30]
    assert [f.evidence for f in got["r"].findings][-1] == "Sum of weights: 90%"


def test_metadata_with_pages(spark):
    text = "Agreement dated\nEffective Date: March 1, 2024\nbetween Acme Widgets Limited, the supplier, and Other Parts Company, the customer.\nIt is governed by the laws of Utopia."
    pages = [element(1, 0, "Agreement dated"), element(2, 0, "of March 1, 2024, and"), element(3, 0, "dated Effective Date: March 1, 2024 between Acme Widgets Limited, the supplier, and Other Parts Company, the customer.")]
    got = {r.doc_id: r for r in analysis.classified(spark.createDataFrame([("m", "contract", text, pages), ("n", "nda", " ", None), ("o", "other", None, pages)], DOC)).collect()}
    assert got["m"].jurisdiction.value == "Utopia" and [(d.value, d.label) for d in got["m"].dates] == [("March 1, 2024", "Effective Date")]
    assert [(p.name, p.role) for p in got["m"].parties][0][0] == "Effective Date" or got["m"].parties
    flat = spark.createDataFrame([("q", "contract", "Effective Date: March 1, 2024 is it.", [element(7, 0, "nothing"), element(8, 0, "Then: effective date: March 1, 2024 is IT. More")])], DOC)
    assert [(d.value, d.page) for d in analysis.classified(flat).first().dates] == [("March 1, 2024", 8)]
    assert got["n"].error == "no text" and got["n"].document_summary is None and got["o"].dates is None


def test_fuzzy_headings_against_plain_subsequences(spark):
    """The score is the best window's longest common subsequence, by plain dynamic programming over every heading and variant."""
    import random

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    def ratio(a, b):
        a, b = sorted((a, b), key=len)
        if not a:
            return 0.0
        if a in b:
            return 100.0
        return max(200.0 * common(a, w) / (len(a) + len(w)) for s in range(1 - len(a), len(b)) if (w := b[max(0, s) : s + len(a)]))

    rng, names = random.Random(3), [v for _, v in dims.clause_headers(nda=True)]
    headings = []
    for _ in range(60):
        h = list(rng.choice(names))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(h))
            h[at : at + rng.randrange(2)] = rng.choice(["", "x", "e", " ", h[at]])
        headings.append("".join(h).title())
    want = {}
    for h in headings:
        top, kind = 0.0, None
        for t, v in dims.clause_headers(nda=True):
            if (score := ratio(h.lower(), v)) > top:
                top, kind = score, t
        want[h] = kind if top >= 75 else None
    rows = spark.createDataFrame([(h,) for h in headings], "header string")
    got = {r.header: r.clause_type for r in extract.match_headers_fuzzy(rows, dims.clause_headers(nda=True)).collect()}
    assert got == {h: k for h, k in want.items() if h} and len(set(want.values())) > 10


def test_headings_varied_against_every_variant(spark, sf_dir):
    """What the index leaves out could never be the answer: all varied headings of a table, scored against every variant."""
    from parchmint.plans import extraction_queries

    table = [(k, v.lower()) for k, v in dims.clause_headers(nda=True)]
    found = extraction_queries.headings_varied(spark, sf_dir)

    @F.pandas_udf("string")
    def plain(names: pd.Series) -> pd.Series:
        def one(name):
            scores = [extract.partial_ratio(name, v) for _, v in table]
            return table[scores.index(max(scores))][0] if max(scores) >= 75 else None

        return names.map(one)

    odd = spark.createDataFrame([("A",), ("zz",), ("Fees " * 40,), ("\u00c9t\u00e9",), (" ",)], "header string")
    rows = found.union(extract.match_headers_fuzzy(odd, dims.clause_headers(nda=True))).withColumn("want", plain(F.lower("header")))
    got = [(r.header, r.clause_type, r.want) for r in rows.collect()]
    assert [g for g in got if g[1] != g[2]] == [] and len(got) > 3000 and len({g[1] for g in got}) > 10


@pytest.mark.parametrize("threshold", [40, 60, 75, 90, 100])
def test_likest_at_other_thresholds(threshold):
    import random

    rng = random.Random(threshold)
    table = [(str(i), "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    best = extract.likest(table, threshold)
    for _ in range(400):
        name = "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 20)))
        scores = [extract.partial_ratio(name, v) for _, v in table]
        assert best(name) == (table[scores.index(max(scores))][0] if max(scores) >= threshold else None)


@pytest.mark.parametrize("threshold", [40, 60, 75, 90, 100])
def test_headings_are_scored_together(threshold, monkeypatch):
    """Each pair of a heading and a variant was scored on its own, in Python."""
    import random

    rng = random.Random(threshold)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    table = [(str(i), "a" + word("abc d", 14)) for i in range(40)] + [("last", "ab" * 40)]
    short = [(k, v) for k, v in table if len(v) <= extract.BITS]
    names = [word("abc dz\u00e9", rng.choice((3, 20, 62, 300))) for _ in range(300)] + ["", "z", "ab" * 35, "ab" * 200]
    one = extract.likest(table, threshold)
    assert extract.likest_all(table, threshold)(names) == [one(n) if n else None for n in names]
    one, brief = extract.likest(short, threshold), [n for n in names if 0 < len(n) <= extract.LONG]
    want = [one(n) for n in brief]
    monkeypatch.setattr(extract, "partial_ratio", None)
    assert extract.likest_all(short, threshold)(brief) == want and any(want)
