"""Queries of answers, clause values, dates, layout, pages and parties over inputs that vary by row, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions import text as tx
from parchmint.operators import classify, documents, elements, extract, records, validators
from parchmint.plans import fixtures as fx
from parchmint.plans.queries import query


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class _Text(NamedTuple):
    """A text as SQL and as a function that makes its Column (which needs a session)."""

    sql: str
    column: Callable[[], Column]


def _pick(values: tuple[str, ...], key: str, salt: int = 0) -> _Text:
    """A value by (key + salt) modulo their number."""
    n = len(values)
    column = lambda: F.element_at(F.array(*map(F.lit, values)), ((F.col(key) + salt) % n + 1).cast("int"))
    return _Text(f"[{', '.join(map(_quoted, values))}][1 + ({key} + {salt}) % {n}]", column)


def _joined(*parts: str | _Text) -> _Text:
    """Plain texts and picks, one after the other."""
    both = [_Text(_quoted(p), lambda p=p: F.lit(p)) if isinstance(p, str) else p for p in parts]
    return _Text(" || ".join(t.sql for t in both), lambda: F.concat(*(t.column() for t in both)))


# Answers of a model, made to fit the types

_FLAGS = ("true", "false", "0", "1", '""', "[]", '"x"')
_NUMBERS = ("5", '"12.5"', '"n/a"', "true", "null", '" 7 "')
_KEY = "o_orderkey"
_CONTRACT = _joined(
    _pick(("", "", "", "", "no json "), _KEY), '{"clauses": [{"clause_type": "warranty", "status": "', _pick(("present", "MISSING", "explicitly_waived", "odd", "True"), _KEY, 1),
    '", "value": "', _pick(("", "two years", "v" * 600), _KEY), '"}, {"clause_type": "warranty", "status": "present"}, {"clause_type": "magic"}, 5], "milestones": [{"name": "M", "amount": "',
    _pick(("$75,000", "12", "none"), _KEY, 2), '"}, {}], "governing_law": "', _pick(("", "Utopia", "u" * 300), _KEY), '", "signed": ', _pick(_FLAGS, _KEY), "}",
)
_NDA = _joined('{"clauses": [{"clause_type": "term", "status": "', _pick(("present", "odd"), _KEY), '", "present": ', _pick(("true", "false", "1"), _KEY), '}], "mutual": ', _pick(_FLAGS, _KEY, 3), "}")
_STATEMENT = _joined(
    '{"statement_type": "', _pick(("combined", "odd", "balance_sheet"), _KEY), '", "income_statement": ', _pick(("", "[]"), _KEY, 1), '{"revenue": ', _pick(_NUMBERS, _KEY),
    '}, "additional_metrics": [{"name": "', _pick(("", "a"), _KEY), '", "value": ', _pick(_NUMBERS, _KEY, 1), '}, {}], "audited": ', _pick(_FLAGS, _KEY), "}",
)
_RFP = _joined(
    '{"rfp_number": "', _pick(("", "R" * 150, "7"), _KEY), '", "requirements": [{"description": "', _pick(("", "d"), _KEY), '", "mandatory": ', _pick(_FLAGS, _KEY),
    '}, {"category": "c"}], "evaluation_criteria": [{"criterion": "c", "weight_pct": ', _pick(_NUMBERS, _KEY), "}]}",
)
_OTHER = _joined('{"key_facts": [{"label": "', _pick(("", "a"), _KEY), '", "value": ', _pick(("5", '"b"', "null"), _KEY), '}], "dates": ', _pick(('"none"', "[]", '[{"value": "1 May"}, 3]'), _KEY), "}")
_CLASSIFIED = _joined(
    '{"document_type": "', _pick(("novel", "nda", "rfp"), _KEY), '", "primary_parties": [{"name": " A ", "role": "', _pick(("King", "Vendor"), _KEY), '"}, {"name": ""}, {"name": "C"}], "dates": [{"value": "',
    _pick(("d", "e", ""), _KEY), '", "label": "Due Date"}, {"value": "d"}], "jurisdiction": {"value": "', _pick((" Here.; ", ".", "There"), _KEY), '"}}',
)


def _raw(spark, sf_dir, payload) -> DataFrame:
    return fx.spread(fx.table(spark, sf_dir, "orders").select(_KEY), _KEY).select(F.col(_KEY).alias("doc_id"), payload.column().alias("payload"))


def _answers(payload) -> str:
    return f"WITH raw AS (SELECT o_orderkey AS doc_id, {payload.sql} AS payload FROM orders), a AS (SELECT doc_id, CASE WHEN json_valid(payload) THEN payload::JSON ELSE '{{}}'::JSON END AS j FROM raw)"


def _flag_sql(path: str) -> str:
    return f"CAST(json_extract(j, '{path}') AS VARCHAR) NOT IN ('false', '0', '\"\"', '[]')"


def _number_sql(path: str) -> str:
    return f"CASE json_extract_string(j, '{path}') WHEN 'true' THEN 1.0 ELSE TRY_CAST(trim(json_extract_string(j, '{path}')) AS DOUBLE) END"


@query("answers_contract", f"""{_answers(_CONTRACT)}, s AS (SELECT *, lower(json_extract_string(j, '$.clauses[0].status')) AS status FROM a)
SELECT doc_id, CASE WHEN status IN ('present', 'missing', 'explicitly_waived') THEN status WHEN status = 'true' THEN 'present' ELSE 'missing' END AS status, CAST(18 AS INTEGER) AS n_clauses,
  substr(nullif(json_extract_string(j, '$.clauses[0].value'), ''), 1, 500) AS value, TRY_CAST(replace(replace(json_extract_string(j, '$.milestones[0].amount'), '$', ''), ',', '') AS DOUBLE) AS amount,
  substr(nullif(json_extract_string(j, '$.governing_law'), ''), 1, 200) AS governing_law, {_flag_sql('$.signed')} AS signed FROM s""")
def answers_contract(spark, sf_dir):
    rows = validators.contract(_raw(spark, sf_dir, _CONTRACT)).withColumn("c", F.filter("clauses", lambda c: c["clause_type"] == "warranty")[0])
    return rows.select("doc_id", "c.status", F.size("clauses").alias("n_clauses"), "c.value", F.get("milestones", F.lit(0))["amount"].alias("amount"), "governing_law", "signed")


@query("answers_nda", f"""{_answers(_NDA)} SELECT doc_id, CASE WHEN json_extract_string(j, '$.clauses[0].status') = 'present' OR json_extract_string(j, '$.clauses[0].present') = 'true' THEN 'present' ELSE 'missing' END AS status,
  {_flag_sql('$.mutual')} AS mutual FROM a""")
def answers_nda(spark, sf_dir):
    rows = validators.nda(_raw(spark, sf_dir, _NDA))
    return rows.select("doc_id", F.filter("clauses", lambda c: c["clause_type"] == "term")[0]["status"].alias("status"), "mutual")


@query("answers_statement", f"""{_answers(_STATEMENT)} SELECT doc_id, CASE WHEN json_extract_string(j, '$.statement_type') IN ('combined', 'balance_sheet') THEN json_extract_string(j, '$.statement_type') ELSE 'other' END AS statement_type,
  {_number_sql('$.income_statement.revenue')} AS revenue, CASE WHEN json_extract_string(j, '$.additional_metrics[0].name') <> '' THEN {_number_sql('$.additional_metrics[0].value')} END AS metric, {_flag_sql('$.audited')} AS audited FROM a""")
def answers_statement(spark, sf_dir):
    rows = validators.financial_statement(_raw(spark, sf_dir, _STATEMENT))
    return rows.select("doc_id", "statement_type", F.col("income_statement.revenue").alias("revenue"), F.get("additional_metrics", F.lit(0))["value"].alias("metric"), "audited")


@query("answers_rfp", f"""{_answers(_RFP)} SELECT doc_id, substr(nullif(json_extract_string(j, '$.rfp_number'), ''), 1, 100) AS rfp_number,
  CASE WHEN json_extract_string(j, '$.requirements[0].description') <> '' THEN 'General' END AS category, CASE WHEN json_extract_string(j, '$.requirements[0].description') <> '' THEN {_flag_sql('$.requirements[0].mandatory')} END AS mandatory,
  {_number_sql('$.evaluation_criteria[0].weight_pct')} AS weight FROM a""")
def answers_rfp(spark, sf_dir):
    rows = validators.rfp(_raw(spark, sf_dir, _RFP)).withColumn("r", F.get("requirements", F.lit(0)))
    return rows.select("doc_id", "rfp_number", "r.category", "r.mandatory", F.get("evaluation_criteria", F.lit(0))["weight_pct"].alias("weight"))


@query("answers_other", f"""{_answers(_OTHER)} SELECT doc_id, CASE WHEN json_extract_string(j, '$.key_facts[0].label') <> '' THEN json_extract_string(j, '$.key_facts[0].value') END AS fact, json_extract_string(j, '$.dates[0].value') AS first_date FROM a""")
def answers_other(spark, sf_dir):
    rows = validators.other(_raw(spark, sf_dir, _OTHER))
    return rows.select("doc_id", F.get("key_facts", F.lit(0))["value"].alias("fact"), F.get("dates", F.lit(0))["value"].alias("first_date"))


@query("answers_classification", f"""{_answers(_CLASSIFIED)}, d AS (SELECT *, json_extract_string(j, '$.dates[0].value') AS v FROM a)
SELECT doc_id, CASE WHEN json_extract_string(j, '$.document_type') = 'novel' THEN 'other' ELSE json_extract_string(j, '$.document_type') END AS document_type,
  trim(json_extract_string(j, '$.primary_parties[0].name')) || ':' || CASE json_extract_string(j, '$.primary_parties[0].role') WHEN 'King' THEN 'Party' ELSE 'Vendor' END AS parties,
  CASE v WHEN 'd' THEN 'd:Due Date' WHEN 'e' THEN 'e:Due Date,d:Date' ELSE 'd:Date' END AS dates, nullif(rtrim(trim(json_extract_string(j, '$.jurisdiction.value')), '.,;'), '') AS law FROM d""")
def answers_classification(spark, sf_dir):
    rows = validators.classification(_raw(spark, sf_dir, _CLASSIFIED))
    joined = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), x[b])), ",")
    return rows.select("doc_id", "document_type", joined("primary_parties", "name", "role").alias("parties"), joined("dates", "value", "label").alias("dates"), F.col("jurisdiction.value").alias("law"))


# Clause values and dates

_BODIES = (
    "Pay $1,250.00 now. Then rest.", "It lasts for 30 days. No more.", "Within two (2) years of it.", "Net 45 terms apply! Always.", "Nothing is said", "", "USD 500 or 12 months? Either.", "Payable within 60 days of receipt. Thanks.",
)
_TYPES = (
    "payment_amount", "liability_cap", "notice_period", "term", "payment_terms", "termination_for_cause", "confidentiality", "force_majeure", "warranty", "non_compete", "assignment",
)
_BODY, _TYPE = _pick(_BODIES, "l_partkey"), _pick(_TYPES, "l_suppkey")
_FIRST_SQL = lambda p: f"nullif(regexp_extract(body, {_quoted(p)}), '')"
_SENTENCE_SQL = "substr(coalesce(nullif(regexp_extract(trim(body), '(?s)^(.*?[.!?])\\s', 1), ''), trim(body)), 1, 150)"


@query("clause_values", f"""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, {_TYPE.sql} AS clause_type, {_BODY.sql} AS body FROM lineitem),
v AS (SELECT *, {_FIRST_SQL(tx.MONEY)} AS money, {_FIRST_SQL(tx.DURATION)} AS duration, {_FIRST_SQL(tx.PAYMENT_TERMS)} AS terms, {_SENTENCE_SQL} AS sentence FROM b)
SELECT doc_id, line_no, clause_type, CASE WHEN clause_type IN ('payment_amount', 'liability_cap') THEN money WHEN clause_type IN ('notice_period', 'term', 'non_compete') THEN duration
  WHEN clause_type = 'payment_terms' THEN coalesce(terms, duration) WHEN clause_type = 'termination_for_cause' THEN coalesce(duration, sentence) WHEN clause_type = 'confidentiality' THEN coalesce(duration, 'Present')
  WHEN clause_type IN ('force_majeure', 'assignment') THEN 'Present' ELSE sentence END AS value FROM v""")
def clause_values(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), _TYPE.column().alias("clause_type"), _BODY.column().alias("body"))
    return rows.select("doc_id", "line_no", "clause_type", documents.clause_value(F.col("clause_type"), F.col("body")).alias("value"))


_DATES = (
    "Effective Date: January 5, 2024 and 2024-01-05 or 05/01/2024.", "Due date: 03/04/2023, due date: 03/04/2023.", "On the 2nd day of May 2021 and May 2, 2021", "No date here.",
    "Expiry Date March 1 2020; 1.2.2020; 2020/3/1", "Notice date: soon. June 30, 2022, June 30, 2022 and June 30 2022",
)
_DATED = _pick(_DATES, "doc_id")


@query("dates_found", f"""WITH t AS (SELECT doc_id, {_DATED.sql} || ' ' || text AS t FROM documents), hits AS (
  SELECT doc_id, 0 AS p, unnest(regexp_extract_all(t, {_quoted(classify.NAMED_DATE)}, 2)) AS v, generate_subscripts(regexp_extract_all(t, {_quoted(classify.NAMED_DATE)}, 2), 1) AS i FROM t
  {' '.join(f"UNION ALL SELECT doc_id, {n}, unnest(regexp_extract_all(t, {_quoted(p)})), generate_subscripts(regexp_extract_all(t, {_quoted(p)}), 1) FROM t" for n, p in enumerate(classify.PLAIN_DATES, 1))}
), firsts AS (SELECT doc_id, trim(v) AS v, min((p, i)) AS o FROM hits GROUP BY doc_id, trim(v)), nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS n FROM firsts)
SELECT doc_id, count(v) AS n_dates, coalesce(string_agg(v, '|' ORDER BY n), '') AS found FROM t LEFT JOIN (SELECT * FROM nth WHERE n <= 10) USING (doc_id) GROUP BY doc_id""")
def dates_found(spark, sf_dir):
    text = F.concat(_DATED.column(), F.lit(" "), "text")
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", classify.dates(text).alias("d"))
    return rows.select("doc_id", F.size("d").cast("long").alias("n_dates"), F.array_join(F.transform("d", lambda d: d["value"]), "|").alias("found"))


@query("terms_near_the_start", f"""WITH t AS (SELECT doc_id, repeat('word ', CAST(doc_id % 5 * 130 AS INTEGER)) || 'for {{n}} days' AS t FROM documents)
SELECT doc_id, nullif(regexp_extract(substr(replace(t, '{{n}}', CAST(doc_id % 90 + 1 AS VARCHAR)), 1, 2000), {_quoted(tx.DURATION)}), '') AS contract_term FROM t""")
def terms_near_the_start(spark, sf_dir):
    text = F.concat(F.repeat(F.lit("word "), (F.col("doc_id") % 5 * 130).cast("int")), F.lit("for "), (F.col("doc_id") % 90 + 1).cast("string"), F.lit(" days"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.first(F.substring(text, 1, 2000), tx.DURATION).alias("contract_term"))


# Elements, pages, parties


_MODE, _ORDER = _pick(("AIR", "TRUCK", "RAIL", "SHIP"), "l_suppkey"), _pick(("TAKE BACK RETURN", "NONE", "DELIVER"), "l_partkey", 1)


def _elements(spark, sf_dir) -> DataFrame:
    """Lines of orders as elements of three pages at most; a line's number alone isn't unique."""
    return fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page_no"), ((F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000) + F.col("l_suppkey")).alias("el_no"),
        F.when(F.col("l_partkey") % 3 == 0, "paragraph").otherwise("list").alias("type"), F.concat(_ORDER.column(), F.lit("-"), _MODE.column()).alias("text"),
        F.when(F.col("l_suppkey") % 7 != 0, F.array(_MODE.column(), "l_returnflag")).alias("items"), F.struct(F.col("l_discount").alias("x0"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_tax")).alias("y0")).alias("bbox"),
    )


_ELEMENTS = f"""WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page_no, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS el_no, CASE WHEN l_partkey % 3 = 0 THEN 'paragraph' ELSE 'list' END AS type, {_ORDER.sql} || '-' || {_MODE.sql} AS text,
  CASE WHEN l_suppkey % 7 <> 0 THEN [{_MODE.sql}, l_returnflag] END AS items, l_discount AS x0, CASE WHEN l_partkey % 5 <> 0 THEN l_tax END AS y0 FROM lineitem)"""


@query("layout_order", f"{_ELEMENTS} SELECT doc_id, page_no, x0, y0, text, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0 NULLS FIRST, x0 NULLS FIRST, el_no) - 1 AS INTEGER) AS el_no FROM e")
def layout_order(spark, sf_dir):
    return elements.layout_order(_elements(spark, sf_dir)).select("doc_id", "page_no", "bbox.x0", "bbox.y0", "text", F.col("el_no").cast("int").alias("el_no"))


@query("merged_lists", f"""{_ELEMENTS}, f AS (SELECT *, coalesce(type = 'list' AND lag(type) OVER (PARTITION BY doc_id, page_no ORDER BY el_no) = 'list', false) AS goes_on FROM e),
g AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY el_no) AS island FROM f)
SELECT doc_id, page_no, min(el_no) AS el_no, min(type) AS type, CASE WHEN min(type) = 'list' THEN coalesce(string_agg(array_to_string(items, ','), ',' ORDER BY el_no), '') ELSE array_to_string(any_value(items), ',') END AS items
FROM g GROUP BY doc_id, page_no, island""")
def merged_lists(spark, sf_dir):
    rows = elements.merge_lists(_elements(spark, sf_dir).withColumn("keep", F.col("items")))
    items = F.when(F.col("type") == "list", F.array_join("items", ",")).otherwise(F.array_join("keep", ","))
    return rows.select("doc_id", "page_no", "el_no", "type", items.alias("items"))


@query("pages_of_two", f"{_ELEMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY el_no) - 1 AS nth FROM e) SELECT doc_id, text, CAST(nth // 2 + 1 AS INTEGER) AS page_no, CAST(nth % 2 AS INTEGER) AS el_no FROM n")
def pages_of_two(spark, sf_dir):
    return elements.paginate(_elements(spark, sf_dir), 2).select("doc_id", "text", "page_no", F.col("el_no").cast("int").alias("el_no"))


_WANTED = _pick((" AIR take ", "none-TRUCK", "Rail", "", "return-ship"), "o_orderkey")


@query("page_lookup", f"""{_ELEMENTS}, p AS (SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY el_no) AS t FROM e GROUP BY doc_id, page_no),
w AS (SELECT o_orderkey AS doc_id, substr(lower(trim({_WANTED.sql})), 1, 60) AS k, substr(regexp_replace(lower(trim({_WANTED.sql})), '[^a-z0-9]', '', 'g'), 1, 50) AS plain FROM orders)
SELECT w.doc_id, k AS snippet, min(CASE WHEN k <> '' AND contains(lower(t), k) THEN page_no END) AS page_no, min(CASE WHEN plain <> '' AND contains(regexp_replace(lower(t), '[^a-z0-9]', '', 'g'), plain) THEN page_no END) AS plain_page
FROM w LEFT JOIN p ON p.doc_id = w.doc_id GROUP BY w.doc_id, k""")
def page_lookup(spark, sf_dir):
    pages = elements.page_texts(_elements(spark, sf_dir))
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), _WANTED.column().alias("w"))
    found = elements.attach_page(pages, rows, "w")
    found = elements.attach_page(pages, found.withColumnRenamed("page_no", "first_page"), "w", 50, True)
    return found.select("doc_id", F.lower(F.trim("w")).alias("snippet"), F.col("first_page").alias("page_no"), F.col("page_no").alias("plain_page"))


@query("rescaled_words", """SELECT l_orderkey AS doc_id, l_linenumber AS line_no, coalesce(CASE WHEN l_partkey % 2 = 0 THEN CAST(l_tax AS DOUBLE) END, 0.0) + CAST(l_quantity AS DOUBLE) / 3 AS "left",
  CAST(l_discount AS DOUBLE) + CAST(l_quantity AS DOUBLE) / 3 AS top, CAST(l_quantity AS DOUBLE) / 3 AS width FROM lineitem""")
def rescaled_words(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    words = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), *(q.alias(c) for c in ("left", "top", "width", "height")),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_tax").cast("double")).alias("origin_x"), F.col("l_discount").cast("double").alias("origin_y"),
    )
    return elements.rescale_words(words).select("doc_id", "line_no", "left", "top", "width")


_VENDOR, _BUYER = _pick(("Acme", "", "B & C"), "c_custkey"), _pick(("", "You\nThem", "Me", "Us"), "c_custkey")


@query("parties_texts", f"""WITH p AS (SELECT c_custkey AS doc_id, {_VENDOR.sql} AS vendor, CASE WHEN c_custkey % 5 <> 0 THEN {_BUYER.sql} END AS buyer FROM customer)
SELECT doc_id, coalesce(nullif(vendor, ''), 'Unknown') || ' -> ' || coalesce(nullif(buyer, ''), 'Unknown') AS invoice_parties,
  CASE WHEN doc_id % 6 = 0 THEN 'Unknown' ELSE trim(vendor) || ' & ' || trim(replace(coalesce(buyer, 'Unknown'), chr(10), ' ')) END AS parties FROM p""")
def parties_texts(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), _VENDOR.column().alias("v"), F.when(F.col("c_custkey") % 5 != 0, _BUYER.column()).alias("b"))
    names = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array("v", "b"))
    return rows.select("doc_id", records.invoice_parties(F.col("v"), F.col("b")).alias("invoice_parties"), records.joined_parties(names).alias("parties"))


# Laws and jurisdictions by each of their patterns, in order

_LAWS = (
    ("It is governed by the laws of Utopia.", "Utopia"), ("The courts of North Ruritania, sitting in town, decide.", "North Ruritania"), ("Exclusive jurisdiction of Elbonia; no other.", "Elbonia"),
    ("The jurisdiction shall be Freedonia.", "Freedonia"), ("No law is named here.", None), ("Courts of Osterlich shall decide; governed by law of Genovia.", "Genovia"),
    ("Jurisdiction shall be Sylvania. The courts of Borduria, though.", "Borduria"), ("governed by law of the sea, and courts of Graustark.", "the sea"),
)
_JURISDICTIONS = (
    ("This is governed by the laws of the State of Utopia and others.", "Utopia"), ("The courts of North Ruritania will decide.", "North Ruritania"), ("The venue shall be in Elbonia.", "Elbonia"),
    ("subject to the exclusive jurisdiction of Freedonia;", "Freedonia"), ("The applicable law is the law of Genovia.", "Genovia"), ("It is construed in accordance with the laws of Sylvania,", "Sylvania"),
    ("Nothing of the kind.", None), ("Governed by the laws of the courts of, venue will be Borduria.", "Borduria"), ("Courts of Old (Upper) Graustark-on-Sea, that is", "Old (Upper) Graustark-on-Sea"),
)


def _cases(cases) -> str:
    return "CASE doc_id % {} {} END".format(len(cases), " ".join(f"WHEN {i} THEN {'NULL' if v is None else _quoted(v)}" for i, (_, v) in enumerate(cases)))


def _prefixed(spark, sf_dir, cases) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(t) for t, _ in cases)), (F.col("doc_id") % len(cases) + 1).cast("int"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.concat(said, F.lit("\n"), "text").alias("t"))


@query("governing_law_forms", f"SELECT doc_id, {_cases(_LAWS)} AS governing_law FROM documents")
def governing_law_forms(spark, sf_dir):
    """The first of four patterns that a text has, whatever their order in it."""
    return _prefixed(spark, sf_dir, _LAWS).select("doc_id", extract.governing_law(F.col("t")).alias("governing_law"))


@query("jurisdiction_forms", f"SELECT doc_id, {_cases(_JURISDICTIONS)} AS jurisdiction FROM documents")
def jurisdiction_forms(spark, sf_dir):
    """The first of six patterns whose value, without words of noise, has three characters."""
    return _prefixed(spark, sf_dir, _JURISDICTIONS).select("doc_id", classify.jurisdiction(F.col("t"))["value"].alias("jurisdiction"))
