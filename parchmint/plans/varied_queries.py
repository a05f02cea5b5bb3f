"""Queries of rules and text functions over inputs that vary by row, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.functions import fields as fd
from parchmint.functions import text as tx
from parchmint.operators import rules
from parchmint.plans import fixtures as fx
from parchmint.plans.queries import query

# Rules over clauses and headers


def _clauses(spark, sf_dir) -> DataFrame:
    """Clauses of orders, some absent, with values of every kind."""
    k, n = F.col("l_partkey") % 8, F.col("l_quantity").cast("int").cast("string")
    kinds = ("confidentiality_period", "termination_for_convenience", "disclosing_party", "payment_amount", "ip_license")
    value = F.when(k == 0, "").when(k == 1, "Perpetual").when(k == 2, "for an INDEFINITE time").when(k == 3, "with no expiration").when(k == 4, F.concat(n, F.lit(" years")))
    value = value.when(k == 5, F.concat(F.lit("within "), n, F.lit(" months"))).when(k == 6, F.concat(n, F.lit(" calendar days"))).otherwise(F.concat(n, F.lit("  weeks")))
    return fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("clause_type"), (F.col("l_linenumber") % 4 != 0).alias("present"), value.alias("value"))


def _headers(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    law = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "").otherwise("Utopia")
    return fx.table(spark, sf_dir, "orders").select(k.alias("doc_id"), law.alias("governing_law"), (k % 3 == 0).alias("auto_renewal"), F.when(k % 4 != 0, k % 2 == 0).alias("mutual"))


_SQL = """
clauses AS (SELECT l_orderkey AS doc_id, ['confidentiality_period', 'termination_for_convenience', 'disclosing_party', 'payment_amount', 'ip_license'][1 + l_suppkey % 5] AS clause_type, l_linenumber % 4 <> 0 AS present,
  CASE l_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'Perpetual' WHEN 2 THEN 'for an INDEFINITE time' WHEN 3 THEN 'with no expiration' WHEN 4 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' years'
    WHEN 5 THEN 'within ' || CAST(l_quantity AS INTEGER) || ' months' WHEN 6 THEN CAST(l_quantity AS INTEGER) || ' calendar days' ELSE CAST(l_quantity AS INTEGER) || '  weeks' END AS value FROM lineitem),
heads AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Utopia' END AS governing_law, o_orderkey % 3 = 0 AS auto_renewal, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 2 = 0 END AS mutual FROM orders)"""


@query("secrecy_length", f"""WITH {_SQL}, days AS (SELECT *, TRY_CAST(nullif(regexp_extract(lower(value), '(\\d+)\\s*(day|week|month|year)', 1), '') AS INTEGER)
  * CASE regexp_extract(lower(value), '(\\d+)\\s*(day|week|month|year)', 2) WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 365 END AS days,
  regexp_matches(lower(value), 'perpetual|indefinite|no expir') AS endless FROM clauses WHERE present AND clause_type = 'confidentiality_period' AND value <> '')
SELECT doc_id, CASE WHEN endless THEN 'Perpetual Confidentiality Obligation' ELSE 'Very Long Confidentiality Period' END AS title, CASE WHEN endless THEN 'warning' ELSE 'informational' END AS severity FROM days WHERE endless OR days > 1825""")
def secrecy_length(spark, sf_dir):
    return rules.secrecy_length(_clauses(spark, sf_dir)).select("doc_id", "title", "severity")


@query("missing_law", f"WITH {_SQL} SELECT doc_id, 'Missing Governing Law' AS title FROM heads WHERE governing_law IS NULL OR governing_law = ''")
def missing_law(spark, sf_dir):
    return rules.no_law(_headers(spark, sf_dir)).select("doc_id", "title")


@query("renewal_without_exit", f"""WITH {_SQL} SELECT doc_id, 'Auto-Renewal Without Explicit Opt-Out' AS title FROM heads
WHERE auto_renewal AND doc_id NOT IN (SELECT doc_id FROM clauses WHERE present AND clause_type = 'termination_for_convenience')""")
def renewal_without_exit(spark, sf_dir):
    return rules.renewal_without_exit(_headers(spark, sf_dir), _clauses(spark, sf_dir)).select("doc_id", "title")


@query("one_sided", f"WITH {_SQL} SELECT doc_id, 'One-Sided NDA — Limited Receiving-Party Protections' AS title FROM heads WHERE NOT mutual AND doc_id NOT IN (SELECT doc_id FROM clauses WHERE clause_type = 'disclosing_party')")
def one_sided(spark, sf_dir):
    return rules.one_sided(_headers(spark, sf_dir), _clauses(spark, sf_dir)).select("doc_id", "title")


@query("strict_totals", f"""WITH {fx.LINES_SQL}, {fx.HEADER_SQL}
SELECT doc_id, 'Subtotal Reconciliation Failed' AS title FROM header LEFT JOIN sums USING (doc_id) WHERE subtotal > 0 AND abs(coalesce(line_sum, 0) - subtotal) > 0.10
UNION ALL SELECT doc_id, 'Total Reconciliation Failed' FROM header WHERE total_amount > 0 AND abs(subtotal - total_amount) > 0.10""")
def strict_totals(spark, sf_dir):
    found = rules.strict_invoice_findings(fx.invoice_header(spark, sf_dir), fx.invoice_lines(spark, sf_dir))
    return found.filter(F.col("title").endswith("Reconciliation Failed")).select("doc_id", "title")


# Text functions

PHRASES = (
    "It automatically renews.", "This is auto-renewal.", "The term RENEWS AUTOMATICALLY each year.", "renewing isn't it", "Signed by A and B", "designated by A", "IN WITNESS whereof", "A mutual duty",
    "both parties shall keep it", "both parties may", "bilateral", "immutual",
)
_PHRASES_SQL = ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES)
_DOCS_SQL = f"docs AS (SELECT doc_id, [{_PHRASES_SQL}][1 + doc_id % {len(PHRASES)}] || ' ' || text AS t FROM documents)"


def _docs(spark, sf_dir) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.concat(phrase, F.lit(" "), "text").alias("t"))


@query("contract_flags", f"WITH {_DOCS_SQL} SELECT doc_id, regexp_matches(t, '{fd.AUTO_RENEWAL}') AS auto_renewal, regexp_matches(t, '{fd.SIGNED}') AS signed, regexp_matches(t, '{fd.MUTUAL}') AS mutual FROM docs")
def contract_flags(spark, sf_dir):
    t = F.col("t")
    return _docs(spark, sf_dir).select("doc_id", t.rlike(fd.AUTO_RENEWAL).alias("auto_renewal"), t.rlike(fd.SIGNED).alias("signed"), t.rlike(fd.MUTUAL).alias("mutual"))


@query("first_sentences", f"""WITH {_DOCS_SQL}, s AS (SELECT doc_id, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM docs)
SELECT doc_id, substr(coalesce(nullif(regexp_extract(t, '(?s)^(.*?[.!?])\\s', 1), ''), t), 1, 150) AS sentence FROM s""")
def first_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fd.first_sentence(F.col("t")).alias("sentence"))


@query("markdown_cleaned", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace('# ' || text || chr(10) || '## [a *b*](http://c) `d`_', '(?m)^#+\s*', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`]', '', 'g'))) AS digest FROM documents""")
def markdown_cleaned(spark, sf_dir):
    text = F.concat(F.lit("# "), "text", F.lit("\n## [a *b*](http://c) `d`_"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_markdown(text)).alias("digest"))


@query("ocr_cleaned", r"""WITH a AS (SELECT doc_id, replace(replace(text, ' de ', ' d|e , '), ' the ', ' th- e oﬃce ') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '([A-Za-z])-\s+([a-z])', '\1\2', 'g') AS t FROM a), c AS (SELECT doc_id, replace(regexp_replace(t, '([A-Za-z])[|\[\]]([A-Za-z])', '\1l\2', 'g'), 'ﬃ', 'ffi') AS t FROM b)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '\s+([.,;:?!])', '\1', 'g'), '\s{2,}', ' ', 'g'))) AS digest FROM c""")
def ocr_cleaned(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit(" de "), F.lit(" d|e , ")), F.lit(" the "), F.lit(" th- e oﬃce "))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_ocr(text)).alias("digest"))


@query("money_texts", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN '$-' ELSE '$' END || format('{:,.2f}', o_totalprice) AS money FROM orders")
def money_texts(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), fd.money_text(price).alias("money"))


@query("around_mark", """WITH m AS (SELECT doc_id, text, strpos(text, '@') AS p FROM documents)
SELECT doc_id, substr(trim(substr(text, greatest(p - 31, 0) + 1, p + 20 - greatest(p - 31, 0)), ' ' || chr(9) || chr(10) || chr(13)), 1, 200) AS piece FROM m WHERE p > 0""")
def around_mark(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", fd.around(F.col("text"), "@", 30, 20).alias("piece")).filter("piece IS NOT NULL")
