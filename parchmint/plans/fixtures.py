"""Business documents rendered from the star schema, once in DataFrames and once as SQL views of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key over four tasks a core: a small file is one task, however much is made of each of its rows."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def once(text):
    """A rendered text as a row of its own, so that readers of several fields don't each render it again in their plan."""
    return F.explode(F.array(text))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders; some have no price, some come twice."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    free = (F.col("l_orderkey") % 50 == 0) & (F.col("l_linenumber") == 1)
    rows = li.select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("line_no"), F.col("p_name").alias("description"), F.col("l_quantity").alias("quantity"),
        F.when(free, 0.0).otherwise(F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("unit_price"),
        F.when(free, 0.0).otherwise(F.round("l_extendedprice", 2)).alias("amount"),
    )
    # One scan: lines that come twice are made from their own row.
    first = F.struct("line_no", "description")
    again = F.when(F.col("doc_id") % 20 == 0, F.struct((F.col("line_no") + 100).alias("line_no"), F.concat(F.lit(" "), F.upper("description")).alias("description")))
    rows = rows.withColumn("l", F.explode(F.array_compact(F.array(first, again))))
    return rows.select("doc_id", "l.line_no", "l.description", "quantity", "unit_price", "amount")


LINES_SQL = """
lines0 AS (
  SELECT l_orderkey AS doc_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS line_no,
    p_name AS description, l_quantity AS quantity,
    CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN 0 ELSE floor(l_extendedprice / l_quantity * 100) / 100 END AS unit_price,
    CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN 0 ELSE round(l_extendedprice, 2) END AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey
), lines AS (
  SELECT * FROM lines0
  UNION ALL SELECT doc_id, line_no + 100, ' ' || upper(description), quantity, unit_price, amount FROM lines0 WHERE doc_id % 20 = 0
), sums AS (SELECT doc_id, sum(CAST(amount AS DECIMAL(18,2))) AS line_sum FROM lines GROUP BY doc_id)"""


def invoice_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of orders; one in ten states a subtotal, one in fifteen a total, that its lines don't add up to."""
    # Lines that come twice count twice; their order doesn't matter here.
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    free = (F.col("l_orderkey") % 50 == 0) & (F.col("l_linenumber") == 1)
    amount = F.when(free, 0.0).otherwise(F.round("l_extendedprice", 2)).cast("decimal(18,2)")
    sums = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sum(amount).alias("s"))
    sums = sums.withColumn("s", F.when(F.col("doc_id") % 20 == 0, F.col("s") + F.col("s")).otherwise(F.col("s")).cast("decimal(28,2)"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("project_id"), F.to_date("o_orderdate").alias("invoice_date"))
    s = F.coalesce("s", F.lit(0).cast("decimal(18,2)"))
    o = o.join(sums, "doc_id", "left")
    sub = s + F.when(F.col("doc_id") % 10 == 0, F.lit(5)).otherwise(0)
    tot = sub + F.when(F.col("doc_id") % 15 == 0, F.lit(7)).otherwise(0)
    return o.select(
        "doc_id", "project_id", "invoice_date", F.date_add("invoice_date", (15 + F.col("doc_id") % 90).cast("int")).alias("due_date"),
        sub.cast("double").alias("subtotal"), F.lit(0.0).alias("tax_amount"), F.lit(0.0).alias("discount"), tot.cast("double").alias("total_amount"),
    )


HEADER_SQL = """
header AS (
  SELECT o_orderkey AS doc_id, o_custkey AS project_id, CAST(o_orderdate AS DATE) AS invoice_date,
    CAST(CAST(o_orderdate AS DATE) + CAST(15 + o_orderkey % 90 AS INTEGER) AS DATE) AS due_date,
    coalesce(line_sum, 0) + CASE WHEN o_orderkey % 10 = 0 THEN 5 ELSE 0 END AS subtotal,
    coalesce(line_sum, 0) + CASE WHEN o_orderkey % 10 = 0 THEN 5 ELSE 0 END + CASE WHEN o_orderkey % 15 = 0 THEN 7 ELSE 0 END AS total_amount
  FROM orders LEFT JOIN sums ON sums.doc_id = o_orderkey
)"""

#: Clauses of a rendered contract: (type, heading, body with {d} days and {m} money).
CLAUSES = (
    ("payment_terms", "Payment Terms", "Invoices are payable within {d} days of receipt."),
    ("payment_amount", "Fees", "The fee is $ {m},000.00 in total."),
    ("termination_for_cause", "Termination For Cause", "Either party may end this agreement upon breach."),
    ("notice_period", "Notice Period", "Give {n} days to the other party."),
    ("liability_cap", "Limitation Of Liability", "Liability shall not exceed $ {m},500 in any year."),
    ("confidentiality", "Confidentiality", "Secrets are kept for 24 months after disclosure."),
    ("warranty", "Warranty", "Work is free of defects. No other promise is made."),
    ("force_majeure", "Force Majeure", "No party answers for storms."),
)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, project_id, text): contracts of suppliers, each without the clauses whose number fits its key; projects are customers of the whole range."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    parts = [F.lit("MASTER SERVICES AGREEMENT\nBetween the parties.")]
    for i, (_, head, body) in enumerate(CLAUSES):
        t = F.lit(f"{i + 1}. {head}\n{body}")
        for mark, value in (("{d}", 10 + key % 110), ("{m}", 1 + key % 900), ("{n}", 5 + key % 60)):
            t = F.replace(t, F.lit(mark), value.cast("string"))
        parts.append(F.when(key % 7 != i, t))
    law = F.translate("n_name", "_0123456789", " ABCDEFGHIJ")
    parts.append(F.concat(F.lit("9. Governing Law\nThis agreement is governed by the laws of "), law, F.lit(".")))
    return spread(s.select("s_suppkey", "n_name"), "s_suppkey").select(key.alias("doc_id"), (key * 15).alias("project_id"), once(F.concat_ws("\n", *parts)).alias("text"))


def _clause_sql() -> str:
    parts = []
    for i, (_, head, body) in enumerate(CLAUSES):
        t = f"'{i + 1}. {head}' || chr(10) || '{body}'"
        for mark, value in (("{d}", "10 + s_suppkey % 110"), ("{m}", "1 + s_suppkey % 900"), ("{n}", "5 + s_suppkey % 60")):
            t = f"replace({t}, '{mark}', CAST({value} AS VARCHAR))"
        parts.append(f"CASE WHEN s_suppkey % 7 <> {i} THEN {t} END")
    return ", ".join(parts)


CONTRACTS_SQL = f"""
contracts AS (
  SELECT s_suppkey AS doc_id, s_suppkey * 15 AS project_id,
    concat_ws(chr(10), 'MASTER SERVICES AGREEMENT' || chr(10) || 'Between the parties.', {_clause_sql()},
      '9. Governing Law' || chr(10) || 'This agreement is governed by the laws of ' || translate(n_name, '_0123456789', ' ABCDEFGHIJ') || '.') AS text
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Financial statements of customers with orders, in whole amounts."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    s = c.groupBy("c_custkey").agg(F.sum(F.floor("o_totalprice")).alias("r"), F.count("*").alias("n"))
    k, r = F.col("c_custkey"), F.col("r")
    whole = lambda x: F.floor(x).cast("double")
    return s.select(
        k.cast("long").alias("doc_id"), r.cast("double").alias("revenue"), whole((k % 5 - 1) * r / 8).alias("gross_profit"), whole((k % 7 - 3) * r / 10).alias("net_income"),
        whole((k % 3 + 1) * r / 16).alias("current_assets"), F.when(k % 11 != 0, whole(r / 8)).alias("current_liabilities"), whole((k % 4) * r / 4).alias("long_term_debt"),
        whole((k % 6 - 1) * r / 16).alias("total_equity"), whole(r / 2).alias("total_assets"), whole(r / 4 + (k % 2) * r / 8).alias("total_liabilities"), (k % 2 == 0).alias("audited"),
    )


STATEMENTS_SQL = """
st0 AS (SELECT c_custkey AS k, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS r FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
statements AS (
  SELECT CAST(k AS BIGINT) AS doc_id, r AS revenue, floor((k % 5 - 1) * r / 8) AS gross_profit, floor((k % 7 - 3) * r / 10) AS net_income,
    floor((k % 3 + 1) * r / 16) AS current_assets, CASE WHEN k % 11 <> 0 THEN floor(r / 8) END AS current_liabilities, floor((k % 4) * r / 4) AS long_term_debt,
    floor((k % 6 - 1) * r / 16) AS total_equity, floor(r / 2) AS total_assets, floor(r / 4 + (k % 2) * r / 8) AS total_liabilities, k % 2 = 0 AS audited
  FROM st0
), fs AS (
  SELECT *, round(gross_profit / nullif(revenue, 0) * 100, 2) + 0.0 AS gross_margin_pct, round(net_income / nullif(revenue, 0) * 100, 2) + 0.0 AS net_margin_pct,
    CASE WHEN current_assets <> 0 THEN round(current_assets / nullif(current_liabilities, 0), 2) + 0.0 END AS current_ratio,
    round(long_term_debt / nullif(total_equity, 0), 2) + 0.0 AS debt_to_equity, round(net_income / nullif(total_equity, 0) * 100, 2) + 0.0 AS return_on_equity_pct,
    round(net_income / nullif(total_assets, 0) * 100, 2) + 0.0 AS return_on_assets_pct
  FROM statements
)"""
