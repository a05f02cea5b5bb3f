"""Anomaly rules, risk scores and cross-document checks over tables: filters, anti joins and aggregates, one row per finding.

A finding has the fields of `findings.FIELDS`; `more` columns stand between doc_id and them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.dims import BASE_SCORES, CATEGORIES, CONTRACT_REQUIRED, NDA_REQUIRED, POINTS
from parchmint.functions.text import parse_date_strict, parse_days
from parchmint.operators import findings as fi


def exploded(rows: DataFrame, found: Column, *more: str) -> DataFrame:
    """The rows of an array of findings."""
    return rows.select("doc_id", *more, F.explode(found).alias("f")).select("doc_id", *more, "f.*")


def one(rows: DataFrame, found: Column, *more: str) -> DataFrame:
    return exploded(rows, fi.these(found), *more)


def _text_column(rows: DataFrame, name: str) -> bool:
    return rows.schema[name].dataType.typeName() == "string"


def line_math(lines: DataFrame, strict: bool = False) -> DataFrame:
    return one(lines, fi.line_math(*map(F.col, ("quantity", "unit_price", "amount", "description")), strict), "line_no")


def zero_amount(lines: DataFrame) -> DataFrame:
    return one(lines, fi.zero_amount(*map(F.col, ("unit_price", "amount", "description"))), "line_no")


def duplicate_lines(lines: DataFrame) -> DataFrame:
    """Second and later lines of the same description (trimmed, lower case) and amount."""
    key = Window.partitionBy("doc_id", F.lower(F.trim("description")), fi.amount(F.col("amount"))).orderBy("line_no")
    rows = lines.filter(F.coalesce("description", F.lit("")) != "").withColumn("nth", F.row_number().over(key))
    return one(rows, fi.duplicate_line(F.col("nth") > 1, F.col("description")), "line_no")


def line_sums(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.sum(fi.amount(F.col("amount"))).alias("line_sum"))


def _line_sum() -> Column:
    return F.coalesce("line_sum", F.lit(0).cast("decimal(18,2)"))


def subtotal_mismatch(header: DataFrame, lines: DataFrame) -> DataFrame:
    return one(header.join(line_sums(lines), "doc_id", "left"), fi.subtotal(_line_sum(), F.col("subtotal")))


def total_mismatch(header: DataFrame, lines: DataFrame) -> DataFrame:
    return one(header.join(line_sums(lines), "doc_id", "left"), fi.total(_line_sum(), *map(F.col, ("subtotal", "tax_amount", "discount", "total_amount"))))


def overdue(header: DataFrame, as_of: str) -> DataFrame:
    """due_date: a date, or text in one of the forms that `parse_date_loose` reads (others are passed over)."""
    late = fi.days_late(F.col("due_date"), F.to_date(F.lit(as_of)), _text_column(header, "due_date"))
    return one(header.withColumn("days_late", late), fi.overdue(F.col("due_date"), F.col("days_late")), "days_late")


def invoice_findings(header: DataFrame, lines: DataFrame, strict: bool = False) -> DataFrame:
    """The rules over lines and sums in one pass: an array of what applies to each line, gathered by document with the sum, and one join.

    `strict` is the variant with a tolerance of 0.1, duplicates that are exactly alike, no rule of lines without amounts, and a
    total that is compared with the stated subtotal only.
    """
    col = F.col
    described = F.coalesce("description", F.lit("")) != ""
    alike = ("description", F.coalesce("amount", F.lit(0.0))) if strict else (F.lower(F.trim("description")), fi.amount(col("amount")))
    key = Window.partitionBy("doc_id", *alike).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("nth", F.count(F.when(described, 1)).over(key))
    own = [fi.line_math(*map(col, ("quantity", "unit_price", "amount", "description")), strict)]
    own += [] if strict else [fi.zero_amount(*map(col, ("unit_price", "amount", "description")))]
    own = fi.these(*own, fi.duplicate_line(col("nth") > 1, col("description"), strict))
    listed = F.when(F.size(own) > 0, F.struct("line_no", own.alias("own")))
    by_doc = rows.groupBy("doc_id").agg(F.sum(fi.amount(col("amount"))).alias("line_sum"), F.array_sort(F.collect_list(listed)).alias("lines"))
    sums = header.select("doc_id", "subtotal", "tax_amount", "discount", "total_amount").join(by_doc, "doc_id", "full")
    whole = fi.these(fi.subtotal(_line_sum(), col("subtotal"), strict), fi.total(_line_sum(), *map(col, ("subtotal", "tax_amount", "discount", "total_amount")), strict))
    each = F.coalesce(F.flatten(F.transform("lines", lambda x: x["own"])), F.filter(whole, lambda x: F.lit(False)))
    return exploded(sums, F.concat(each, whole))


def missing_clauses(docs: DataFrame, clauses: DataFrame, required: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Required clauses (type, severity, category) that a document hasn't: an anti join."""
    names = ("clause_type", "severity", "category")
    wanted = docs.select("doc_id").withColumn("r", F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, row, strict=True))) for row in required))))
    wanted = wanted.select("doc_id", "r.*")
    rows = wanted.join(clauses.filter("present").select("doc_id", "clause_type").distinct(), ["doc_id", "clause_type"], "left_anti")
    return rows.select("doc_id", "clause_type", "severity", "category")


def short_notice(clauses: DataFrame) -> DataFrame:
    rows = clauses.filter("present AND clause_type = 'notice_period'").withColumn("days", parse_days(F.col("value")))
    return one(rows, fi.short_notice(F.col("value")), "days")


def long_terms(clauses: DataFrame) -> DataFrame:
    rows = clauses.filter("present AND clause_type = 'payment_terms'").withColumn("days", parse_days(F.col("value")))
    return one(rows, fi.long_terms(F.col("value")), "days")


def no_ip_clause(clauses: DataFrame) -> DataFrame:
    has = lambda *types: F.coalesce(F.bool_or(F.col("present") & F.col("clause_type").isin(*types)), F.lit(False))
    rows = clauses.groupBy("doc_id").agg(has("payment_amount").alias("pays"), has("ip_assignment", "ip_license").alias("ip"))
    return one(rows, fi.no_ip_clause(F.col("pays") & ~F.col("ip")))


def no_law(header: DataFrame, nda: bool = False) -> DataFrame:
    return one(header, fi.no_law(F.col("governing_law"), nda))


def renewal_without_exit(header: DataFrame, clauses: DataFrame) -> DataFrame:
    """Contracts that renew themselves and can't be ended at will: an anti join."""
    exits = clauses.filter("present AND clause_type = 'termination_for_convenience'").select("doc_id")
    return one(header.filter("auto_renewal").join(exits, "doc_id", "left_anti"), fi.renewal_without_exit(F.lit(True)))


def secrecy_length(clauses: DataFrame) -> DataFrame:
    """Secrecy without an end, or of over five years."""
    return one(clauses.filter("present AND clause_type = 'confidentiality_period'"), fi.secrecy_length(F.col("value")))


def one_sided(header: DataFrame, clauses: DataFrame) -> DataFrame:
    """Unilateral agreements without any entry for use or disclosure; filled clause lists always have one, so none is found there."""
    listed = clauses.filter("clause_type IN ('disclosing_party', 'permitted_use')").select("doc_id")
    return one(header.filter("mutual = false").join(listed, "doc_id", "left_anti"), fi.one_sided(F.lit(True)))


def missing_invoice_fields(header: DataFrame) -> DataFrame:
    return exploded(header, fi.these(fi.missing_due(F.col("due_date")), fi.missing_vendor(F.col("vendor_name"))))


def exact_duplicate_lines(lines: DataFrame) -> DataFrame:
    """Second and later lines of the very same description and amount."""
    key = Window.partitionBy("doc_id", "description", F.coalesce("amount", F.lit(0.0))).orderBy("line_no")
    rows = lines.filter("description <> ''").withColumn("nth", F.row_number().over(key))
    return one(rows, fi.duplicate_line(F.col("nth") > 1, F.col("description"), True), "line_no")


def strict_invoice_findings(header: DataFrame, lines: DataFrame) -> DataFrame:
    return invoice_findings(header, lines, True)


def rfp_gaps(header: DataFrame) -> DataFrame:
    return exploded(header, fi.these(fi.missing_deadline(F.col("submission_deadline")), fi.missing_contact(F.col("contact_email"), F.col("contact_phone"))))


def _missing(docs: DataFrame, clauses: DataFrame, required: tuple) -> DataFrame:
    gone = missing_clauses(docs, clauses, required)
    return one(gone, fi.missing_clause(F.lit(True), *map(F.col, ("clause_type", "severity", "category"))))


def contract_findings(header: DataFrame, clauses: DataFrame) -> DataFrame:
    parts = [_missing(header, clauses, CONTRACT_REQUIRED), no_law(header), short_notice(clauses).drop("days"), long_terms(clauses).drop("days"), renewal_without_exit(header, clauses), no_ip_clause(clauses)]
    return reduce(DataFrame.unionByName, parts)


def nda_findings(header: DataFrame, clauses: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [_missing(header, clauses, NDA_REQUIRED), secrecy_length(clauses), one_sided(header, clauses), no_law(header, True)])


def ratio(get) -> dict[str, Column]:
    """Ratios in per cent or as they are, 2 decimals; null without a denominator. get: name of a metric -> its Column."""
    pct = lambda a, b: F.round(F.try_divide(get(a), get(b)) * 100, 2)
    return {
        "gross_margin_pct": pct("gross_profit", "revenue"), "net_margin_pct": pct("net_income", "revenue"),
        "current_ratio": F.when(get("current_assets") != 0, F.round(F.try_divide(get("current_assets"), get("current_liabilities")), 2)),
        "debt_to_equity": F.round(F.try_divide(get("long_term_debt"), get("total_equity")), 2),
        "return_on_equity_pct": pct("net_income", "total_equity"), "return_on_assets_pct": pct("net_income", "total_assets"),
    }


def ratios(fs: DataFrame) -> DataFrame:
    return fs.withColumns(ratio(F.col))


def statement_findings(fs: DataFrame) -> DataFrame:
    """Rules over a statement with its ratios: one pass, an array of what applies, exploded."""
    return exploded(fs, fi.statement(F.col))


def rfp_weights(criteria: DataFrame) -> DataFrame:
    rows = criteria.groupBy("doc_id").agg(F.sum("weight_pct").alias("total_weight"))
    return one(rows, fi.weights(F.col("total_weight")), "total_weight")


def points(severity: Column) -> Column:
    low = F.lower(severity)
    return reduce(lambda c, kv: c.when(low == kv[0], kv[1]), list(POINTS.items())[1:], F.when(low == "critical", POINTS["critical"])).otherwise(1)


def bucket(category: Column) -> Column:
    """A category's bucket of points; unknown ones are operational."""
    return F.when(category.isin(*CATEGORIES), category).otherwise("Operational")


def score(penalty: Column, doc_type: Column) -> Column:
    """0 to 100: the curve of the penalty, not below what a type starts from."""
    base = reduce(lambda c, kv: c.when(doc_type == kv[0], kv[1]), list(BASE_SCORES.items())[1:], F.when(doc_type == "contract", BASE_SCORES["contract"])).otherwise(5)
    return F.least(F.lit(100), F.greatest(F.floor(100 * (1 - F.pow(F.lit(0.98), penalty))), base)).cast("int")


def level(overall: Column) -> Column:
    return F.when(overall < 40, "Low").when(overall < 75, "Medium").otherwise("High")


def points_by_category(findings: DataFrame) -> DataFrame:
    """Number of findings, penalty and points by category of the documents that have findings: one aggregate."""
    scored = findings.select("doc_id", points(F.col("severity")).alias("p"), bucket(F.col("category")).alias("category"))
    return scored.groupBy("doc_id").agg(F.count("*").alias("total_anomalies"), F.sum("p").alias("penalty"), *(F.sum(F.when(F.col("category") == c, F.col("p")).otherwise(0)).alias(c.lower()) for c in CATEGORIES))


def risk(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Score, level and points by category of every document, those without findings included. docs: doc_id, doc_type."""
    rows = docs.select("doc_id", "doc_type").join(points_by_category(findings), "doc_id", "left").na.fill(0)
    rows = rows.withColumn("overall_score", score(F.col("penalty"), F.col("doc_type")))
    return rows.withColumn("risk_level", level(F.col("overall_score")))


#: Rows of a block of a project's contracts or invoices.
BLOCK = 4096


def terms_violations(contracts: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoices that are due later than a contract of their project allows: an equi join with a range condition.

    contracts: project_id, doc_id, terms; invoices: project_id, doc_id, invoice_date, due_date (dates, or text as `parse_date_strict` reads it).
    """
    left, right = _limits(contracts), _spans(invoices)
    return left.join(right, "project_id").filter("invoice_days > contract_days").select("project_id", "contract_id", "contract_days", "invoice_id", "invoice_days")


def _limits(contracts: DataFrame, *more: str) -> DataFrame:
    days = F.regexp_extract(F.lower("terms"), r"(\d+)\s*days", 1).try_cast("int")
    return contracts.select("project_id", F.col("doc_id").alias("contract_id"), days.alias("contract_days"), *more).filter("contract_days IS NOT NULL")


def _spans(invoices: DataFrame, *more: str) -> DataFrame:
    date = lambda c: parse_date_strict(F.col(c)) if _text_column(invoices, c) else F.col(c)
    days = F.datediff(date("due_date"), date("invoice_date"))
    return invoices.select("project_id", F.col("doc_id").alias("invoice_id"), days.alias("invoice_days"), *more).filter("invoice_days IS NOT NULL")


def blocks(rows: DataFrame, doc_id: str, value: str, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """rows with `at`, and (project_id, at, low, high): a project's rows in order of a whole number, in blocks of some `size` rows.

    Counts of each value are summed first, and running sums over those cut a project into blocks, so no task orders a project's
    rows. A value of more than `size` rows has blocks of its own, in parts by hash. Rows get their block by value and salt.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int"))
    counted = salted.groupBy("project_id", value).agg(F.count("*").alias("n"), F.collect_set("salt").alias("salts"))
    before = Window.partitionBy("project_id").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    block = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size).cast("long")
    counted = counted.withColumns({"parts": F.ceil(F.col("n") / size).cast("int"), "block": block}).withColumn("own", F.when(F.col("parts") > 1, F.col(value)).otherwise(-1))
    place = lambda part: F.struct("block", "own", part.alias("part")).alias("at")
    table = counted.groupBy("project_id", "block", "own").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max("parts").alias("parts"))
    table = table.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("project_id", place(F.col("p")), "low", "high")
    met = salted.join(counted.select("project_id", value, "block", "own", "parts", F.explode("salts").alias("salt")), ["project_id", value, "salt"])
    return met.select(*rows.columns, place(F.pmod(F.xxhash64(F.lit(1), doc_id), F.col("parts")).cast("int"))), table


def _pairs(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """Pairs of a project with invoice_days > contract_days, by cells: two blocks that can hold some."""
    right = right.join(left.select("project_id").distinct(), "project_id", "left_semi")
    a, a_blocks = blocks(left, "contract_id", "contract_days", size)
    b, b_blocks = blocks(right, "invoice_id", "invoice_days", size)
    cells = a_blocks.select("project_id", F.col("at").alias("a"), "low").join(b_blocks.select("project_id", F.col("at").alias("b"), "high"), "project_id").filter("high > low").drop("high", "low")
    # Both sides go to their cells, so that a cell holds two blocks, however large its project.
    a, b = a.withColumnRenamed("at", "a").join(cells, ["project_id", "a"]), b.withColumnRenamed("at", "b").join(cells, ["project_id", "b"])
    return a.join(b, ["project_id", "a", "b"]).filter("invoice_days > contract_days").select("project_id", "contract_id", "contract_days", "invoice_id", "invoice_days")


def changed_violations(contracts: DataFrame, invoices: DataFrame, size: int = BLOCK) -> DataFrame:
    """`terms_violations` that involve a changed document (boolean column changed), as a stage over one upload reports them.

    Changed contracts meet all invoices of their projects and changed invoices the other contracts; in both, blocks in order of
    days meet only where they can hold a pair, so the work follows the pairs and no cell grows with a project.
    """
    left, right = _limits(contracts, "changed"), _spans(invoices, "changed")
    plain = lambda df, test: df.filter(test).drop("changed")
    return _pairs(plain(left, "changed"), right.drop("changed"), size).unionByName(_pairs(plain(left, "NOT coalesce(changed, false)"), plain(right, "changed"), size))


def revenue_discrepancies(statements: DataFrame, invoices: DataFrame) -> DataFrame:
    """Statements whose revenue is less than the project's invoices: sums before the join."""
    totals = invoices.groupBy("project_id").agg(F.sum(F.col("total_amount").cast("decimal(18,2)")).alias("invoiced"))
    return statements.join(totals, "project_id").filter(F.col("invoiced") > F.col("revenue").cast("decimal(18,2)"))


def distinct_descriptions(contradictions: DataFrame) -> DataFrame:
    """The first contradiction of each description in a project, by (title, doc1_name, doc2_name)."""
    first = Window.partitionBy("project_id", "description").orderBy("title", "doc1_name", "doc2_name")
    return contradictions.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def _invoice_rules(header: DataFrame, lines: DataFrame, as_of: str) -> DataFrame:
    return invoice_findings(header, lines).unionByName(overdue(header, as_of).drop("days_late")).unionByName(missing_invoice_fields(header))


#: Rules of each type over its tables; a type that isn't listed has none.
RULES = {
    "contract": contract_findings,
    "nda": nda_findings,
    "invoice": _invoice_rules,
    "financial_statement": statement_findings,
    "rfp": lambda header, criteria: rfp_gaps(header).unionByName(rfp_weights(criteria).drop("total_weight")),
}


def findings(tables: dict[str, tuple]) -> DataFrame:
    """Findings of all types at once: tables maps a type to what its rules take."""
    return reduce(DataFrame.unionByName, (RULES[kind](*args) for kind, args in tables.items() if kind in RULES))
