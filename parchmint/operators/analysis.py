"""From a document's text to its record in one pass: payload, findings, risk and record of every type within the row.

docs: doc_id, doc_type, full_text, elements (array of ELEMENT, may be null). All that a document needs is in its row, so the run is
one scan of projections without a join, an aggregate or a shuffle, whatever the mix of types: a tagged union of structs, of which
each row fills its own type's. The payload leaves as a Variant.

Defined results: an unknown type is other; a document without text has an error, and no payload, findings or record; a document whose
headings can't be matched has an error instead of failing the job. Null elements are none.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint import dims
from parchmint.functions import fields as fd
from parchmint.functions.text import DATE, DURATION, MONEY, PAYMENT_TERMS, first, let, parse_number, plain_number, strip
from parchmint.operators import extract as ex
from parchmint.operators import findings as fi
from parchmint.operators import records, rules
from parchmint.operators.classify import capitalised_names, dates, jurisdiction, parties, summary
from parchmint.operators.documents import clause_value, is_heading
from parchmint.operators.names import ENTITIES, entities

ELEMENT = "struct<page_no:int,el_no:int,type:string,text:string,items:array<string>,headers:array<string>,rows:array<array<string>>>"
TYPES = tuple(ex.EXTRACTORS)
CLAUSAL = ("contract", "nda")
_STRINGS = "array<string>"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


# Clauses


def sections(lines: Column, heads: Column) -> Column:
    """Array of (header, body): lines under a heading; a heading without lines of its own is lost."""
    starts, ends = F.concat(F.array(F.lit(-1)), heads), F.concat(heads, F.array(F.size(lines)))
    bounds = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: s["b"] - s["a"] > 1)
    body = lambda s: F.array_join(F.slice(lines, s["a"] + 2, s["b"] - s["a"] - 1), "\n")
    header = lambda s: F.when(s["a"] >= 0, F.trim(F.get(lines, s["a"]))).otherwise("")
    return F.transform(bounds, lambda s: F.struct(header(s).alias("header"), F.trim(body(s), F.lit(" \t\n\r")).alias("body")))


def _contained(headers: Column, table: list[tuple[str, str]]) -> Column:
    """The type of each heading: the first variant that contains it or lies in it."""
    variants = F.from_json(F.lit(json.dumps([{"kind": kind, "variant": variant} for kind, variant in table])), "array<struct<kind:string,variant:string>>")
    hit = lambda name: F.try_element_at(F.filter(variants, lambda d: name.contains(d["variant"]) | d["variant"].contains(name)), F.lit(1))["kind"]
    # In lower case once, not for each variant.
    return F.transform(F.transform(headers, F.lower), lambda h: F.when(h != "", hit(h)))


def fuzzy_types(headers: Column, kind: Column, threshold: float = 75) -> Column:
    """(types, error): the type of each heading by its likest variant. A worker scores each heading once, whatever the documents."""
    tables = {k: [(t, v.lower()) for t, v in dims.clause_headers(nda=k == "nda")] for k in CLAUSAL}

    @F.pandas_udf("struct<types:array<string>,error:string>")
    def match(headers: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        likest = {k: lru_cache(maxsize=100_000)(ex.likest(t, threshold)) for k, t in tables.items()}

        out = []
        for names, kind in zip(headers, kinds, strict=True):
            try:
                out.append(([likest[kind](n.lower()) if n else None for n in names] if names is not None and kind in tables else None, None))
            except Exception as e:  # one document's headings don't fail the others'
                out.append((None, f"headings: {e}"))
        return pd.DataFrame(out, columns=["types", "error"])

    return match(headers, kind)


def clause_list(secs: Column, kinds: Column, types: tuple[str, ...], text: Column, pages: Column, money_anywhere: bool) -> Column:
    """Every type in order, as (clause_type, status, present, value, raw_text, notes, page). secs: array of (header, body), kinds: of their types."""
    # One step after another, so that each value is made once: the section, what it says and where its words are looked for, the clause.
    own = F.transform(F.array(*map(F.lit, types)), lambda kind: F.struct(kind.alias("kind"), F.get(secs, F.array_position(kinds, kind).cast("int") - 1).alias("s")))
    said = F.transform(own, lambda c: F.struct(c["kind"].alias("kind"), c["s"].isNotNull().alias("there"), _said(c["kind"], c["s"]["body"], text, money_anywhere).alias("said")))
    return F.transform(said, lambda c: _clause(c["kind"], c["there"], c["said"], pages))


def _said(kind: Column, body: Column, text: Column, money_anywhere: bool) -> Column:
    """(value, raw) of a clause's body; a payment amount without one is the first money of the text."""
    said = F.when(body.isNotNull(), F.struct(clause_value(kind, body).alias("value"), F.trim(F.substring(body, 1, 300)).alias("raw")))
    if money_anywhere:
        spare = let(F.when(kind == "payment_amount", first(text, MONEY)), lambda m: F.when(m.isNotNull(), F.struct(m.alias("value"), m.alias("raw"))))
        said = F.coalesce(said, F.when(kind == "payment_amount", spare))
    return said


def _clause(kind: Column, there: Column, said: Column, pages: Column) -> Column:
    value, present = said["value"], there | said.isNotNull()
    return F.struct(
        kind.alias("clause_type"), F.when(present, "present").otherwise("missing").alias("status"), present.alias("present"), F.when(value != "", value).alias("value"), said["raw"].alias("raw_text"),
        _none("string").alias("notes"), page_of(said["raw"], pages).alias("page"),
    )


# Pages


def page_texts(elements: Column) -> Column:
    """Array of (page_no, text): the texts of a page's elements joined by blanks in lower case, pages in order of their first element."""
    numbers = F.array_distinct(F.transform(elements, lambda e: e["page_no"]))
    own = lambda p: F.filter(elements, lambda e: e["page_no"].eqNullSafe(p))
    return F.transform(numbers, lambda p: F.struct(p.alias("page_no"), F.lower(F.array_join(F.transform(own(p), lambda e: F.coalesce(e["text"], F.lit(""))), " ")).alias("text")))


def page_of(snippet: Column, pages: Column, chars: int = 60) -> Column:
    """The first page that holds a snippet's first characters in lower case; null for none, or without a snippet."""
    key = F.substring(strip(F.lower(snippet)), 1, chars)
    return F.when(snippet != "", let(key, lambda k: F.try_element_at(F.filter(pages, lambda p: p["text"].contains(k)), F.lit(1))["page_no"]))


def classified(docs: DataFrame, names=capitalised_names) -> DataFrame:
    """doc_id, doc_type, error, jurisdiction, dates, parties, document_summary of docs, with the page of each date's context and each party's basis."""
    text, blank = F.col("full_text"), strip(F.coalesce("full_text", F.lit(""))) == ""
    rows = docs.withColumns({"error": F.when(blank, "no text"), "jurisdiction": jurisdiction(text), "dates": dates(text), "parties": parties(text, names)})
    # As a row of its own: the optimizer would else make the pages again within the lambda, for each date.
    rows = rows.withColumn("pages", F.explode(F.array(page_texts(F.coalesce("elements", F.array().cast(f"array<{ELEMENT}>"))))))
    paged = lambda column, snippet: F.transform(column, lambda x: x.withField("page", page_of(x[snippet], F.col("pages"))))
    said = F.when(~blank, summary(F.col("doc_type"), F.col("parties"), F.col("dates"), F.col("jurisdiction")))
    rows = rows.withColumns({"document_summary": said, "dates": paged("dates", "context"), "parties": paged("parties", "basis")})
    return rows.select("doc_id", "doc_type", "error", "jurisdiction", "dates", "parties", "document_summary")


# Payloads: a struct of each type


def _contract(text: Column, clauses: Column) -> Column:
    return F.struct(
        clauses.alias("clauses"), ex.governing_law(text).alias("governing_law"), first(F.substring(text, 1, 2000), DURATION).alias("contract_term"),
        text.rlike(fd.AUTO_RENEWAL).alias("auto_renewal"), text.rlike(fd.SIGNED).alias("signed"),
    )


def _nda(text: Column, clauses: Column) -> Column:
    mutual = F.substring(text, 1, 3000).rlike(fd.MUTUAL)
    return F.struct(clauses.alias("clauses"), mutual.alias("mutual"), ex.governing_law(text, ex.LAWS[:1]).alias("governing_law"), text.rlike(fd.SIGNED_NDA).alias("signed"))


def items_of(elements: Column) -> Column:
    """Items of tables whose headers name what items have: the amount is the last cell with a digit."""
    named = lambda e: let(F.lower(F.array_join(e["headers"], " ")), lambda h: reduce(Column.__or__, (h.contains(w) for w in ex.ITEM_WORDS)))
    tables = F.filter(elements, lambda e: F.coalesce(F.size(e["headers"]) > 0, F.lit(False)) & named(e))
    cell = lambda r, n: F.try_element_at(r, F.lit(n))
    described = lambda d: (d != "") & ~F.lower(d).isin(*ex.NO_ITEMS)
    rows = F.flatten(F.transform(tables, lambda e: F.coalesce(e["rows"], F.array().cast("array<array<string>>"))))
    rows = F.filter(rows, lambda r: (F.size(r) >= 2) & described(strip(F.coalesce(cell(r, 1), F.lit("")))))
    last = lambda r: F.try_element_at(F.filter(F.slice(r, 2, F.size(r)), lambda c: c.rlike(r"\d")), F.lit(-1))

    def item(r):
        return F.struct(
            strip(F.coalesce(cell(r, 1), F.lit(""))).alias("description"), F.when((F.size(r) > 2) & cell(r, 2).rlike(r"^[ \t\n\r\f\x0b]*[\d.]"), parse_number(cell(r, 2), cheap=True)).alias("quantity"),
            F.when(F.size(r) > 3, plain_number(cell(r, 3))).alias("unit_price"), plain_number(last(r)).alias("amount"), _none("double").alias("tax_rate"),
        )

    return F.transform(rows, item)


def _invoice(text: Column, elements: Column, low: Column, dated: Column) -> Column:
    none = _none("string")
    vendor = F.struct(none.alias("name"), none.alias("address"), fd.email(text, 1).alias("email"), fd.phone(text).alias("phone"), fd.group(text, fd.TAX_ID).alias("tax_id"))
    bill_to = F.struct(none.alias("name"), none.alias("address"), fd.email(text, 2).alias("email"))
    date = lambda n: F.try_element_at(dated, F.lit(n))
    return F.struct(
        vendor.alias("vendor"), bill_to.alias("bill_to"), fd.group(text, fd.INVOICE_NUMBER).alias("invoice_number"), date(1).alias("invoice_date"), date(2).alias("due_date"),
        fd.group(text, fd.PO_NUMBER).alias("purchase_order"), fd.currency(text).alias("currency"), items_of(elements).alias("line_items"),
        *(fd.labelled_amount(text, f, low).alias(f) for f in fd.AMOUNT_LABELS), first(text, PAYMENT_TERMS).alias("payment_terms"), none.alias("payment_method"),
        F.struct(*(fd.bank(text, f, low).alias(f) for f in fd.BANK)).alias("bank_details"), none.alias("notes"),
    )


def _first_name(named: Column, chars: int) -> Column:
    return F.try_element_at(F.filter(named, lambda e: e["start"] < chars), F.lit(1))["name"]


def _statement(text: Column, named: Column, low: Column) -> Column:
    blocks = {b: F.struct(*(fd.statement_row(text, names, low).alias(m) for m, names in own.items())) for b, own in fd.STATEMENT_LABELS.items()}
    period = F.substring(F.regexp_substr(text, F.lit(fd.PERIOD)), 1, 80)
    return F.struct(
        _first_name(named, 2000).alias("entity_name"), fd.statement_type(text).alias("statement_type"), period.alias("reporting_period"), fd.currency(text).alias("currency"),
        F.coalesce(fd.group(text, fd.UNIT), F.lit("actual")).alias("unit"), *(s.alias(b) for b, s in blocks.items()), text.rlike(fd.AUDITED).alias("audited"),
    )


def _metric(s: Column):
    """Name of a metric, or of another field -> its Column."""
    where = {m: b for b, own in fd.STATEMENT_LABELS.items() for m in own}
    return lambda name: s[where[name]][name] if name in where else s["ratios"][name] if name.endswith("_pct") or name in ("current_ratio", "debt_to_equity") else s[name]


def _rfp(text: Column, elements: Column, named: Column) -> Column:
    items = F.flatten(F.transform(elements, lambda e: F.coalesce(e["items"], F.array().cast(_STRINGS))))
    wanted = F.slice(F.filter(items, lambda i: F.char_length(i) > 20), 1, 20)
    requirement = lambda i: F.struct(F.lit("General").alias("category"), F.substring(i, 1, 500).alias("description"), i.rlike(fd.MANDATORY).alias("mandatory"))
    return F.struct(
        _first_name(named, 4000).alias("issuing_organisation"), fd.group(text, fd.RFP_TITLE).alias("rfp_title"), fd.group(text, fd.RFP_NUMBER).alias("rfp_number"),
        F.coalesce(fd.group(text, fd.RFP_DEADLINE), first(text, DATE)).alias("submission_deadline"), fd.group(text, fd.RFP_BUDGET).alias("contract_value"),
        F.transform(wanted, requirement).alias("requirements"), ex.criteria(text).alias("evaluation_criteria"),
        F.struct(_none("string").alias("name"), fd.email(text, -1).alias("email"), _none("string").alias("phone")).alias("contact"),
    )


def _other(text: Column, named: Column) -> Column:
    fact = lambda s: F.struct(strip(F.regexp_extract(s, fd.FACT, 1)).alias("label"), strip(F.regexp_extract(s, fd.FACT, 2)).alias("value"))
    return F.struct(
        F.substring(strip(F.regexp_replace(F.substring(strip(text), 1, 400), r"\s+", " ")), 1, 500).alias("document_summary"),
        F.transform(named, lambda e: F.struct(F.lit("NAME").alias("type"), e["name"].alias("name"), e["context"].alias("context"))).alias("key_entities"),
        F.slice(F.transform(F.regexp_extract_all(text, F.lit(fd.FACT), F.lit(0)), fact), 1, 15).alias("key_facts"),
        F.transform(F.slice(F.array_distinct(fd.dates(text)), 1, 8), lambda d: F.struct(d.alias("value"), F.lit("Date").alias("label"))).alias("dates"),
    )


def payloads(docs: DataFrame, fuzzy: bool = True, names=None) -> DataFrame:
    """docs with kind, error and a struct column per type, of which a document fills its own.

    `names` finds (name, start, end) in a text (operators.names trains such a function): the entity of a statement, the issuer of
    a proposal and the entities of other documents; without it there are none.
    """
    text = F.col("full_text")
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    rows = docs.withColumns({
        "kind": F.when(F.col("doc_type").isin(*TYPES), F.col("doc_type")).otherwise("other"), "error": F.when(blank, "no text"),
        "elements": F.coalesce("elements", F.array().cast(f"array<{ELEMENT}>")),
    })
    clausal, kind = F.col("kind").isin(*CLAUSAL) & F.col("error").isNull(), F.col("kind")
    rows = rows.withColumns({"lines": F.when(clausal, F.split(text, "\n", -1)), "pages": F.when(clausal, page_texts(F.col("elements")))})
    rows = rows.withColumn("heads", F.array_compact(F.transform(F.transform("lines", F.trim), lambda line, i: F.when(is_heading(line, True), i))))
    rows = rows.withColumn("secs", sections(F.col("lines"), F.col("heads")))
    headers = F.transform("secs", lambda s: s["header"])
    if fuzzy:
        rows = rows.withColumn("matched", fuzzy_types(headers, kind))
        rows = rows.withColumns({"error": F.coalesce("error", "matched.error"), "types": F.col("matched.types")})
    else:
        rows = rows.withColumn("types", F.when(kind == "nda", _contained(headers, dims.clause_headers(nda=True))).when(kind == "contract", _contained(headers, dims.clause_headers())))
    rows = rows.withColumn("named", entities(F.when(kind.isin("financial_statement", "rfp", "other"), text), names, 6000) if names else F.array().cast(ENTITIES))
    named = F.col("named")
    # Looked at for many labels, for two dates, or from within lambdas: made once. A generator parts the projections, as the optimizer would else put what
    # is named once, such as the pages, into the lambda that names it, and make it again for each type of clause.
    rows = rows.withColumns({"low": F.when(kind.isin("invoice", "financial_statement"), F.lower(text)), "dated": F.when(kind == "invoice", fd.dates(text))})
    shared = [c for c in ("secs", "types", "pages", "low", "dated") if c in rows.columns]
    rows = rows.select(*(c for c in rows.columns if c not in shared), F.inline(F.array(F.struct(*shared))))
    secs, kinds, pages, low, own = F.col("secs"), F.col("types"), F.col("pages"), F.col("low"), lambda name: (kind == name) & F.col("error").isNull()
    rows = rows.withColumns({
        "contract": F.when(own("contract"), _contract(text, clause_list(secs, kinds, tuple(dims.CLAUSE_HEADERS), text, pages, True))),
        "nda": F.when(own("nda"), _nda(text, clause_list(secs, kinds, (*dims.NDA_HEADERS, *dims.NDA_SHARED), text, pages, False))),
        "invoice": F.when(own("invoice"), _invoice(text, F.col("elements"), low, F.col("dated"))),
        "financial_statement": F.when(own("financial_statement"), _statement(text, named, low)),
        "rfp": F.when(own("rfp"), _rfp(text, F.col("elements"), named)),
        "other": F.when(own("other"), _other(text, named)),
    })
    s = F.col("financial_statement")
    ratios = F.struct(*(c.alias(n) for n, c in rules.ratio(_metric(s)).items()))
    rows = rows.withColumn("financial_statement", F.when(s.isNotNull(), s.withField("ratios", ratios)))
    return rows.drop("lines", "pages", "heads", "secs", "types", "matched", "elements", "full_text", "named", "low", "dated")


# Findings in the row


def _by_type(clauses: Column) -> Column:
    """Map of the present clauses by type."""
    return F.map_from_entries(F.transform(F.filter(clauses, lambda c: c["present"]), lambda c: F.struct(c["clause_type"], c)))


def _contract_findings(c: Column) -> Column:
    def judged(m):
        has, value = lambda t: F.map_contains_key(m, t), lambda t: F.try_element_at(m, F.lit(t))["value"]
        return fi.these(
            *(fi.missing_clause(~has(t), t, severity, category) for t, severity, category in dims.CONTRACT_REQUIRED), fi.no_law(c["governing_law"]), fi.short_notice(value("notice_period")),
            fi.long_terms(value("payment_terms")), fi.renewal_without_exit(c["auto_renewal"] & ~has("termination_for_convenience")),
            fi.no_ip_clause(has("payment_amount") & ~has("ip_assignment") & ~has("ip_license")),
        )

    return let(_by_type(c["clauses"]), judged)


def _nda_findings(n: Column) -> Column:
    listed = F.exists(n["clauses"], lambda x: x["clause_type"].isin("disclosing_party", "permitted_use"))

    def judged(m):
        missing = (fi.missing_clause(~F.map_contains_key(m, t), t, severity, category) for t, severity, category in dims.NDA_REQUIRED)
        return fi.these(*missing, fi.secrecy_length(F.try_element_at(m, F.lit("confidentiality_period"))["value"]), fi.one_sided(~n["mutual"] & ~listed), fi.no_law(n["governing_law"], True))

    return let(_by_type(n["clauses"]), judged)


def _line_findings(items: Column) -> Column:
    """Of each line in order: what doesn't add up, has no amount, or stood before (same description and amount); n log n in lines."""
    key = lambda x: F.concat(F.lower(F.trim(x["description"])), F.lit("_"), fi.amount(x["amount"]).cast("string"))
    math = lambda x: fi.line_math(x["quantity"], x["unit_price"], x["amount"], x["description"])
    zero = lambda x: fi.zero_amount(x["unit_price"], x["amount"], x["description"])
    # Most documents have no line twice: there a line has one finding at most, in its own place.
    plain = F.array_compact(F.transform(items, lambda x: F.coalesce(math(x), zero(x))))
    ranked = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"))))
    again = let(ranked, lambda r: F.array_compact(F.transform(r, lambda x, j: F.when(F.get(r, j - 1)["key"] == x["key"], x["i"]))))
    placed = lambda i, n, f: F.struct(i.alias("i"), F.lit(n).alias("n"), f.alias("f"))
    own = F.flatten(F.transform(items, lambda x, i: F.array(
        placed(i, 0, math(x)), placed(i, 1, zero(x)),
    )))
    twice = F.transform(again, lambda i: placed(i, 2, fi.duplicate_line(F.lit(True), F.get(items, i)["description"])))
    every = F.transform(F.sort_array(F.filter(F.concat(own, twice), lambda p: p["f"].isNotNull())), lambda p: p["f"])
    return F.when(F.size(F.array_distinct(F.transform(items, key))) == F.size(items), plain).otherwise(every)


def _invoice_findings(v: Column, as_of: Column) -> Column:
    summed = F.aggregate(v["line_items"], F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + fi.amount(x["amount"])).cast("decimal(18,2)"))
    due = v["due_date"]
    whole = lambda s: fi.these(
        fi.subtotal(s, v["subtotal"]), fi.total(s, v["subtotal"], v["tax_amount"], v["discount"], v["total_amount"]),
        fi.overdue(due, fi.days_late(due, as_of, True)), fi.missing_due(due), fi.missing_vendor(v["vendor"]["name"]),
    )
    return F.concat(_line_findings(v["line_items"]), let(summed, whole))


def _rfp_findings(r: Column) -> Column:
    stated = F.filter(F.transform(r["evaluation_criteria"], lambda c: c["weight_pct"]), lambda w: w.isNotNull())
    summed = F.when(F.size(stated) > 0, F.aggregate(stated, F.lit(0.0), lambda a, w: a + w))
    return fi.these(fi.missing_deadline(r["submission_deadline"]), fi.missing_contact(r["contact"]["email"], r["contact"]["phone"]), let(summed, fi.weights))


def judged(rows: DataFrame, as_of: str, fields: tuple[str, ...] = fi.FIELDS) -> DataFrame:
    """rows of `payloads` with findings (array), overall_score, and risk: penalty, score, level, points by category. fields: what is made of
    each finding, severity and category at least."""
    with fi.keeping(fields):
        return _judged(rows, as_of)


def _judged(rows: DataFrame, as_of: str) -> DataFrame:
    col, today = F.col, F.to_date(F.lit(as_of))
    made = {
        "contract": _contract_findings(col("contract")), "nda": _nda_findings(col("nda")), "invoice": _invoice_findings(col("invoice"), today),
        "financial_statement": fi.statement(_metric(col("financial_statement"))), "rfp": _rfp_findings(col("rfp")),
    }
    empty = F.filter(fi.these(fi.no_law(F.lit("x"))), lambda f: F.lit(False))
    chosen = reduce(lambda c, kv: c.when(col("kind") == kv[0], kv[1]), made.items(), F.when(col("kind") == "other", empty))
    # As rows of their own: what reads the findings doesn't judge again. Judged in a projection, as a generator isn't compiled.
    rows = rows.withColumn("judged", F.when(col("error").isNull(), chosen)).withColumn("findings", F.explode_outer(F.array("judged"))).drop("judged")
    worth = lambda f: rules.points(f["severity"]).cast("long")
    total = lambda keep: F.aggregate(F.filter("findings", keep), F.lit(0).cast("long"), lambda a, f: a + worth(f))
    within = lambda category: lambda f: rules.bucket(f["category"]) == category
    rows = rows.withColumns({"penalty": total(lambda f: F.lit(True)), **{c.lower(): total(within(c)) for c in dims.CATEGORIES}})
    rows = rows.withColumn("overall_score", F.when(col("error").isNull(), rules.score(col("penalty"), col("kind"))))
    risk = [col(c) for c in ("overall_score", "penalty", *(c.lower() for c in dims.CATEGORIES))]
    whole = F.struct(*risk, rules.level(col("overall_score")).alias("risk_level"), F.size("findings").cast("long").alias("total_anomalies"))
    return rows.withColumn("risk", F.when(col("error").isNull(), whole)).drop("penalty", *(c.lower() for c in dims.CATEGORIES))


# Records


def _key_fields(kind: Column) -> Column:
    clauses = F.coalesce("contract.clauses", "nda.clauses")
    v, s, r = (F.col(c) for c in ("invoice", "financial_statement", "rfp"))
    metric = _metric(s)
    money = lambda x: F.when(x != 0, fd.float_text(x))
    names = {k: v[f] for k, f in records.KEY_FIELDS["invoice"].items()} | {k: money(v[f]) for k, f in (("Total Amount", "total_amount"), ("Tax", "tax_amount"))}
    figures = {k: metric(f) if f == "reporting_period" else money(metric(f)) for k, f in records.KEY_FIELDS["financial_statement"].items()}
    return (
        F.when(kind.isin(*CLAUSAL), records.clause_lines(clauses))
        .when(kind == "invoice", records.field_lines(list(names.items())))
        .when(kind == "financial_statement", records.field_lines(list(figures.items())))
        .when(kind == "rfp", records.field_lines([("Deadline", r["submission_deadline"])]))
        .otherwise(records.NO_FIELDS)
    )


def _variant() -> Column:
    return F.coalesce(*(F.when(F.col(t).isNotNull(), F.to_variant_object(F.col(t))) for t in TYPES))


def variants(docs: DataFrame, fuzzy: bool = True, names=None) -> DataFrame:
    """(doc_id, doc_type, error, payload) of every document, as `analyse` gives them, with nothing judged: findings stand in rows of their own, so the optimizer can't leave them out."""
    return payloads(docs, fuzzy, names).select("doc_id", F.col("kind").alias("doc_type"), "error", _variant().alias("payload"))


def analyse(docs: DataFrame, as_of: str, fuzzy: bool = True, names=None, fields: tuple[str, ...] = fi.FIELDS) -> DataFrame:
    """(doc_id, doc_type, error, payload, findings, risk, record) of every document; as_of is the day that due dates are held against, fields are those of a finding (see `judged`)."""
    rows, kind = judged(payloads(docs, fuzzy, names), as_of, fields), F.col("kind")
    n = lambda *names: F.size(F.filter("findings", lambda f: F.lower(f["severity"]).isin(*names)))
    parties = F.when(kind == "invoice", records.invoice_parties(F.col("invoice.vendor.name"), F.col("invoice.bill_to.name"))).otherwise("Unknown")
    record = F.struct(
        F.substring(fd.title_case(kind), 1, 100).alias("document_type"), F.substring(parties, 1, 2000).alias("parties"), F.substring(_key_fields(kind), 1, 2000).alias("key_fields"),
        F.col("overall_score").alias("risk_score"), n("critical").alias("critical"), n("warning").alias("warning"), n("informational", "info").alias("informational"),
    )
    return rows.select("doc_id", kind.alias("doc_type"), "error", _variant().alias("payload"), "findings", "risk", F.when(F.col("error").isNull(), record).alias("record"))
