"""Payloads that a model answered as JSON, made to fit the types: unknown values dropped or mended, texts capped,
numbers coerced, what is missing filled. raw: doc_id, payload (JSON text). Text that isn't JSON counts as an empty object.

Objects are read by path from a variant, so that a field of another type than expected gives null and no failed row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions import fields as fd
from parchmint.functions.text import let, strip
from parchmint import dims

STATUSES = ("present", "missing", "explicitly_waived")
STATEMENT_TYPES = ("income_statement", "balance_sheet", "cash_flow_statement", "combined", "other")
RATIOS = ("gross_margin_pct", "net_margin_pct", "current_ratio", "debt_to_equity", "return_on_equity_pct", "return_on_assets_pct")
NDA_TYPES = (*[t for t in dims.NDA_HEADERS], "confidentiality_period", "non_compete", "non_solicitation", "notice_period", "dispute_resolution", "assignment")
ROLES = (*dims.ROLE_WORDS, "Party")
LABELS = (*dict.fromkeys(dims.DATE_LABELS.values()), "Date")


def parsed(payload: Column) -> Column:
    return F.coalesce(F.try_parse_json(payload), F.parse_json(F.lit("{}")))


def get(v: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def nothing(v: Column, key: str) -> Column:
    """Whether a value counts as nothing: empty text, list or object, false, zero; null if it isn't there."""
    s = get(v, key)
    other = F.schema_of_variant(get(v, key, "variant")) != "STRING"
    return (s == "") | (other & s.isin("false", "0", "0.0", "[]", "{}"))


def text(v: Column, key: str, cap: int | None = None) -> Column:
    """A value as text, capped; null for what counts as nothing."""
    s = F.when(~nothing(v, key), get(v, key))
    return F.substring(s, 1, cap) if cap else s


def number(v: Column, key: str, marks: bool = False) -> Column:
    """A number or a text that is one, with `marks` also with $ and commas; true and false are 1 and 0; else null."""
    s = get(v, key)
    if marks:
        s = F.translate(s, "$,", "")
    return F.when(s == "true", 1.0).when(s == "false", 0.0).otherwise(strip(s).try_cast("double"))


def flag(v: Column, key: str) -> Column:
    """Whether a value counts as something; null if it isn't there."""
    return ~nothing(v, key)


def objects(v: Column, key: str) -> Column:
    """The objects of a list; other members and other values than lists are left out."""
    members = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(members, lambda m: F.schema_of_variant(m).startswith("OBJECT"))


def each(v: Column, key: str, make: Callable[[Column], dict[str, Column]], keep: Callable[[Column], Column] | None = None) -> Column:
    rows = F.transform(objects(v, key), lambda m: F.struct(*(c.alias(k) for k, c in make(m).items())))
    return F.filter(rows, keep) if keep else rows


def _clauses(v: Column, types: tuple[str, ...], fallback: str) -> Column:
    """One entry per type in order: the first of the answer, else a missing one."""
    def one(m):
        raw, spare = F.lower(F.coalesce(get(m, "status"), F.lit("missing"))), F.lower(get(m, fallback))
        status = F.when(raw.isin(*STATUSES), raw).when(spare == "true", "present").otherwise("missing")
        return {"clause_type": get(m, "clause_type"), "status": status, "value": text(m, "value", 500), "raw_text": text(m, "raw_text", 300), "notes": text(m, "notes", 300)}

    given = each(v, "clauses", one)
    none = lambda t: F.struct(t.alias("clause_type"), F.lit("missing").alias("status"), *(F.lit(None).cast("string").alias(c) for c in ("value", "raw_text", "notes")))
    own = lambda found: lambda t: F.coalesce(F.try_element_at(F.filter(found, lambda c: c["clause_type"] == t), F.lit(1)), none(t))
    # Parsed once, not once a type.
    return let(given, lambda found: F.transform(F.array(*map(F.lit, types)), own(found)))


def _fields(raw: DataFrame, make: Callable[[Column], dict[str, Column]]) -> DataFrame:
    rows = raw.select("doc_id", parsed(F.col("payload")).alias("v"))
    return rows.select("doc_id", *(c.alias(k) for k, c in make(F.col("v")).items()))


def contract(raw: DataFrame) -> DataFrame:
    def make(v):
        mile = lambda m: {"name": text(m, "name", 100), "description": text(m, "description", 300), "due_date": text(m, "due_date", 100), "amount": number(m, "amount", True)}
        return {
            "clauses": _clauses(v, tuple(dims.CLAUSE_HEADERS), "status"), "milestones": each(v, "milestones", mile, lambda m: m["name"].isNotNull() | m["description"].isNotNull()),
            "governing_law": text(v, "governing_law", 200), "contract_term": text(v, "contract_term", 200), "auto_renewal": flag(v, "auto_renewal"), "signed": flag(v, "signed"),
        }

    return _fields(raw, make)


def nda(raw: DataFrame) -> DataFrame:
    return _fields(raw, lambda v: {"clauses": _clauses(v, NDA_TYPES, "present"), "mutual": flag(v, "mutual"), "governing_law": text(v, "governing_law"), "signed": flag(v, "signed")})


def invoice(raw: DataFrame) -> DataFrame:
    def make(v):
        item = lambda m: {"description": F.substring(F.coalesce(get(m, "description"), F.lit("")), 1, 300), **{k: number(m, k) for k in ("quantity", "unit_price", "amount", "tax_rate")}}
        party = lambda p, keys: F.struct(*(text(v, f"{p}.{k}", 300).alias(k) for k in keys))
        plain = ("invoice_number", "invoice_date", "due_date", "purchase_order", "payment_terms", "payment_method")
        return {
            "vendor": party("vendor", ("name", "address", "email", "phone", "tax_id")), "bill_to": party("bill_to", ("name", "address", "email")), **{k: text(v, k) for k in plain},
            "currency": text(v, "currency", 10), "line_items": each(v, "line_items", item), **{k: number(v, k) for k in ("subtotal", "tax_amount", "discount", "total_amount")},
            "bank_details": F.struct(*(text(v, f"bank_details.{k}").alias(k) for k in fd.BANK)), "notes": text(v, "notes", 500),
        }

    return _fields(raw, make)


def financial_statement(raw: DataFrame) -> DataFrame:
    def make(v):
        block = lambda b, keys: F.struct(*(number(v, f"{b}.{k}").alias(k) for k in keys))
        more = lambda m: {"name": text(m, "name", 200), "value": number(m, "value"), "unit": text(m, "unit", 50)}
        kind = get(v, "statement_type")
        return {
            "entity_name": text(v, "entity_name"), "statement_type": F.when(kind.isin(*STATEMENT_TYPES), kind).otherwise("other"), "reporting_period": text(v, "reporting_period"),
            "currency": text(v, "currency", 10), "unit": text(v, "unit", 50), **{b: block(b, keys) for b, keys in fd.STATEMENT_LABELS.items()}, "ratios": block("ratios", RATIOS),
            "additional_metrics": each(v, "additional_metrics", more, lambda m: m["name"].isNotNull()), "prior_period_label": text(v, "prior_period_label"), "audited": flag(v, "audited"),
        }

    return _fields(raw, make)


def rfp(raw: DataFrame) -> DataFrame:
    # Caps of texts.
    caps = {
        "issuing_organisation": 200, "rfp_title": 200, "rfp_number": 100, "issue_date": 100, "submission_deadline": 100, "submission_method": 300, "contract_value": 200,
        "contract_duration": 100, "scope_of_work": 500, "qa_deadline": 100, "award_date": 100, "incumbent": 200,
    }

    def make(v):
        need = lambda m: {"category": F.when(get(m, "category").isNull(), "General").otherwise(text(m, "category", 100)), "description": text(m, "description", 500), "mandatory": F.coalesce(flag(m, "mandatory"), F.lit(False))}
        return {
            **{k: text(v, k, n) for k, n in caps.items()}, "requirements": each(v, "requirements", need, lambda m: m["description"].isNotNull()),
            "evaluation_criteria": each(v, "evaluation_criteria", lambda m: {"criterion": text(m, "criterion", 200), "weight_pct": number(m, "weight_pct")}, lambda m: m["criterion"].isNotNull()),
            "deliverables": each(v, "deliverables", lambda m: {"name": text(m, "name", 200), "due_date": text(m, "due_date", 100)}, lambda m: m["name"].isNotNull()),
            "contact": F.struct(text(v, "contact.name", 200).alias("name"), text(v, "contact.email", 200).alias("email"), text(v, "contact.phone", 100).alias("phone")),
            "confidentiality": flag(v, "confidentiality"),
        }

    return _fields(raw, make)


def other(raw: DataFrame) -> DataFrame:
    def make(v):
        kind = lambda m: F.when(get(m, "type").isNull(), "Entity").otherwise(text(m, "type", 100))
        return {
            "document_summary": text(v, "document_summary", 500),
            "key_entities": each(v, "key_entities", lambda m: {"type": kind(m), "name": text(m, "name", 200), "context": text(m, "context", 200)}, lambda m: m["name"].isNotNull()),
            "key_facts": each(v, "key_facts", lambda m: {"label": text(m, "label", 200), "value": text(m, "value", 500)}, lambda m: m["label"].isNotNull()),
            "dates": each(v, "dates", lambda m: {"value": text(m, "value", 100), "label": text(m, "label", 100)}, lambda m: m["value"].isNotNull()),
        }

    return _fields(raw, make)


def classification(raw: DataFrame) -> DataFrame:
    """Types, roles and labels that aren't known become other, Party and Date; two parties at most; each date once."""
    def make(v):
        known = lambda c, values, spare: F.when(c.isin(*values), c).otherwise(spare)
        party = lambda m: {"name": strip(F.coalesce(get(m, "name"), F.lit(""))), "role": known(get(m, "role"), ROLES, "Party"), "basis": F.substring(F.coalesce(get(m, "basis"), F.lit("")), 1, 300)}
        date = lambda m: {"value": strip(F.coalesce(get(m, "value"), F.lit(""))), "label": known(get(m, "label"), LABELS, "Date"), "context": F.substring(F.coalesce(get(m, "context"), F.lit("")), 1, 200)}
        members = F.slice(F.coalesce(F.try_variant_get(v, "$.primary_parties", "array<variant>"), F.array().cast("array<variant>")), 1, 2)
        people = F.filter(F.transform(F.filter(members, lambda m: F.schema_of_variant(m).startswith("OBJECT")), lambda m: F.struct(*(c.alias(k) for k, c in party(m).items()))), lambda p: p["name"] != "")
        all_dates = each(v, "dates", date, lambda d: d["value"] != "")
        values = F.transform(all_dates, lambda d: d["value"])
        law = F.rtrim(strip(get(v, "jurisdiction.value")), F.lit(".,;"))
        return {
            "document_summary": text(v, "document_summary", 1000), "document_type": known(get(v, "document_type"), tuple(dims.TYPE_LABELS), "other"), "primary_parties": people,
            "dates": F.filter(all_dates, lambda d, i: F.array_position(values, d["value"]) == i + 1),
            "jurisdiction": F.when(law != "", F.struct(law.alias("value"), F.substring(F.coalesce(get(v, "jurisdiction.context"), F.lit("")), 1, 200).alias("context"))),
        }

    return _fields(raw, make)


#: Validator of each type, as the extractors have one each.
VALIDATORS = {"contract": contract, "nda": nda, "invoice": invoice, "financial_statement": financial_statement, "rfp": rfp, "other": other}
