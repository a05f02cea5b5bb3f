"""Texts with names in them, rendered from keys in several layouts with the places of the names, and what a trained model finds in others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.operators import names
from parchmint.plans import fixtures as fx
from parchmint.plans.queries import query

_SYLLABLES = ("ba", "cor", "del", "fen", "gar", "hol", "jun", "kel", "lor", "mar", "nev", "os", "pren", "quil", "ros", "sten", "tav", "ul", "ver", "wex")
_FORMS = ("Ltd", "Inc.", "LLC", "GmbH", "Corporation", "& Sons", "Partners", "Group")
#: Layouts that a model is trained on; {a} and {b} are names.
LAYOUTS = (
    "This Services Agreement is made between {a} and {b} on March 5, 2024.\nPayment Terms apply.", "INVOICE\nInvoice No: 77\nVendor: {a}\nBill To: {b}\nTotal Due: $500.00",
    "{a}\nAnnual Report\nTotal Revenue for the Year Ended December 31, 2023 was $42 million.", "Request for Proposal\nIssued by {a}\nQuestions to the Procurement Office before April 30, 2024.",
    "The Receiving Party, {b}, shall notify {a} of all Confidential Information.", "Dear {b},\nWe write on behalf of {a} about the Limitation of Liability.\nYours, {a}",
    "NON DISCLOSURE AGREEMENT\nParties: {a} (Disclosing Party); {b} (Receiving Party)\nGoverning Law: Utopia", "Minutes of Monday, June 3, 2024. Present: {a}, {b}. The Board agreed on the Budget.",
    "Statement of Work No. 4\nClient: {a}\nContractor: {b}\nStart Date: July 1, 2024", "Cash Flow Statement for {a}\nNet Income 12\nPrepared by the Finance Department in Paris.",
    "This Lease is entered into by {a} (the Landlord) and {b} (the Tenant).\nIndemnification survives.", "Last Friday {b} confirmed to {a} that the Closing Date is near.",
    "Delivery Note 12\nFrom: {a}\nTo: {b}\nGross Weight: 10", "To Whom It May Concern: {a} has employed Staff in Berlin since January.",
    "SCOPE OF WORK\nThe Contractor {a} supplies Goods to {b}.\nEntire Agreement.", "Income Statement of {b}\nGross Profit 7\nReviewed by {a} for the Board.",
    "Annual Accounts of {a}\nCurrent Liabilities 3\nSigned in Madrid.", "Price List of {b}\nAll Prices in Euro.", "Trial Summary for {a} and {b}\nPhase Two",
)
#: Layouts that it has not seen.
HELD_OUT = (
    "Agreement dated May 1, 2024 by and between {a} (the Client) and {b} (the Vendor).\nForce Majeure is excluded.", "Purchase Order 9\nSupplier: {a}\nShip To: {b}\nNet Amount: 20.00",
    "On Tuesday {a} told {b} that the Delivery Date had passed.", "Balance Sheet of {a}\nTotal Assets 100\nAudited for {b} in London.",
)


def name(key, salt: int):
    """A name made of a key's hash: of an organisation, or one in four of a person."""
    h = lambda n: F.pmod(F.xxhash64(F.lit(salt * 100 + n), key), F.lit(1 << 20))
    part = lambda n: F.element_at(F.array(*map(F.lit, _SYLLABLES)), (h(n) % len(_SYLLABLES) + 1).cast("int"))
    word = lambda n: F.initcap(F.concat(part(n), part(n + 1), F.when(h(n + 2) % 3 == 0, part(n + 2)).otherwise("")))
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (h(9) % len(_FORMS) + 1).cast("int"))
    return F.when(h(8) % 4 == 0, F.concat_ws(" ", word(1), word(4))).when(h(8) % 4 == 1, F.concat_ws(" ", word(1), word(4), form)).otherwise(F.concat_ws(" ", word(1), form))


def texts(keys: DataFrame, layouts: tuple[str, ...]) -> DataFrame:
    """(doc_id, text, a, b) of keys (doc_id), with the names a, b in the text."""
    layout = F.element_at(F.array(*map(F.lit, layouts)), (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(len(layouts))) + 1).cast("int"))
    rows = keys.select("doc_id", name(F.col("doc_id"), 1).alias("a"), name(F.col("doc_id"), 2).alias("b"), layout.alias("layout"))
    return rows.withColumn("text", F.replace(F.replace("layout", F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b"))).filter(F.contains("text", "a") | F.contains("text", "b")).drop("layout")


def placed(rows: DataFrame) -> DataFrame:
    """texts with the places of both names."""

    def places(c):
        # Each part between names ends where a name begins.
        parts = F.split("text", F.concat(F.lit("\\Q"), c, F.lit("\\E")), -1)
        ends = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda s, p: s + F.char_length(p)) + i * F.char_length(c))
        return F.transform(ends, lambda s: F.struct(s.alias("start"), (s + F.char_length(c)).alias("end")))

    return rows.withColumn("names", F.concat(places(F.col("a")), places(F.col("b"))))


def rendered(keys: DataFrame, layouts: tuple[str, ...]) -> DataFrame:
    """(doc_id, text, a, b, names) of keys (doc_id): names has the places of both names."""
    return placed(texts(keys, layouts))


def trained(spark: SparkSession, sf_dir: str) -> names.Names:
    every = texts(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), LAYOUTS)
    # The same texts that `train` would choose, before their names are looked for.
    return names.train(placed(every.orderBy(F.xxhash64("text")).limit(names.LABELLED)).select("text", "names"))


@query("party_names")
def party_names(spark, sf_dir):
    """Names in texts of customers, in layouts that the model wasn't trained on: (doc_id, found), joined in order."""
    keys = fx.table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("doc_id"))
    found = names.entities(F.col("text"), trained(spark, sf_dir), 3000)
    # Dealt out, as a small file of keys is one task's.
    return texts(fx.spread(keys, "doc_id"), HELD_OUT).select("doc_id", F.array_join(F.transform(found, lambda e: e["name"]), "|").alias("found"))
