"""The incremental check across documents: the same pairs as brute force, cells that don't grow with a project."""

import random

import pytest
from pyspark.sql import functions as F

from parchmint.operators import rules

CONTRACT, INVOICE = "project_id long, doc_id string, terms string, changed boolean", "project_id long, doc_id string, invoice_date string, due_date string, changed boolean"


def tables(spark, seed=1, n=900):
    rng = random.Random(seed)
    project = lambda: 0 if rng.random() < 0.4 else rng.randrange(1, 30)
    changed = lambda: rng.choice([True, False, False, False, None])
    contracts = [(project(), f"c{i}", rng.choice([f"within {rng.randrange(5, 60)} days", "Net 30 Days", "none", None]), changed()) for i in range(n // 6)]
    day = lambda d: rng.choice([f"January {d}, 2024", f"{d}/1/2024", f"2024-01-{d:02d}"])
    # A third of the first project's invoices have the very same number of days.
    invoices = [(project(), f"i{i}", rng.choice([day(1), day(1), None, "soon"]), day(31 if rng.random() < 0.3 else rng.randrange(1, 31)), changed()) for i in range(n)]
    return contracts, invoices


def brute(spark, contracts, invoices):
    """All pairs by the equi join over whole projects, then those with a changed document."""
    every = rules.terms_violations(spark.createDataFrame(contracts, CONTRACT), spark.createDataFrame(invoices, INVOICE)).collect()
    new = {r[1] for r in contracts if r[3]} | {r[1] for r in invoices if r[4]}
    return sorted(tuple(r) for r in every if r.contract_id in new or r.invoice_id in new)


@pytest.mark.parametrize("size", [4, 30, rules.BLOCK])
def test_pairs_with_a_changed_document(spark, size):
    contracts, invoices = tables(spark, size)
    got = rules.changed_violations(spark.createDataFrame(contracts, CONTRACT), spark.createDataFrame(invoices, INVOICE), size)
    want = brute(spark, contracts, invoices)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_blocks_are_bounded_in_a_hot_project(spark):
    _, invoices = tables(spark, 3, 3000)
    spans = rules._spans(spark.createDataFrame(invoices, INVOICE))
    placed, table = rules.blocks(spans, "invoice_id", "invoice_days", 50)
    sizes = [r["count"] for r in placed.groupBy("project_id", "at").count().collect()]
    assert placed.count() == spans.count() == sum(sizes) and max(sizes) <= 100 + 30  # two blocks' rows; parts by hash vary
    edges = table.alias("t").join(placed, ["project_id", "at"]).filter("invoice_days < low OR invoice_days > high").count()
    assert edges == 0 and table.groupBy("project_id", "at").count().filter("count > 1").count() == 0


def test_nothing_changed_and_empty_tables(spark):
    contracts, invoices = tables(spark, 4, 60)
    still = rules.changed_violations(spark.createDataFrame(contracts, CONTRACT).withColumn("changed", F.lit(False)), spark.createDataFrame(invoices, INVOICE).withColumn("changed", F.lit(None).cast("boolean")))
    assert still.collect() == []
    assert rules.changed_violations(spark.createDataFrame([], CONTRACT), spark.createDataFrame([], INVOICE)).collect() == []
