"""Names: held-out layouts and names, decoding by brute force, entities and issuers filled."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmint.operators import analysis, classify, names
from parchmint.plans import letters


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return letters.trained(spark, sf_dir)


def test_decoding_equals_brute_force():
    rng = np.random.default_rng(2)
    for n in range(1, 6):
        for _ in range(20):
            scores, moves = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
            ways = [w for w in itertools.product(range(3), repeat=n) if w[0] != names.I and not any(a == names.O and b == names.I for a, b in zip(w, w[1:], strict=False))]
            best = max(ways, key=lambda w: sum(scores[i, t] for i, t in enumerate(w)) + sum(moves[a, b] for a, b in zip(w, w[1:], strict=False)))
            assert tuple(names.viterbi(scores, moves)) == best


def test_held_out_layouts(spark, model):
    rows = letters.rendered(spark.range(-600, 0).toDF("doc_id"), letters.HELD_OUT).collect()
    assert all(r.text[n.start : n.end] in (r.a, r.b) for r in rows for n in r.names) and all(len(r.names) == 2 for r in rows)
    right, found, wanted, wrong = 0, 0, 0, []
    for r in rows:
        got = {(a, b) for _, a, b in model.find(r.text)}
        want = {(n.start, n.end) for n in r.names}
        right, found, wanted = right + len(got & want), found + len(got), wanted + len(want)
        if got != want:
            wrong.append((r.text, [r.text[a:b] for a, b in sorted(got ^ want)]))
    assert right / found >= 0.9 and right / wanted >= 0.9, (right / found, right / wanted, wrong[:12])


def test_reruns_agree(spark, sf_dir, model):
    again = letters.trained(spark, sf_dir)
    assert (again.weights == model.weights).all() and (again.moves == model.moves).all()


def test_payloads_with_names(spark, model):
    none = F.lit(None).cast(f"array<{analysis.ELEMENT}>")
    docs = spark.createDataFrame([("s", "financial_statement", "Corfen Holdel Ltd\nAnnual Report\nTotal Revenue: 5"), ("r", "rfp", "Request for Proposal\nIssued by Marros Inc.\nQuestions to the Office."), ("o", "other", "Minutes of Monday. Present: Stenver LLC, Junkel Oster. The end.")], "doc_id string, doc_type string, full_text string").withColumn("elements", none)
    got = {r.doc_id: json.loads(r.p) for r in analysis.analyse(docs, "2024-01-01", fuzzy=False, names=model.find).select("doc_id", F.to_json("payload").alias("p")).collect()}
    assert got["s"]["entity_name"] == "Corfen Holdel Ltd" and got["r"]["issuing_organisation"] == "Marros Inc."
    assert [e["name"] for e in got["o"]["key_entities"]] == ["Stenver LLC", "Junkel Oster"]
    found = docs.select("doc_id", classify.parties(F.col("full_text"), model.find).alias("p")).filter("doc_id = 'o'").first().p
    assert [p.name for p in found] == ["Stenver LLC", "Junkel Oster"]


def test_no_text(model):
    assert model.find(None) == model.find("") == model.find("\n \n") == []


def test_texts_are_dealt_out_and_placed_late(spark, sf_dir, model):
    """Names were placed in every text that could be fitted, and all held-out texts were one task's."""
    found = letters.party_names(spark, sf_dir)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    every = letters.rendered(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS doc_id"), letters.LAYOUTS)
    early = names.train(every.select("text", "names"))
    assert (early.weights == model.weights).all() and (early.moves == model.moves).all()
