"""The encoder's factors against numpy's, and what has no factors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmint.operators import classify, encoder

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    topics = [rng.dirichlet(np.ones(len(WORDS)) * 0.3) for _ in range(3)]
    rows = [(i, " ".join(rng.choice(WORDS, 12, p=topics[i % 3]))) for i in range(40)] + [(40, "Alpha, ALPHA 12 onlyhere"), (41, ""), (42, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, full_text string")


def dense(rows):
    """The weighted matrix in numpy: documents x words, rows of length 1."""
    import re

    found = {i: re.findall(encoder.WORD, (t or "").lower()) for i, t in rows}
    docs = [i for i in found if found[i]]
    names = [w for w in sorted({w for ws in found.values() for w in ws}) if sum(w in ws for ws in found.values()) >= encoder.LEAST]
    idf = np.array([np.log((1 + len(docs)) / (1 + sum(w in found[i] for i in docs))) for w in names])
    a = np.array([[np.log1p(found[i].count(w)) for w in names] for i in docs]) * idf
    length = np.linalg.norm(a, axis=1, keepdims=True)
    return docs, names, np.divide(a, length, where=length > 0, out=np.zeros_like(a))


def test_factors_equal_numpys(spark, corpus):
    rows, texts = corpus
    docs, names, a = dense(rows)
    rank = 3
    _, sizes, axes = np.linalg.svd(a, full_matrices=False)
    got = {r.word: r.v for r in encoder.fit(texts, rank=rank, rounds=4).collect()}
    assert sorted(got) == names
    v = np.array([got[w] for w in names])
    assert np.allclose(v.T @ v, np.eye(rank), atol=1e-6)
    # The same space, strongest first; a direction's sign is free.
    assert sizes[rank - 1] > sizes[rank] and np.allclose(np.abs(axes[:rank] @ v), np.eye(rank), atol=1e-3)


def test_vectors_of_texts(spark, corpus):
    _, texts = corpus
    factors = encoder.fit(texts, rank=4)
    got = {r.doc_id: np.array(r.embedding) for r in encoder.encode(texts, factors, rank=4).collect()}
    assert len(got) == 43 and all(abs(np.linalg.norm(v) - 1) < 1e-9 for i, v in got.items() if i < 41)
    assert not got[41].any() and not got[42].any()
    alike = spark.createDataFrame([(1, "alpha 12 alpha ALPHA other")], "doc_id long, full_text string")
    assert np.dot(encoder.encode(alike, factors, rank=4).first().embedding, got[40]) == pytest.approx(1)


def test_texts_without_known_words_are_other(spark):
    texts = spark.createDataFrame([(1, "zz qq"), (2, "invoice invoice payment bank"), (3, None)], "doc_id long, full_text string")
    kinds = {"invoice": ("please remit payment of the invoice by bank", "invoice payment"), "nda": ("keep information confidential", "confidential information"), "other": ("technical document", "general document")}
    got = {r.doc_id: r.document_type for r in classify.document_types(texts, kinds).collect()}
    assert got == {1: "other", 2: "invoice", 3: "other"}
    assert classify.document_types(texts, kinds, classify.hashed_encoder).filter(F.col("doc_id") == 2).first().document_type == "invoice"
