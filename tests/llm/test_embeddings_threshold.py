"""Vectors of a cosine just above the threshold meet in some table."""

import numpy as np

from parchmint.llm import embeddings


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(1)
    a = embeddings._unit(rng.standard_normal((2000, 64)))
    b = rng.standard_normal((2000, 64))
    b = embeddings._unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = 0.9301 * a + np.sqrt(1 - 0.9301**2) * b
    labels = np.zeros(2000, np.int64)
    met = (embeddings.bucket_keys(a, labels) == embeddings.bucket_keys(c, labels)).any(axis=1)
    assert met.sum() >= 1996
