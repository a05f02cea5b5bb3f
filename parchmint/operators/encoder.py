"""Vectors of texts from the texts themselves: a truncated SVD of the weighted word-document matrix.

The matrix stays a table (doc_id, word, weight). A random projection of it is sharpened by power iterations, products with the
matrix and its transpose as joins and sums, with the columns made orthonormal between them; only Gram matrices of a few dozen
columns reach the driver. What is left is a table of words with their factors, which encodes any text by one join and one sum.

Defined results: words are runs of three letters a-z or more; words of fewer than LEAST documents, and texts without other words,
have no factors: the vector of such a text is all zero. Null text has no words. Rows of one doc_id are one text.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[a-z]{3,}"
RANK, EXTRA, ROUNDS, LEAST = 24, 8, 2, 2
#: Words whose factors are broadcast at most (some 300 bytes each); of more, both sides are shuffled.
BROADCAST = 100_000


def counts(texts: DataFrame, text: str = "full_text", chars: int | None = None) -> DataFrame:
    """(doc_id, word, n)"""
    body = F.lower(F.substring(text, 1, chars) if chars else F.col(text))
    return texts.select("doc_id", F.explode(F.regexp_extract_all(body, F.lit(WORD), F.lit(0))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def _damped(n: Column) -> Column:
    return F.log1p(n.cast("double"))


def weighted(found: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((doc_id, word, w) with rows of length 1, (word, idf))"""
    docs = found.select("doc_id").distinct().count()
    idf = found.groupBy("word").agg(F.count("*").alias("df")).filter(F.col("df") >= least).select("word", F.log(F.lit(1.0 + docs) / (1 + F.col("df"))).alias("idf"))
    rows = found.join(idf, "word").select("doc_id", "word", (_damped(F.col("n")) * F.col("idf")).alias("w"))
    norms = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms.filter("norm > 0"), "doc_id").select("doc_id", "word", (F.col("w") / F.col("norm")).alias("w")), idf


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST else table


def _product(matrix: DataFrame, vectors: DataFrame, by: str, to: str, width: int) -> DataFrame:
    """(to, v): the matrix, or its transpose, times vectors (by, v); sums are partial before they are shuffled."""
    met = matrix.join(_small(vectors), by)
    return met.groupBy(to).agg(*(F.sum(F.col("w") * F.col("v")[i]).alias(f"s{i}") for i in range(width))).select(to, F.array(*(f"s{i}" for i in range(width))).alias("v"))


def gram(vectors: DataFrame, width: int) -> np.ndarray:
    """The inner products of the columns of vectors (., v)."""

    def made(batches):
        total = np.zeros((width, width))
        for batch in batches:
            v = np.array(batch["v"].to_list(), dtype=float).reshape(-1, width)
            total += v.T @ v
        yield pd.DataFrame({"at": np.arange(width * width), "x": total.reshape(-1)})

    sums = vectors.select("v").mapInPandas(made, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for r in sums:
        out[r["at"]] = r["x"]
    return out.reshape(width, width)


def _turned(vectors: DataFrame, turn: np.ndarray) -> DataFrame:
    """vectors times a small matrix."""
    table = F.from_json(F.lit(json.dumps(turn.T.tolist())), "array<array<double>>")
    key = next(c for c in vectors.columns if c != "v")
    dot = lambda column: F.aggregate(F.zip_with("v", column, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(key, F.transform(table, dot).alias("v"))


def _orthonormal(vectors: DataFrame, width: int) -> DataFrame:
    """The same space with columns of length 1, at right angles; directions without any length become zero."""
    values, axes = np.linalg.eigh(gram(vectors, width))
    scale = np.where(values > max(values.max(), 1e-300) * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return _turned(vectors, axes * scale)


def fit(texts: DataFrame, text: str = "full_text", rank: int = RANK, chars: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(word, idf, v): the factors of each word, `rank` numbers, the strongest first. Rereads its own intermediate tables: they are kept."""
    width = rank + EXTRA
    found = counts(texts, text, chars).persist()
    matrix, idf = weighted(found)
    matrix = matrix.persist()
    sign = lambda i: F.when(F.xxhash64(F.lit(i), "word") % 2 == 0, 1.0).otherwise(-1.0)
    docs = matrix.groupBy("doc_id").agg(*(F.sum(F.col("w") * sign(i)).alias(f"s{i}") for i in range(width))).select("doc_id", F.array(*(f"s{i}" for i in range(width))).alias("v"))
    for _ in range(rounds):
        docs = docs.persist()
        words = _product(matrix, _orthonormal(docs, width), "doc_id", "word", width).persist()
        docs = _product(matrix, _orthonormal(words, width), "word", "doc_id", width)
    docs = docs.persist()
    words = _product(matrix, _orthonormal(docs, width), "doc_id", "word", width).persist()
    values, axes = np.linalg.eigh(gram(words, width))
    first = np.argsort(-values)[:rank]
    scale = np.where(values[first] > max(values.max(), 1e-300) * 1e-12, 1 / np.sqrt(np.maximum(values[first], 1e-300)), 0.0)
    return _turned(words, axes[:, first] * scale).join(idf, "word").select("word", "idf", "v")


def encode(texts: DataFrame, factors: DataFrame, rank: int = RANK, text: str = "full_text", chars: int | None = None) -> DataFrame:
    """(doc_id, embedding): vectors of length 1 (or all zero) of all texts."""
    found = counts(texts, text, chars).join(_small(factors), "word").withColumn("w", _damped(F.col("n")) * F.col("idf"))
    sums = found.groupBy("doc_id").agg(*(F.sum(F.col("w") * F.col("v")[i]).alias(f"s{i}") for i in range(rank))).select("doc_id", F.array(*(f"s{i}" for i in range(rank))).alias("v"))
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    whole = texts.select("doc_id").distinct().join(sums, "doc_id", "left").withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0), rank)))
    return whole.select("doc_id", F.transform("v", lambda x: x / norm).alias("embedding"))
