"""1. Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass of map-side counts and a sum per (language, bucket); the log-probability matrix
(languages x 2**BITS, at most MAX_LANGS languages) is broadcast, and batches are scored as sparse rows in numpy.

Defined results: null text, or text without any letter, gives `und` and score 0; so does everything when there is no
labelled row to learn from. Rows with a null label are not learnt from. Repeated rows are judged alike. Columns of the
input whose names clash with results are not read. A document of any length is read whole, in pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.common import prefixed, read, tidy

#: Lengths of the n-grams, in code points, over lower-cased text in which all that isn't a letter is one space.
ORDERS = (1, 2, 3)
#: The n-grams are hashed to 2**BITS buckets.
BITS = 15
#: Laplace's alpha.
ALPHA = 0.5
#: Evidence of more n-grams than this is scaled down to it, so that scores of long texts aren't all 1.
EVIDENCE = 60
#: A classifier of more languages is refused, as its matrix is collected and broadcast.
MAX_LANGS = 500
#: Code points that are hashed at a time.
PIECE = 1 << 20
UNKNOWN = "und"


def _letters(text: str) -> np.ndarray:
    """Code points, lower-cased, with one space (32) before, after and in place of whatever isn't a letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = (a >= 97) & (a <= 122) | (a >= 0xC0)
    keep &= (a != 0xD7) & (a != 0xF7) & ~((a >= 0x2000) & (a <= 0x206F)) & ~((a >= 0x3000) & (a <= 0x303F))
    a = np.where(keep, a, np.uint32(32))
    first = np.empty(len(a), bool)
    first[:1], first[1:] = True, keep[:-1]
    a = a[keep | first]
    return np.concatenate([np.uint32([32]), a, np.uint32([32])])


def _pieces(texts):
    """Lists of (row, code points, ends there) of about PIECE code points; a long text gives several, which overlap by an n-gram less one."""
    held, size = [], 0
    for row, text in enumerate(texts):
        if text is None or not any(map(str.isalpha, text)):
            continue
        codes = _letters(text)
        for at in range(0, len(codes), PIECE):
            piece = codes[at : at + PIECE + max(ORDERS) - 1]
            held.append((row, piece, at + PIECE >= len(codes)))
            size += len(piece)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _sparse(held):
    """For each order, the bucket of each n-gram that lies in one document's piece and its row, as a sparse matrix of ones.

    A piece that goes on in the next one stops where the next one starts.
    """
    codes = np.concatenate([c for _, c, _ in held]).astype(np.uint64)
    sizes = np.array([len(c) for _, c, _ in held])
    ends = np.cumsum(sizes)
    rows = np.repeat(np.array([r for r, _, _ in held], np.int32), sizes)
    inside = np.ones(len(codes), bool)
    for (_, c, last), end in zip(held, ends, strict=True):
        if not last:
            inside[end - len(c) + PIECE : end] = False
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        with np.errstate(over="ignore"):
            h = ((h[: len(codes) - n + 1] ^ codes[n - 1 :]) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        if n > 1:
            inside[ends - n + 1] = False
        if n in ORDERS:
            at = inside[: len(h)]
            yield (h[at] & np.uint64((1 << BITS) - 1)).astype(np.int32), rows[: len(h)][at]


def counts(labelled: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows with a label: n-grams of a language in a bucket, counted per task before the shuffle."""

    def count(batches):
        tidy()
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            langs, codes = np.unique(pdf["lang"].to_numpy(str), return_inverse=True)
            for held in _pieces(pdf["text"]):
                for b, rows in _sparse(held):
                    n = np.bincount((codes[rows] << BITS) + b, minlength=len(langs) << BITS).reshape(len(langs), -1)
                    for lang, own in zip(langs.tolist(), n, strict=True):
                        total[lang] = total.get(lang, 0) + own
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang"))
    return rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities: languages x buckets). Only the bounded matrix of counts reaches the driver."""
    if labelled.filter(F.col(label).isNotNull()).select(label).distinct().limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    found = counts(labelled, text, label).toPandas()
    langs = sorted(found["lang"].unique())
    n = np.zeros((len(langs), 1 << BITS))
    n[np.searchsorted(langs, found["lang"].to_numpy(str)) if langs else [], found["bucket"]] = found["n"]
    n += ALPHA
    return langs, np.log(n / n.sum(axis=1, keepdims=True)) if langs else n


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (0 to 1: the posterior of that language, long texts' evidence scaled to EVIDENCE n-grams)."""
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(keep).schema.add("lang_pred", "string").add("score", "double")

    def score(batches):
        tidy()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            total, grams = np.zeros((len(texts), len(langs))), np.zeros(len(texts), np.int64)
            for held in _pieces(texts) if langs else ():
                for b, rows in _sparse(held):
                    if len(b):
                        grams += np.bincount(rows, minlength=len(texts))
                        first = np.flatnonzero(np.diff(rows, prepend=-1))
                        for k, own in enumerate(shared.value):
                            total[rows[first], k] += np.add.reduceat(own[b], first)
            if langs:
                z = total * np.minimum(1, EVIDENCE / np.maximum(grams, 1))[:, None]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                name = np.where(grams > 0, np.array(langs, object)[best], UNKNOWN)
                prob = np.where(grams > 0, z[np.arange(len(best)), best], 0.0)
            else:
                name, prob = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(name, pa.string()), pa.array(prob, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(keep).mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that is not learnt from (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: The pipeline drops documents whose language is unknown or less likely than this.
LEAST_SCORE = 0.5


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learns from the documents' own labels. Null text, and text without a letter, goes;
    repeated rows, those of one id or of a null id among them, are judged each by its text; all columns stay."""
    found = predict(prefixed(docs), fit(docs.select("text", "lang")), "__in_text")
    rows = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return rows.select(*(F.col(f"__in_{c}").alias(c) for c in docs.columns))
