"""5. Document fingerprints: MinHash signatures in vectorised numpy; bands of them are joined in Spark and Jaccard is verified.

A document's set is its 5-word shingles (words: runs of bytes outside 0x20, 0x09-0x0D; A-Z lower-cased; a document of
1 to 4 words has one shingle, of all of them). PERMUTATIONS universal hashes a*x+b of the shingles' hashes are taken, and
16 bits of each one's minimum make the fingerprint. Likeness of two fingerprints is the share of equal minima.

Defined results: a text without words (null, empty, white space) has the fingerprint of all ones bits; two such are alike (1.0).
Rows of one doc_id stand one after the other, by the hash of their text; a null doc_id comes first. The only document of a
table is its own next. Other columns of the input are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.common import MASK, bucket_cells, checkpointed, chunks, partitions, read, shingle_hashes, text_buffers, tidy, word_hashes
from parchmint.llm.components import components
from parchmint.llm.jaccard import CELL, sets, tied

WORDS = 5
PERMUTATIONS = 128
#: Bands of the signature; documents that agree in all rows of a band are candidates. At Jaccard 0.8 a pair of 32 bands of 4
#: permutations is one with probability 1 - (1 - 0.8 ** 4) ** 32 = 1 - 5e-8.
BANDS = 32
#: Near copies, in per cent of Jaccard's likeness.
SIMILARITY = 80
SEED = 20240229
#: Shingles that are permuted at a time (in the processor's cache).
AT_ONCE = 1 << 16


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of n universal hashes."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, MASK, n, np.uint64, endpoint=True) | np.uint64(1), rng.integers(0, MASK, n, np.uint64, endpoint=True)


def signatures(buf: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> np.ndarray:
    """PERMUTATIONS x 16 bits for each row of text."""
    a, b = permutations()
    out = np.full((len(offsets) - 1, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    for first, last in chunks(offsets):
        h, bounds = shingle_hashes(*word_hashes(buf, offsets[first : last + 1]), k)
        x = h >> np.uint64(32)
        for i, j in chunks(bounds, AT_ONCE):
            for lo in range(bounds[i], bounds[j], 4 * AT_ONCE):
                hi = min(bounds[j], lo + 4 * AT_ONCE)
                rows = np.flatnonzero((bounds[i + 1 : j + 1] > lo) & (bounds[i:j] < hi) & (bounds[i + 1 : j + 1] > bounds[i:j])) + i
                starts, part = np.maximum(bounds[rows] - lo, 0), x[lo:hi]
                buffer = np.empty(len(part), np.uint64)
                with np.errstate(over="ignore"):
                    for p in range(PERMUTATIONS):
                        np.multiply(part, a[p], out=buffer)
                        np.add(buffer, b[p], out=buffer)
                        least = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
                        out[first + rows, p] = np.minimum(out[first + rows, p], least.astype(np.uint32))
    return (out & 0xFFFF).astype(np.uint16)


def fingerprints(sig: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sig.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _texts(values) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(pa.array(values, pa.large_string()))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (bucket, extra, doc_id, text): ranges of doc_id, each with its first successor as an extra row.

    One shuffle of the texts. The ranges' bounds (quantiles of doc_id, as many as shuffle partitions) and each range's first
    row's id are all that reaches the driver.
    """
    n = partitions(docs.sparkSession)
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(d.alias("d"))
    cuts = ids.agg(F.percentile_approx("d", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def bucket(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), side="right").astype(np.int32))

    firsts = ids.withColumn("b", bucket("d")).groupBy("b").agg(F.min("d").alias("d")).orderBy("b").collect()
    filled = [r["b"] for r in firsts]
    before = {r["d"]: filled[k - 1] for k, r in enumerate(firsts)}

    @F.pandas_udf("array<struct<bucket: int, extra: int>>")
    def targets(x: pd.Series) -> pd.Series:
        ids = x.to_numpy()
        own = np.searchsorted(cuts, ids, side="right")
        return pd.Series([[{"bucket": int(b), "extra": 0}] + ([{"bucket": before[i], "extra": 1}] if i in before else []) for i, b in zip(ids.tolist(), own.tolist(), strict=True)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), d.alias("d"), F.explode(targets(d)).alias("to"))
    rows = rows.select("to.bucket", "to.extra", "d", "doc_id", "text")
    return rows.repartitionByRange(max(1, n), "bucket").sortWithinPartitions("bucket", "extra", "d", F.xxhash64("text")).select("bucket", "extra", "doc_id", "text")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the next one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def _compared(batches):
    """Streams ranges in order; the last document of a range is judged with the extra row that follows it."""
    tidy()
    held = None  # bucket, doc_id, text, signature of the document whose successor isn't seen yet
    for batch in batches:
        for lo, hi in chunks(text_buffers(batch.column(3))[1]):
            part = batch.slice(lo, hi - lo)
            buckets, extra, ids, texts = (part.column(i).to_pylist() for i in range(4))
            texts = [t or "" for t in texts]
            sig = signatures(*_texts(texts))
            if held is not None:
                buckets, extra, ids, texts, sig = [held[0], *buckets], [0, *extra], [held[1], *ids], [held[2], *texts], np.concatenate([held[3], sig])
            at = [i for i in range(len(ids) - 1) if not extra[i] and buckets[i + 1] == buckets[i]]
            held = None if extra[-1] else (buckets[-1], ids[-1], texts[-1], sig[-1:])
            if at:
                new = [edited(texts[i], texts[i + 1]) for i in at]
                own, after, changed = sig[at], sig[[i + 1 for i in at]], signatures(*_texts(new))
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in new]
                columns = [[ids[i] for i in at], [len(texts[i]) for i in at], digests, fingerprints(own), fingerprints(changed), likeness(own, changed), likeness(own, after)]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(read(spark, sf_dir, "documents")).mapInArrow(_compared, _SCHEMA)


def signed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, body, fingerprint, bands: array of long) of each row that has an id and a word; no shuffle."""

    def made(batches):
        tidy()
        for batch in batches:
            buf, offsets = text_buffers(batch.column(1))
            sig = signatures(buf, offsets)
            has = (sig != 0xFFFF).any(axis=1)
            wide = np.ascontiguousarray(sig.reshape(len(sig), BANDS, -1)).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.zeros(wide.shape[:2], np.uint64)
                for j in range(wide.shape[2]):
                    key = (key ^ wide[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                key += np.arange(BANDS, dtype=np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array(fingerprints(sig)), pa.array([r.astype(np.int64) for r in key.view(np.int64)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(has)) for c in columns], ["doc_id", "body", "fingerprint", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(made, "doc_id long, body string, fingerprint string, bands array<long>")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = SIMILARITY, cell: int = CELL) -> DataFrame:
    """(doc_id, component_id), a row per row of `docs`: near copies, by bands, whose Jaccard is `percent` % or more share a component.

    Rows of one doc_id and different texts are one document for links; a null doc_id has a null component.
    Rows of one fingerprint and body are one class first, so that copies of a text are never compared. The classes that agree in
    a band are a bucket, in which true sets of shingles decide (searched by the triangle inequality); only ties to one
    member are emitted, never pairs, and the ties' components are found by joins. A bucket of any size is dealt out in chunks.
    """
    rows = signed(docs, text, doc_id).withColumn("body_hash", F.xxhash64("body"))
    named = rows.groupBy("fingerprint", "body_hash").agg(F.min("doc_id").alias("id"), F.first("body").alias("body"), F.first("bands").alias("bands"))
    # A class has a number of its own, as one doc_id may have rows of several.
    classes = checkpointed(named.withColumn("rep", F.monotonically_increasing_id()))
    cells = bucket_cells(classes.select("rep", F.posexplode("bands").alias("pos", "key")), cell)
    wanted = classes.join(cells.select("rep").distinct(), "rep", "left_semi").select("rep", "body")

    def points(batches):
        tidy()
        for batch in batches:
            payload = [p.tobytes() for p in sets(*text_buffers(batch.column(1)), WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(payload, pa.binary())], ["doc_id", "points"])

    bodies = wanted.mapInArrow(points, "doc_id long, points binary")
    found = cells.select(F.col("key").alias("cell"), "a", "b", F.col("rep").alias("doc_id")).join(bodies, "doc_id")
    links = tied(found.select("cell", "a", "b", "doc_id", "points"), percent)
    ids = classes.select("rep", "id")
    ties = links.join(ids.toDF("u", "x"), "u").join(ids.toDF("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    members = rows.select("doc_id", "fingerprint", "body_hash").join(classes.select("fingerprint", "body_hash", "id"), ["fingerprint", "body_hash"])
    components_ = components(ties.union(members.select(F.col("doc_id").alias("u"), F.col("id").alias("v")))).toDF("doc_id", "component")
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id")).join(components_, "doc_id", "left")
    return every.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of bands with Jaccard verified, over all documents: what the fingerprints of op5 are for."""
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLE_NEAR_COPIES = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT u, v FROM common c JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT d.doc_id, least(d.doc_id, coalesce(min(r.v), d.doc_id)) AS component_id FROM documents d LEFT JOIN reach r ON r.u = d.doc_id GROUP BY d.doc_id"""
