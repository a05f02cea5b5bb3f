"""6. Embedding near-dedup: Euclidean p-stable hashing of normalised vectors, then exact cosines.

TABLES tables each hash a vector by HASHES quantised random projections floor((a.x + b) / WIDTH), with its label, to a bucket.
Vectors of one bucket are compared by their cosine in double precision. Exact copies are one vector with a weight first. A
pair is counted in the first table in which it meets, so no pair is ever emitted: a bucket gives each member's number of links
and the ties to the smallest member of its part. A bucket of more than CELL members is dealt out as pairs of chunks, each of
which is compared in a task of its own; none is capped.

Two vectors with cosine 0.93 meet in some table with probability 0.9998, with 0.95 with 0.99998.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, with a null label or a null
vec_id, link with nothing (0 links, component of their own). Vectors of different lengths aren't compared. Labels of any type
are compared as they are. Repeated rows are vectors of their own. Other columns of the input are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.llm.common import bucket_cells, checkpointed, mix, partitions, read, runs, tidy
from parchmint.llm.components import components

TABLES = 26
HASHES = 7
WIDTH = 1.8
COSINE = 0.93
CELL = 2048
SEED = 7


def projections(dims: int, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + dims)
    return rng.standard_normal((dims, tables * HASHES)), rng.uniform(0, WIDTH, tables * HASHES)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(unit: np.ndarray, labels: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """64-bit keys, rows x tables."""
    a, b = projections(unit.shape[1], tables)
    # Row by row in a fixed order of summation, so that copies of a vector never differ.
    q = np.floor((np.einsum("ij,jk->ik", unit, a) + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, HASHES)
    with np.errstate(over="ignore"):
        h = mix(labels.astype(np.uint64) + np.uint64(unit.shape[1] << 32))[:, None] + mix(np.arange(1, tables + 1, dtype=np.uint64))
        for j in range(HASHES):
            h = (h ^ q[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def hashed(vectors: DataFrame, vector: str, label: str, vec_id: str, kind: str) -> DataFrame:
    """(vec_id, label, raw, keys): raw is the vector's components as numbers of `kind`, null (as keys) if it links with nothing."""

    def made(batches):
        tidy()
        for batch in batches:
            ids, own_labels, labels, lists = (batch.column(i) for i in range(4))
            n = batch.num_rows
            raw, keys = [None] * n, [None] * n
            flat = lists.flatten().cast(pa.float64())
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            values = flat.fill_null(float("nan")).to_numpy()
            usable = (sizes > 0) & labels.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            label_values = labels.fill_null(0).to_numpy()
            for dims in np.unique(sizes[usable]):
                rows = np.flatnonzero(usable & (sizes == dims))
                x = values[(bounds[rows][:, None] + np.arange(dims)).reshape(-1)].reshape(len(rows), dims)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                rows, x = rows[good], x[good]
                if len(rows):
                    for r, v, k in zip(rows, x + 0.0, bucket_keys(_unit(x), label_values[rows]), strict=True):
                        raw[r], keys[r] = v.astype(kind).tobytes(), k
            yield pa.RecordBatch.from_arrays([ids, own_labels, pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["vec_id", "label", "raw", "keys"])

    mark = F.when(F.col(label).isNotNull(), F.xxhash64(label))
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), mark.alias("mark"), F.col(vector).cast("array<double>").alias("vector"))
    return source.mapInArrow(made, T.StructType([*source.select("vec_id", "label").schema]).add("raw", "binary").add("keys", T.ArrayType(T.LongType())))


def _links(unit: np.ndarray, keys: np.ndarray, table: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(all links, those that no earlier table has) of a bucket, as matrices."""
    near = unit @ unit.T >= cosine - 1e-12
    np.fill_diagonal(near, False)
    for i, j in np.argwhere(near & (unit @ unit.T < cosine + 1e-12)):
        near[i, j] = float(np.dot(unit[min(i, j)], unit[max(i, j)])) >= cosine
    fresh = near.copy()
    for t in range(table):
        fresh &= keys[:, t][:, None] != keys[:, t][None, :]
    return near, fresh


def _tied(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row can reach."""
    lab = ids.copy()
    while True:
        new = np.minimum(lab, np.where(near, lab[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == lab).all():
            return lab
        lab = new


def compare(cells: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(rep, to, n) of each member of each cell: number of links first met there, and the smallest member it is tied to."""

    def made(batches):
        tidy()
        for table in runs(batches, ["key", "a", "b"]):
            ids, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
            chunk, at = table.column("chunk").to_numpy(), int(table.column("pos")[0].as_py())
            unit = _unit(np.frombuffer(b"".join(table.column("raw").to_pylist()), kind).astype(np.float64).reshape(len(ids), -1))
            keys = np.array(table.column("keys").combine_chunks().flatten(), np.int64).reshape(len(ids), at)
            a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
            near, fresh = _links(unit, keys, at, cosine)
            if a != b:  # pairs of two chunks; those within a chunk have their own cell
                fresh &= chunk[:, None] != chunk[None, :]
            n, to = fresh @ weight, _tied(near, ids)
            some = (n > 0) | (to != ids)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(to[some]), pa.array(n[some].astype(np.int64))], ["rep", "to", "n"])

    spread = cells.repartition(partitions(cells.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b", "rep")
    return spread.mapInArrow(made, "rep long, to long, n long")


def near_vectors(vectors: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of `vectors`."""
    kind = "<f4" if vectors.schema[vector].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector].dataType.containsNull) else "<f8"
    # Copies of a vector are dealt out by a salt, so that no task holds a large group.
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(partitions(vectors.sparkSession))).cast("int")
    rows = checkpointed(hashed(vectors, vector, label, vec_id, kind).withColumn("salt", salt))
    usable = rows.filter("raw IS NOT NULL")
    classes = usable.groupBy("label", "raw").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("keys").alias("keys"), F.collect_set("salt").alias("salts"))
    # A class has a number of its own, as one vec_id may have rows of several.
    classes = checkpointed(classes.withColumn("rep", F.monotonically_increasing_id()))
    dealt = bucket_cells(classes.select("rep", F.posexplode("keys").alias("pos", "key")), cell)
    found = checkpointed(compare(dealt.join(classes.select("rep", "weight", "raw", "keys"), "rep").withColumn("keys", F.slice("keys", F.lit(1), F.col("pos"))), cosine, kind))
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("rep").alias("u"), F.col("to").alias("v"))).toDF("rep", "part")
    least = parts.join(classes.select("rep", "id"), "rep").groupBy("part").agg(F.min("id").alias("component"))
    parts = parts.join(least, "part").select("rep", "component")
    named = classes.select("label", "raw", "rep", "id", "weight", "salts").join(linked, "rep", "left").join(parts, "rep", "left")
    named = named.select(F.col("label").alias("l"), F.col("raw").alias("r"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("c"), F.explode("salts").alias("s"))
    done = usable.join(named, (F.col("label") == F.col("l")) & (F.col("raw") == F.col("r")) & (F.col("salt") == F.col("s"))).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.filter("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
