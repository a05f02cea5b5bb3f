"""A table of the last version of every key, kept by batches: buckets of keys, a batch rewrites only the buckets it touches.

    path/data/load=<n>/bucket=<b>/   rows of a bucket as of batch n
    path/versions/<n>/               which folder holds each bucket: one small table per committed batch, written last

A version counts from the moment that Spark's committer marks it done; until then readers see the one before. A batch that was
stopped halfway has no version: run again, it overwrites its own folder. A batch that is committed already is passed over. Reading
costs one folder per bucket whatever the number of batches. Folders and versions that no kept version names are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
#: Versions that are kept, for readers that began before a batch ended.
KEPT = 3


def _folder(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which any storage has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    store, at = _folder(spark, path)
    return [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, in order."""
    done = lambda n: (lambda store, at: store.exists(at))(*_folder(spark, f"{path}/versions/{n}/_SUCCESS"))
    return sorted(int(n) for n in _children(spark, f"{path}/versions") if n.isdigit() and done(n))


def _places(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """Bucket -> folder. There are at most as many as buckets."""
    return {r.bucket: r.folder for r in spark.read.schema("bucket int, folder string").json(f"{path}/versions/{version}").collect()}


def _read(spark: SparkSession, path: str, folders) -> DataFrame:
    return spark.read.option("mergeSchema", "true").option("basePath", f"{path}/data").parquet(*(f"{path}/data/{f}" for f in folders)).drop("load", "bucket")


def merge(batch: DataFrame, number: int, path: str, key: str = "content_hash", version: str = "created_at", buckets: int = BUCKETS) -> None:
    """Takes a batch's rows into the table; numbers grow, as those of a stream's batches do. Later batches win among equal versions.

    Columns that older rows don't have are null there.
    """
    spark = batch.sparkSession
    before = versions(spark, path)
    if before and before[-1] >= number:
        return
    places = _places(spark, path, before[-1]) if before else {}
    of = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = batch.withColumns({"batch": F.lit(number).cast("long"), "n_versions": F.lit(1).cast("long")}).persist()
    try:
        touched = [r.bucket for r in rows.select(of.alias("bucket")).distinct().collect()]
        both = rows
        if old := [places[b] for b in touched if b in places]:
            both = _read(spark, path, old).unionByName(rows, allowMissingColumns=True)
        others = [c for c in both.columns if c not in (key, "n_versions")]
        last = both.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(version, "batch")).alias("r"), F.sum("n_versions").alias("n_versions"))
        last.select(key, "r.*", "n_versions", of.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/load={number}")
    finally:
        rows.unpersist()
    places |= {b: f"load={number}/bucket={b}" for b in touched}
    table = spark.createDataFrame(sorted(places.items()), "bucket int, folder string")
    table.coalesce(1).write.mode("overwrite").json(f"{path}/versions/{number}")
    tidy(spark, path)


def tidy(spark: SparkSession, path: str, kept: int = KEPT) -> None:
    """Removes versions older than the last `kept`, and data that none of those names."""
    done = versions(spark, path)
    live = {folder for n in done[-kept:] for folder in _places(spark, path, n).values()}
    newest = done[-1] if done else -1
    for n in done[:-kept]:
        store, at = _folder(spark, f"{path}/versions/{n}")
        store.delete(at, True)
    for load in _children(spark, f"{path}/data"):
        number = load.removeprefix("load=")
        if not number.isdigit() or int(number) > newest:
            continue  # a batch that is being written
        for bucket in _children(spark, f"{path}/data/{load}"):
            if bucket.startswith("bucket=") and f"{load}/{bucket}" not in live:
                store, at = _folder(spark, f"{path}/data/{load}/{bucket}")
                store.delete(at, True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last committed batch: the last version of every key, with n_versions, how many it had."""
    done = versions(spark, path)
    if not done:
        raise FileNotFoundError(f"no version of a table under {path}")
    return _read(spark, path, _places(spark, path, done[-1]).values()).drop("batch")


def upsert(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, key: str = "content_hash", version: str = "created_at", buckets: int = BUCKETS):
    """Merges a stream's batches into the table under path; the query is given back.

    `trigger` defaults to what has arrived by now; {"processingTime": POLL} polls.
    """
    writer = rows.writeStream.foreachBatch(lambda batch, number: merge(batch, number, path, key, version, buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
