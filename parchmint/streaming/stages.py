"""Stage events and uploads as streams. State is one row per client and stage or per client; late rows only replace older ones."""

from __future__ import annotations

from mimetypes import MimeTypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions.fields import new_id
from parchmint.operators.documents import stage_fold
from parchmint.dims import STAGES

EVENTS = "client_id string, seq long, ts timestamp, stage string, status string, detail string, data string, error string, duration double"
POLL = "3 seconds"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of events written as JSON lines under path."""
    return spark.readStream.schema(EVENTS).json(path)


def emit(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream of events to a table, once each; the query is given back."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def fold(events: DataFrame) -> DataFrame:
    """Last status and detail of a client's stage; as a stream in update mode it gives each row that changed."""
    return stage_fold(events)


def progress(events: DataFrame) -> DataFrame:
    """(client_id, stages, document_status): one stateful aggregation per client, then the catch-up rule within the row.

    Earlier stages than the latest reached are complete. A document is complete with its risk stage, failed with an error.
    """
    order = F.struct("ts", "seq")
    folded = events.groupBy("client_id").agg(*(F.max_by(F.when(F.col("stage") == s, F.col("status")), F.when(F.col("stage") == s, order)).alias(s) for s in STAGES))
    at = [F.when(F.col(s).isNotNull(), F.lit(i)) for i, s in enumerate(STAGES)]
    top = F.coalesce(F.greatest(*at), F.lit(-1))
    mended = [F.when((F.lit(i) < top) & F.coalesce(F.col(s), F.lit("pending")).isin("pending", "running"), "complete").otherwise(F.coalesce(F.col(s), F.lit("pending"))) for i, s in enumerate(STAGES)]
    rows = folded.select("client_id", F.struct(*(m.alias(s) for m, s in zip(mended, STAGES))).alias("stages"))
    failed = F.array_contains(F.array(*(F.col("stages")[s] for s in STAGES)), "error")
    return rows.withColumn("document_status", F.when(failed, "failed").when(F.col("stages.risk") == "complete", "completed").otherwise("processing"))


def route(path: Column) -> Column:
    """The format by a file's extension, or by the type that is guessed from it; null for what can't be read."""
    ext, types = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), MimeTypes().types_map[True]
    images = sorted({".png", ".jpg", ".jpeg", *(e for e, t in types.items() if t.startswith("image/"))})
    sheets = sorted({".xlsx", ".xls", *(e for e, t in types.items() if "spreadsheetml" in t)})
    return F.when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").when(ext.isin(*sheets), "excel").when(ext.isin(*images), "image")


def register(files: DataFrame, project_id: str) -> DataFrame:
    """Rows of documents for files (path, modificationTime, content): hash, format, processing and pending; unreadable formats fail."""
    rows = files.withColumn("content_hash", F.sha2("content", 256)).withColumn("format", route(F.col("path")))
    return rows.select(
        new_id("doc_", "content_hash", "path").alias("id"), F.lit(project_id).alias("project_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("path").alias("file_url"),
        "content_hash", "format", F.when(F.col("format").isNull(), "failed").otherwise("processing").alias("status"), F.lit("pending").alias("crm_status"), F.col("modificationTime").alias("created_at"),
    )


def uploads(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """New files under path as a stream of documents."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return register(files, project_id)
