"""11. WARC archives: an index of offset, length, URL and digest per record first, then coalesced reads of sorted byte ranges.

Writing: a task writes its rows as records, each a gzip member of its own, into archives of about ARCHIVE bytes in a folder that
driver and executors share, and returns a row of index per record; the index is a table beside them, written by Spark's committer. A
task that runs again writes archives of other names, and only the rows of the attempt that was committed are in the index, so
nothing ever points into a file that a lost executor left behind.

Of payloads that are alike and have at least LEAST bytes, the record with the smallest page_id is a response, others are revisits
of it without a payload of their own. What repeats is found by one aggregate over digests. Rows of repeated payloads are told by a
join: the aggregate is broadcast if it has at most BROADCAST rows (counted), else it is given back by salt, so that a payload of a third of all
pages is never in one task.

Reading: the selected rows of the index go by blocks of BLOCK bytes of an archive, in order of offset; ranges at most GAP bytes apart
are one read of at most READ bytes. Each record is unpacked, parsed and checked against its digest; a revisit's
length is that of the response it names.

Defined results: null html is an empty payload, a null url an empty URI. Among alike payloads rows without a page_id revisit the smallest
page_id; if none has one, all are responses. Rows that repeat the smallest page_id and its payload are responses too. Very long pages are one
record. Other columns are passed over. An empty table gives an empty index and result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.common import checkpointed, partitions, read, shared_folder, tidy

LEAST = 100
ARCHIVE, BLOCK = 1 << 30, 1 << 26
GAP, READ = 1 << 16, 1 << 23
#: Rows of repeated payloads (some 60 bytes each) that are broadcast at most.
BROADCAST = 100_000
DATE = "2026-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file: with or without slashes) and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def record_bytes(page_id: int | None, url: str, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    """A record of version 1.1, with a payload or, as revisit, without."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}"}
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "text/html", "Content-Length": str(len(payload))}
    lines = "".join(f"{k}: {_folded(v)}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + payload + b"\r\n\r\n"


def _folded(value: str) -> str:
    """A header's value in one line: a backslash, carriage return and line feed as escapes."""
    return value.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def _unfolded(value: str) -> str:
    out, parts = [], iter(value)
    for c in parts:
        out.append({"r": "\r", "n": "\n"}.get(d := next(parts, ""), d) if c == "\\" else c)
    return "".join(out)


def parsed(record: bytes) -> dict:
    """A record's fields; ValueError if its length or digest is wrong."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not a whole record: {fields.get('WARC-Record-ID')}")
    page, kind, digest = (fields[k] for k in ("WARC-Record-ID", "WARC-Type", "WARC-Payload-Digest"))
    number = lambda urn: None if urn == "<urn:page:None>" else int(urn[10:-1])
    payload, digest = rest[:size], digest.removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {page} isn't what its digest says")
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": number(page), "url": _unfolded(fields["WARC-Target-URI"]), "record_type": kind, "refers_to": refers, "digest": digest, "payload": None if kind == "revisit" else payload}


def classed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    n = partitions(pages.sparkSession)
    salt = F.pmod(F.xxhash64("page_id"), F.lit(n)).cast("int")
    light = rows.filter(F.octet_length("payload") >= LEAST).select("page_id", F.unhex("digest").alias("d"), salt.alias("salt"))
    often = light.groupBy("d").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"), F.collect_set("salt").alias("salts")).filter("n > 1 AND first_id IS NOT NULL").drop("n")
    folder = shared_folder(pages.sparkSession, "repeated")
    often.write.parquet(folder)
    often = pages.sparkSession.read.parquet(folder)
    if often.count() <= BROADCAST:
        met = rows.join(F.broadcast(often.drop("salts")), F.unhex("digest") == F.col("d"), "left")
    else:
        met = rows.withColumn("salt", salt).join(often.withColumn("salt2", F.explode("salts")), (F.unhex("digest") == F.col("d")) & (F.col("salt") == F.col("salt2")), "left")
    refers_to = F.when(F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull()), F.col("first_id"))
    return met.select("page_id", "url", F.when(refers_to.isNull(), F.col("payload")).alias("payload"), "digest", refers_to.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Writes rows as `classed` gives them to folder/archives and their index to folder/index; gives the index."""
    store, path = opened(f"{folder}/archives")
    store.create_dir(path, recursive=True)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        own, base = opened(f"{folder}/archives")
        name, out, at = None, None, 0
        try:
            for batch in batches:
                index = {k: [] for k in ("archive", "offset", "length", "record_type")}
                columns = [batch.column(i) for i in range(5)]
                for page_id, url, payload, digest, refers_to in zip(*columns, strict=True):
                    if out is None or at >= archive:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid4().hex}.warc.gz", 0
                        out = own.open_output_stream(f"{base}/{name}", compression=None)
                    kind = "revisit" if refers_to.is_valid else "response"
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    record = record_bytes(page_id.as_py(), url.as_py(), kind, refers_to.as_py(), digest.as_py(), payload.as_py() or b"")
                    member = pack.compress(record) + pack.flush()
                    out.write(member)
                    for key, value in zip(index, (name, at, len(member), kind), strict=True):
                        index[key].append(value)
                    at += len(member)
                longs = [pa.array(index[k], pa.int64()) for k in ("offset", "length")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index["archive"], pa.string()), *longs, columns[0], columns[1], columns[3], pa.array(index["record_type"], pa.string()), columns[4]],
                    ["archive", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to"],
                )
        finally:
            if out is not None:
                out.close()

    rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(made, INDEX).write.parquet(f"{folder}/index")
    return rows.sparkSession.read.parquet(f"{folder}/index")


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int, int]]:
    """(offset, length, first, last + 1) of reads that cover sorted records: neighbours at most `gap` apart, `most` bytes at a time."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(zip(offsets, lengths, strict=True)):
        if out:
            start, size, first, _ = out[-1]
            if offset - (start + size) <= gap and offset + length - start <= most:
                out[-1] = (start, max(size, offset + length - start), first, i + 1)
                continue
        out.append((offset, length, i, i + 1))
    return out


def read_records(selected: DataFrame, folder: str, gap: int = GAP, most: int = READ) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, payload) of the rows of an index that are wanted; a revisit's payload is null."""
    n = partitions(selected.sparkSession)
    # By block of an archive: one archive is read by many tasks, each with neighbouring records.
    placed = selected.select("archive", "offset", "length").repartition(n, "archive", F.expr(f"offset div {BLOCK}")).sortWithinPartitions("archive", "offset")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        own, base = opened(f"{folder}/archives")
        name, file = None, None
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            archives, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(archives):
                j = i
                while j < len(archives) and archives[j] == archives[i]:
                    j += 1
                if archives[i] != name:
                    if file is not None:
                        file.close()
                    name, file = archives[i], own.open_input_file(f"{base}/{archives[i]}")
                for start, size, first, last in ranges(offsets[i:j], lengths[i:j], gap, most):
                    file.seek(start)
                    data = memoryview(file.read(size))
                    found = [parsed(zlib.decompress(data[offsets[i + k] - start : offsets[i + k] - start + lengths[i + k]], 31)) for k in range(first, last)]
                    yield pa.RecordBatch.from_pylist(found, schema)
                i = j
        if file is not None:
            file.close()

    return placed.mapInArrow(made, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with payload_bytes: a revisit's is that of the response with its digest."""
    n = partitions(records.sparkSession)
    salt = F.pmod(F.xxhash64("page_id"), F.lit(n)).cast("int")
    # What was read is needed twice; without the payloads it is small.
    rows = checkpointed(records.select("page_id", "url", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("own"), salt.alias("salt")))
    # One aggregate: what a digest's response has, and where its revisits are.
    known = rows.groupBy("digest").agg(F.max("own").alias("payload_bytes"), F.collect_set(F.when(F.col("record_type") == "revisit", F.col("salt"))).alias("salts"))
    known = known.filter(F.size("salts") > 0).select(F.col("digest").alias("d"), "payload_bytes", F.explode("salts").alias("s"))
    # Responses need no partner; their salt is none that the other side has.
    at = F.when(F.col("record_type") == "revisit", F.col("salt")).otherwise(-1 - F.col("salt"))
    met = rows.withColumn("at", at).join(known, (F.col("digest") == F.col("d")) & (F.col("at") == F.col("s")), "left")
    return met.select("page_id", "url", "record_type", "refers_to", "digest", F.coalesce("own", "payload_bytes").alias("payload_bytes"))


def archived(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """The index of archives of all pages, and their folder (a new one in the shared folder by default)."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return write_archives(classed(pages, page_id, url, html), folder), folder


def select_urls(index: DataFrame, wanted: Column) -> DataFrame:
    """Rows of the index that are wanted, with the responses of wanted revisits."""
    chosen = index.filter(wanted)
    needed = chosen.filter("record_type = 'revisit'").select("digest").distinct()
    more = index.filter("record_type = 'response'").filter(~F.coalesce(wanted, F.lit(False))).join(needed, "digest", "left_semi")
    return chosen.unionByName(more.select(*index.columns))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = archived(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = resolved(read_records(index, folder))
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE_OP11 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f
"""
