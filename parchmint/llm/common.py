"""Helpers that the operators share: Arrow text buffers, hashing in numpy, lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prefixed(docs: DataFrame) -> DataFrame:
    """`docs` with __in_ before each column's name, so that no extra column clashes with what an operator adds."""
    return docs.select(*(F.col(f"`{c}`").alias(f"__in_{c}") for c in docs.columns))


def numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Some columns in order, under names that can't clash: a function over batches names its own."""
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))


def restored(rows: DataFrame, docs: DataFrame, results: tuple[str, ...]) -> DataFrame:
    """The columns of `docs` (prefixed in `rows`) but for those named as a result, and the results, which `rows` has as __out_ and their name."""
    keep = (F.col(f"`__in_{c}`").alias(c) for c in docs.columns if c not in results)
    return rows.select(*keep, *(F.col(f"__out_{c}").alias(c) for c in results))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the folder of spark.checkpoint.dir, which survive lost executors.

    Only where that setting is absent (a local session) is a temporary folder taken.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def drop_unused(spark: SparkSession) -> None:
    """Lets Spark delete shuffles and checkpoints that nothing reads any more: it does so when the driver collects its garbage, which else may not happen in a whole job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path, named after `name`, where spark.checkpoint.dir is (a temporary one only in a local session without it)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bucket_cells(keyed: DataFrame, cell: int) -> DataFrame:
    """(key, pos, rep, chunk, a, b) of the buckets of more than one member; keyed: rep, pos (its table) and key, which tells tables apart.

    A bucket of the very members of an earlier table's has no new pairs and is passed over (members are compared by number and a
    hash of 128 bits). A bucket of more than `cell` members is dealt out as pairs of chunks a <= b, so that no task holds it whole.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "rep")).alias(f"x{seed}") for seed in (1, 2)]
    full = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("pos").alias("pos"), *marks).filter("m > 1")
    full = full.groupBy("m", "x1", "x2").agg(F.min_by("key", F.struct("pos", "key")).alias("key")).select("key", F.ceil(2 * F.col("m") / cell).cast("int").alias("halves"))
    full = full.withColumn("chunks", F.when(F.col("halves") > 2, F.col("halves")).otherwise(1)).drop("halves")
    dealt = keyed.join(full, "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.select("key", "pos", "rep", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))


def tidy() -> None:
    """Frees what earlier tasks of a reused Python worker left in reference cycles: their functions' code and tables."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges (first, last+1) of rows of about `size` bytes together; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over uint64 (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _table(base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(CHUNK_BYTES, base))])


_POWERS: list[np.ndarray] = []


def _sums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans that follow one another, in windows of CHUNK_BYTES: memory doesn't grow with the text."""
    if not _POWERS:
        _POWERS.extend((_table(_BASE), _table(_BASE_INV)))
    power, inverse = _POWERS
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(buf), CHUNK_BYTES):
            part = buf[lo : lo + CHUNK_BYTES]
            i, j = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(starts, lo + len(part)))
            if i >= j:
                continue
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
            first, last = np.maximum(starts[i:j] - lo, 0), np.minimum(ends[i:j] - lo, len(part))
            found = (sums[last] - sums[first]) * inverse[first]
            # A span that began in an earlier window goes on with the power that it had reached.
            if (done := lo - int(starts[i])) > 0:
                found[0] *= np.uint64(pow(int(_BASE), done, 1 << 64))
            out[i:j] += found
    return out


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes outside 0x20, 0x09-0x0D; A-Z lower-cased) of some rows.

    Returns the hashes of all rows in order and n+1 bounds: row i has words bounds[i]:bounds[i+1].
    """
    base, size = offsets[0], int(offsets[-1] - offsets[0])
    b, off = buf[base : base + size], offsets - base
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = ~_SPACE[b]
    before = np.empty(size, bool)
    before[0], before[1:] = False, word[:-1]
    before[off[:-1][off[:-1] < size]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, word[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    with np.errstate(over="ignore"):
        return mix(_sums(_LOWER[b], starts, ends) + (ends - starts).astype(np.uint64)), np.searchsorted(starts, off)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, with bounds; a row of 1 to k-1 words has one shingle, of all of them."""
    n_words = np.diff(bounds)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    left = np.repeat(bounds[1:], n) - first
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    h = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            w = padded[first + j] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 3) * (j + 7)) & MASK | 1)
            h += np.where(left > j, mix(w), np.uint64(j + 1))
        return mix(h), out_bounds


def span_hashes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive byte spans."""
    with np.errstate(over="ignore"):
        return mix(_sums(buf, offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lengths[i]-1 of all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def runs(batches, keys: list[str]):
    """Tables of the rows of one key each, from record batches in order of the keys. A run is held until it ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for i, start in enumerate(starts):
            stop = starts[i + 1] if i + 1 < len(starts) else batch.num_rows
            held.append(batch.slice(start, stop - start))
            if i + 1 < len(starts):
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
