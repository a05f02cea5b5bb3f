"""3. Byte-level BPE encoding and decoding by a shuffle of distinct words.

The JVM splits each text into pre-tokens. A task numbers the distinct words of a block of documents (up to BLOCK_BYTES of text
or BLOCK_WORDS words): a document becomes the list of its words' numbers, by position, and the block's words one list. Those
lists are dealt out by the words' hash, so that each distinct word of the corpus meets in one shard and is encoded there
once; its ids go back to the blocks that hold it, where each text is reassembled by position. So what is shuffled is one
entry per word and block, not one per occurrence, and a word in every document is one entry per block: no key is hot. Decoding
joins the ids with the table of the tokens' bytes (the vocabulary: 50 thousand rows, broadcast).

Memory: a task holds the words of one block, or of one shard, and pieces of the texts; it grows neither with the
table nor with the length of a text, but for the text itself.

Defined results: null or empty text has no tokens (digests of the empty string, null-free). Repeated rows and rows of a null id are
encoded each. A word of any length is merged with a heap, in n log n. Columns of the input besides the text pass through, except
those named as a result. An empty table gives an empty result. The plan reads `docs` once; it must give the same rows in the
same order if a lost task is run again, as a table or a checkpoint does.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.llm.common import chunks, gather, partitions, read, span_hashes, text_buffers, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A block ends after this many bytes of marked text or distinct words.
BLOCK_BYTES = 32 << 20
BLOCK_WORDS = 1 << 19
#: Bytes of text that are cut into words at a time, and words of texts that are put together at a time.
PIECE = 1 << 20
TOGETHER = 1 << 18
#: Shards of the words in each partition of the shuffle; one is encoded at a time.
SHARDS = 8
_NONE = 1 << 60


def java_pattern(pattern: str) -> str:
    r"""The same pattern for the JVM, whose \s is ASCII only."""
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: of the pairs of neighbours, the leftmost of the lowest rank is merged, again and again."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 150:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (least := min(pairs)) < _NONE:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if gone[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


def packed(places: np.ndarray) -> bytes:
    """Numbers as planes of their bytes (frequent words have small numbers: high planes are nearly empty), compressed."""
    if not len(places):
        return b""
    planes = places.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = max(1, (int(places.max()).bit_length() + 7) // 8)
    return bytes([top]) + pa.compress(np.ascontiguousarray(planes[:, :top].T).tobytes(), "zstd", asbytes=True)


def unpacked(payload: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.zeros((n, 4), np.uint8)
    top = payload[0]
    planes[:, :top] = np.frombuffer(pa.decompress(payload[1:], top * n, "zstd", asbytes=True), np.uint8).reshape(top, n).T
    return planes.reshape(-1).view("<u4")


def zipped(words: pa.Array) -> bytes:
    """The words' lengths and bytes, compressed."""
    data, offsets = text_buffers(words)
    sizes = packed(np.diff(offsets))
    return len(sizes).to_bytes(4, "little") + sizes + len(data).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(data).tobytes(), "zstd", asbytes=True)


def unzipped(payload: bytes, n: int) -> pa.Array:
    head = 4 + int.from_bytes(payload[:4], "little")
    size = int.from_bytes(payload[head : head + 8], "little")
    data = pa.decompress(payload[head + 8 :], size, "zstd", asbytes=True) if size else b""
    ends = np.concatenate([[0], np.cumsum(unpacked(payload[4:head], n), dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(data))


def _shards(words: pa.Array, shards: int) -> np.ndarray:
    return (span_hashes(*text_buffers(words)) % np.uint64(shards)).astype(np.int32)


#: Values of the column __kind of rows that aren't a shard's.
DOCUMENT, WORDS = -1, -2


def _tokens(marked: pa.Array, odd: pa.Array, pattern: str) -> tuple[np.ndarray, pa.Array]:
    """How many pre-tokens each row has, and all of them in order."""
    buf, offsets = text_buffers(marked)
    stops = np.flatnonzero(buf == 0)
    sizes = np.diff(np.searchsorted(stops, offsets))
    ends = stops - np.arange(len(stops))
    tokens = pa.LargeStringArray.from_buffers(len(stops), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf[buf != 0])))
    if odd.null_count < len(odd):
        import regex

        split = regex.compile(pattern).findall
        bounds, parts, done = np.concatenate([[0], np.cumsum(sizes)]), [], 0
        for row in np.flatnonzero(odd.is_valid().to_numpy(zero_copy_only=False)):
            found = split(odd[row].as_py())
            parts += [tokens.slice(done, bounds[row] - done), pa.array(found, pa.large_string())]
            done, sizes[row] = bounds[row], len(found)
        tokens = pa.concat_arrays([*parts, tokens.slice(done)])
    return sizes, tokens


def blocks(docs: DataFrame, text: str, keep: list[str], pattern: str) -> DataFrame:
    """`keep` with __block, __kind, __n and __payload: a row per document, of its n words' numbers in the block, and one per block, of its n distinct words."""
    # One NUL after each pre-token: a single string per text is far cheaper to hand over than a list of strings.
    marked = F.regexp_replace(F.col(text), java_pattern(pattern), "$0\0")
    # Texts with NULs of their own, and letters newer than the JVM's Unicode tables, are split in Python.
    odd = F.col(text).contains("\0") | (F.octet_length(text) != F.char_length(text)) & F.col(text).rlike(r"\p{Cn}")
    source = docs.withColumn("__odd", odd).select(*keep, F.when(~F.col("__odd"), marked).alias("__marked"), F.when(F.col("__odd"), F.col(text)).alias("__text"))
    names = [*keep, "__block", "__kind", "__n", "__payload"]

    def made(batches):
        from pyspark import TaskContext

        tidy()
        block, size, own, some, kept_types = TaskContext.get().partitionId() << 32, 0, {}, False, None

        def listed():
            columns = [pa.array([block]), pa.array([WORDS], pa.int32()), pa.array([len(own)]), pa.array([zipped(pa.array(list(own), pa.large_string()))], pa.binary())]
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kept_types), *columns], names)

        for batch in batches:
            kept_types = [batch.column(i).type for i in range(len(keep))]
            offsets = sum(text_buffers(batch.column(i))[1] for i in (len(keep), len(keep) + 1))
            for i, j in chunks(offsets, PIECE):
                part = batch.slice(i, j - i)
                sizes, tokens = _tokens(part.column(len(keep)), part.column(len(keep) + 1), pattern)
                coded = tokens.dictionary_encode()
                place = np.array([own.setdefault(w, len(own)) for w in coded.dictionary.to_pylist()], np.uint32)
                at, bounds = place[coded.indices.to_numpy()], np.concatenate([[0], np.cumsum(sizes)])
                places = pa.array([packed(at[bounds[k] : bounds[k + 1]]) for k in range(j - i)], pa.binary())
                columns = [pa.array(np.full(j - i, block)), pa.array(np.full(j - i, DOCUMENT, np.int32)), pa.array(sizes.astype(np.int64)), places]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(keep))), *columns], names)
                size, some = size + int(offsets[j] - offsets[i]), True
                if size >= BLOCK_BYTES or len(own) >= BLOCK_WORDS:
                    yield listed()
                    block, size, own, some = block + 1, 0, {}, False
        if some:
            yield listed()

    # Rows of words have no document: all of its columns may be null there.
    kept_fields = [T.StructField(f.name, f.dataType) for f in docs.select(keep).schema]
    schema = T.StructType([*kept_fields, T.StructField("__block", T.LongType()), T.StructField("__kind", T.IntegerType()), T.StructField("__n", T.LongType())])
    return source.mapInArrow(made, schema.add("__payload", "binary"))


_SHARD_SCHEMA = "block long, shard int, n int, words binary"
_BACK_SCHEMA = "block long, shard int, n int, sizes binary, ids binary"


def word_ids(whole: DataFrame, shared, n: int) -> DataFrame:
    """(block, shard, sizes, ids): ids of the words of each block and shard, each distinct word of the corpus encoded once."""

    def dealt(batches):
        tidy()
        for batch in batches:
            kinds = batch.column(batch.schema.get_field_index("__kind")).to_numpy()
            for row in np.flatnonzero(kinds == WORDS):
                block = batch.column(batch.schema.get_field_index("__block"))[row].as_py()
                count, payload = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("__n", "__payload"))
                words = unzipped(payload, count)
                shard = _shards(words, n * SHARDS)
                order = np.argsort(shard, kind="stable")
                some, sizes = np.unique(shard, return_counts=True)
                words, ends = words.take(pa.array(order)), np.cumsum(sizes)
                lists = pa.array([zipped(words.slice(end - size, size)) for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some, pa.int32()), pa.array(sizes.astype(np.int32)), lists], ["block", "shard", "n", "words"])

    def encoded(batches):
        tidy()
        table, known, last = shared.value, {}, None
        for batch in batches:
            for i, j in chunks(np.concatenate([[0], np.cumsum(batch.column(2).to_numpy())]), TOGETHER):
                part, sizes, ids = batch.slice(i, j - i), [], []
                for shard, count, payload in zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    words = unzipped(payload, count).to_pylist()
                    if shard != last:
                        known, last = {}, shard
                    found = [known[w] if w in known else known.setdefault(w, encode_word(w.encode(), table)) for w in words]
                    sizes.append(packed(np.array([len(x) for x in found], np.uint32)))
                    ids.append(packed(np.array([y for x in found for y in x], np.uint32)))
                lists = [pa.array(x, pa.binary()) for x in (sizes, ids)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], ["block", "shard", "n", "sizes", "ids"])

    by_shard = whole.mapInArrow(dealt, _SHARD_SCHEMA).repartitionById(n, F.pmod("shard", F.lit(n)).cast("int"))
    return by_shard.sortWithinPartitions("shard").mapInArrow(encoded, _BACK_SCHEMA)


class _Ids:
    """Ids of a block's words, by number."""

    def __init__(self, words: pa.Array, back: pa.Table, shards: int):
        by = np.argsort(_shards(words, shards), kind="stable")
        back = back.sort_by("shard")
        counts, sizes, ids = (back.column(c).to_pylist() for c in ("n", "sizes", "ids"))
        sizes = [unpacked(s, n).astype(np.int64) for s, n in zip(sizes, counts, strict=True)]
        self.flat = np.concatenate([unpacked(x, int(s.sum())) for x, s in zip(ids, sizes, strict=True)]) if ids else np.zeros(0, np.uint32)
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        if len(sizes) != len(words):
            raise RuntimeError("a block's words have changed: the input isn't read alike twice")
        self.sizes, self.starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        self.sizes[by] = sizes
        self.starts[by] = np.cumsum(sizes) - sizes

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where those of each word end)."""
        sizes = self.sizes[places]
        return self.flat[gather(self.starts[places], sizes)].astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """`docs` without the text, with ids (array of int) and decoded (binary), or with n_tokens, ids_sha256 and decoded_sha256."""
    import public_tokenizers

    ranks = load_ranks(path or public_tokenizers.path(VOCABULARY))
    pattern = pattern or public_tokenizers.PATTERN
    spark = docs.sparkSession
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    keep = [c for c in docs.columns if c != text and c not in made]
    n = partitions(spark)
    shared = spark.sparkContext.broadcast(ranks)
    # Both sides of the join below read this shuffle, whose rows are made once.
    whole = blocks(docs, text, keep, pattern).repartition(n, "__block")
    back = word_ids(whole, shared, n)
    out_schema = T.StructType(list(docs.select(keep).schema)).add("n_tokens", "long")
    for c in made[1:]:
        out_schema = out_schema.add(c, "string" if digests else T.ArrayType(T.IntegerType()) if c == "ids" else "binary")

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = left.column("__kind").to_numpy()
        rows = left.filter(pa.array(kinds == DOCUMENT))
        listed = left.filter(pa.array(kinds == WORDS))
        table = _Ids(unzipped(listed.column("__payload")[0].as_py(), listed.column("__n")[0].as_py()), right, n * SHARDS)
        counts, payloads = rows.column("__n").to_numpy(), rows.column("__payload").to_pylist()
        columns = [[] for _ in made]
        for i, j in chunks(np.concatenate([[0], np.cumsum(counts)]), TOGETHER):
            if j - i == 1 and counts[i] > TOGETHER:
                places = unpacked(payloads[i], counts[i])
                pieces = [table.of(places[k : k + TOGETHER])[0] for k in range(0, len(places), TOGETHER)]
                parts = [[(ids, decode(ids, np.array([0, len(ids)]), shared.value)[0]) for ids in pieces]]
            else:
                ids, ends = table.of(np.concatenate([unpacked(payloads[k], counts[k]) for k in range(i, j)]))
                ends = ends[np.concatenate([[0], np.cumsum(counts[i:j])])]
                data, stops = decode(ids, ends, shared.value)
                parts = [[(ids[ends[k] : ends[k + 1]], data[stops[k] : stops[k + 1]])] for k in range(j - i)]
            for own in parts:
                columns[0].append(sum(len(ids) for ids, _ in own))
                for column, at in ((columns[1], 0), (columns[2], 1)):
                    if digests:
                        digest = hashlib.sha256()
                        for piece in own:
                            digest.update(np.ascontiguousarray(piece[at]))
                        column.append(digest.hexdigest())
                    else:
                        joined = np.concatenate([piece[at] for piece in own])
                        column.append(joined.tobytes() if at else joined.astype(np.int32))
        types = [pa.int64(), *([pa.string()] * 2 if digests else [pa.list_(pa.int32()), pa.binary()])]
        return pa.Table.from_arrays([*(rows.column(c) for c in keep), *(pa.array(v, t) for v, t in zip(columns, types, strict=True))], names=[*keep, *made])

    return whole.groupBy("__block").cogroup(back.groupBy("block")).applyInArrow(assembled, out_schema)


_TABLE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def decode(ids: np.ndarray, bounds: np.ndarray, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids, joined with the table of the tokens' bytes, and where each row's end lies."""
    if id(ranks) not in _TABLE:
        tokens = sorted(ranks, key=ranks.__getitem__)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[[ranks[t] for t in tokens]] = [len(t) for t in tokens]
        _TABLE.clear()
        _TABLE[id(ranks)] = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum(size)])
    data, offsets = _TABLE[id(ranks)]
    starts, lengths = offsets[ids], offsets[ids.astype(np.int64) + 1] - offsets[ids]
    return data[gather(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])[bounds]


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's text: a row per row, null text as an empty one, repeated and null ids each alike."""
    return encode(docs.select("doc_id", "text"), digests=True)
