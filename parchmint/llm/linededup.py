"""4. Line dedup, in DataFrame functions only: hashes, counts and bitmaps move, and each text once to meet its bitmap.

A line's key is its text without white space (0x20, 0x09-0x0D) at the ends and with A-Z lower-cased, as a 128-bit hash.
Hashes are range-partitioned with a secondary sort by document (latest first) and position; a window streams over that order
and marks the first occurrence of each. As one line may be in a third of all documents, its occurrences are salted by document
over as many ranges as there are shuffle partitions; the ranges' first occurrences and numbers of documents are then merged,
one row per hash and range, and given back to each range. What stays is returned as a bitmap of 64 lines a word, of which only the
words that aren't all ones are kept, and the text is filtered by it after one shuffle.

Defined results: null or empty text is one empty line. Rows of one doc_id are one document for the counting of documents; rows
that are alike in doc_id and text have alike results. A null doc_id is a document older than all others; doc_id is a whole number, or text of one (other text
raises an error). Short keys are never dropped. Very long texts are split within their row, and their lines are dealt out one by one.
Other columns of the input pass through, whatever their names, except those named as a result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm.common import partitions, prefixed, read, restored

#: Shortest key that counts, in code points, and the number of documents from which a key is dropped.
LEAST_LENGTH = 20
LEAST_DOCS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RESULTS = ("n_lines", "n_dropped", "keep_bits", "kept")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does for text of ASCII alone, and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def _lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(d, t, pos, h1, h2): every line whose key is long enough, by document, hash of its text and position."""
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(d.alias("d"), F.xxhash64(text).alias("t"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(" \t\n\x0b\f\r"))
    rows = rows.select("d", "t", "pos", trimmed.alias("line")).filter(F.char_length("line") >= LEAST_LENGTH)
    rows = rows.select("d", "t", "pos", ascii_lower(F.col("line")).alias("key"))
    return rows.select("d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(d, t, words): per document with dropped lines the bitmap of kept ones, compressed: (word, bits) of 64 lines each, in order,
    of the words that aren't all ones."""
    n = partitions(docs.sparkSession)
    rows = occurrences(docs, text, doc_id).withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(n)).cast("int"))
    ranged = rows.repartitionByRange(n, "h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("d"), "t", "pos")
    # The order streams each hash's documents from the latest on: a row is a document's first occurrence where d changes.
    streamed = ranged.withColumn("first", F.coalesce(F.lag("d").over(order) != F.col("d"), F.lit(True)))
    merged = streamed.groupBy("h1", "h2").agg(F.count_if("first").alias("n_docs"), F.max("d").alias("latest"), F.collect_set("salt").alias("salts")).filter(F.col("n_docs") >= LEAST_DOCS)
    # At most as many salts as partitions: a line of a third of all documents meets its latest document in all of them.
    merged = merged.select("h1", "h2", "latest", F.explode("salts").alias("salt"))
    gone = streamed.select("h1", "h2", "salt", "d", "t", "pos").join(merged, ["h1", "h2", "salt"]).filter("d <> latest")
    words = gone.groupBy("d", "t", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    kept = F.struct("word", F.bitwise_not("bits").alias("bits"))
    return words.groupBy("d", "t").agg(F.array_sort(F.collect_list(kept)).alias("words"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with n_lines, n_dropped, keep_bits (the bitmap of kept lines; null if none is dropped) and kept (the text of the lines that
    stay; null text gives the empty string)."""
    given, body, ident = prefixed(docs), F.col(f"`__in_{text}`"), F.col(f"`__in_{doc_id}`")
    left = given.withColumn("__d", F.coalesce(ident.cast("long"), F.lit(-(1 << 63)))).withColumn("__t", F.xxhash64(body))
    joined = left.join(dropped(docs, text, doc_id).toDF("__d", "__t", "__words"), ["__d", "__t"], "left")
    # Words of all ones aren't there: laid out up to the last one that is, so that a line finds its bit at once.
    sparse = F.map_from_entries("__words")
    every = F.transform(F.sequence(F.lit(0), F.element_at("__words", -1)["word"]), lambda i: F.coalesce(F.try_element_at(sparse, i), F.lit(-1).cast("long")))
    joined = joined.withColumn("__bits", F.when(F.col("__words").isNotNull(), every))
    whole = F.coalesce(body, F.lit(""))
    bit = lambda i: F.coalesce(F.get("__bits", F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
    kept = F.filter(F.split(whole, "\n", -1), lambda line, i: F.call_function("getbit", bit(i), F.pmod(i, F.lit(64)).cast("int")) == 1)
    n_dropped = F.coalesce(F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + 64 - F.bit_count(w["bits"])), F.lit(0).cast("long"))
    n_lines = (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    text_kept = F.when(F.col("__words").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    results = zip((n_lines, n_dropped, F.col("__words"), text_kept), _RESULTS, strict=True)
    return restored(joined.withColumns({f"__out_{name}": c for c, name in results}), docs, _RESULTS)


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP4 = """
WITH lines AS (
  SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), keyed AS (
  SELECT doc_id, pos, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS latest FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.doc_id, pos, line, coalesce(keyed.doc_id <> latest, false) AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their dropped lines gone and n_chars counted anew; a document that lost all its lines goes."""
    found = dedup_lines(prefixed(docs), "__in_text", "__in_doc_id")
    text = F.when(F.col("__in_text").isNotNull(), F.col("kept"))
    changed = {"text": text, "n_chars": F.char_length(text).cast("long")}
    rows = found.filter((F.col("n_dropped") < F.col("n_lines")) | F.col("__in_text").isNull())
    return rows.select(*(changed.get(c, F.col(f"__in_{c}")).alias(c) for c in docs.columns))
