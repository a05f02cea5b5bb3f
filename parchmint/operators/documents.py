"""Text assembly, sections, clause matching, vectors, stage events and key-based upserts over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.fields import first_sentence
from parchmint.functions.text import DURATION, MONEY, PAYMENT_TERMS, first
from parchmint.dims import STAGES


def is_heading(line: Column, trimmed: bool = False) -> Column:
    s = line if trimmed else F.trim(line)
    caps = (F.upper(s) == s) & (F.lower(s) != s)
    titled = s.rlike(r"^(#{1,6}\s+)?(\d+[.)]\s+)?[A-Z][A-Za-z\s\-&/,]{2,70}$")
    numbered = s.rlike(r"^(#{1,6}\s+)?\d+[.)]\s+[A-Z]")
    return (s != "") & (F.char_length(s) <= 80) & ~s.endswith(".") & (caps | titled | numbered)


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, section, header, body): islands of lines under a heading; a heading without lines of its own is lost."""
    # All within the row: no line is shuffled. Headings are at `heads`; the first section begins before the first line.
    rows = docs.select("doc_id", F.split(text, "\n", -1).alias("lines"))
    rows = rows.withColumn("heads", F.array_compact(F.transform("lines", lambda line, i: F.when(is_heading(line), i))))
    starts, ends = F.concat(F.array(F.lit(-1)), F.col("heads")), F.concat(F.col("heads"), F.array(F.size("lines")))
    bounds = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: s["b"] - s["a"] > 1)
    rows = rows.select("doc_id", "lines", F.posexplode(bounds).alias("at", "s"))
    header = F.when(F.col("s.a") >= 0, F.trim(F.get("lines", F.col("s.a")))).otherwise(F.lit(""))
    body = F.array_join(F.slice("lines", F.col("s.a") + 2, F.col("s.b") - F.col("s.a") - 1), "\n")
    return rows.select("doc_id", (F.col("at") + 1).alias("section"), header.alias("header"), F.trim(body, F.lit(" \t\n\r")).alias("body"))


def match_headers(headers: DataFrame, dims: list[tuple[str, str]]) -> DataFrame:
    """(header, clause_type): the first type and variant that contains the heading or lies in it. Distinct headings only meet
    the constant table, as an array of its rows, so that nothing is multiplied."""
    name = F.lower("header")
    table = F.array(*(F.struct(F.lit(kind).alias("clause_type"), F.lit(variant).alias("variant")) for kind, variant in dims))
    hits = F.filter(table, lambda d: F.col("name").contains(d["variant"]) | d["variant"].contains(F.col("name")))
    named = headers.select("header").distinct().withColumn("name", name)
    return named.select("header", F.when(F.col("name") != "", F.try_element_at(hits, F.lit(1))["clause_type"]).alias("clause_type"))


def clause_value(clause_type: Column, body: Column) -> Column:
    """What a clause of a type says: money, a duration, terms, that it is there, or its first sentence."""
    sentence, duration = first_sentence(body), first(body, DURATION)
    return (
        F.when(clause_type.isin("payment_amount", "liability_cap"), first(body, MONEY))
        .when(clause_type.isin("notice_period", "confidentiality_period", "term", "non_compete", "non_solicitation"), duration)
        .when(clause_type == "payment_terms", F.coalesce(first(body, PAYMENT_TERMS), duration))
        .when(clause_type.isin("termination_for_cause", "termination_for_convenience"), F.coalesce(duration, sentence))
        .when(clause_type == "confidentiality", F.coalesce(duration, F.lit("Present")))
        .when(clause_type.isin("force_majeure", "indemnification", "assignment", "entire_agreement"), F.lit("Present"))
        .otherwise(sentence)
    )


def first_clauses(secs: DataFrame, matched: DataFrame) -> DataFrame:
    """The first section of each clause type in a document, with its value."""
    rows = secs.join(matched.filter("clause_type IS NOT NULL"), "header")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "clause_type").orderBy("section"))).filter("nth = 1")
    return rows.select("doc_id", "clause_type", F.lit(True).alias("present"), clause_value(F.col("clause_type"), F.col("body")).alias("value"), F.trim(F.substring("body", 1, 300)).alias("raw_text"))


def fill_clauses(docs: DataFrame, found: DataFrame, types: list[str]) -> DataFrame:
    """Every type for every document, absent ones with present = false."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, types))).alias("clause_type"))
    return wanted.join(found, ["doc_id", "clause_type"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, centroid): mean of the normalised vectors of a label, normalised."""
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    unit = vectors.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).withColumn("n", norm(F.col("v")))
    flat = unit.select("label", F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("pos", "x"))
    mean = flat.groupBy("label", "pos").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("e"))
    mean = mean.select("label", F.transform("e", lambda e: e["x"]).alias("m"))
    return mean.select("label", F.transform("m", lambda x: x / norm(F.col("m"))).alias("centroid"))


def nearest_centroid(vectors: DataFrame, cents: DataFrame) -> DataFrame:
    """(vec_id, nearest, score): the label of the largest cosine. There are few labels: they come as one broadcast row."""
    table = cents.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("c"))
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.lit(1).alias("one"))
    rows = v.join(F.broadcast(table.withColumn("one", F.lit(1))), "one")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = F.transform("c", lambda c: F.struct(dot(F.col("v"), c["centroid"]).alias("score"), (-c["label"]).alias("neg")))
    best = F.array_max(scored)
    norm = F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(1e-9))
    return rows.select("vec_id", (-best["neg"]).alias("nearest"), (best["score"] / norm).alias("score"))


def ocr_blocks(words: DataFrame) -> DataFrame:
    """Words of a block and paragraph joined in order, with the mean confidence, the hull and a flag of low quality."""
    rows = words.filter(F.trim("text") != "").groupBy("doc_id", "page_no", "block_num", "par_num").agg(
        F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w"), F.avg("conf").alias("conf"),
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
    )
    rows = rows.withColumn("text", F.array_join(F.transform("w", lambda w: w["text"]), " ")).drop("w")
    return rows.withColumn("low_quality", (F.col("conf") < 50) & (F.char_length("text") > 5))


def stage_fold(events: DataFrame) -> DataFrame:
    """Last status and last detail that isn't empty of each client and stage."""
    rows = events.groupBy("client_id", "stage").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.max_by(F.when(F.col("detail") != "", F.col("detail")), F.when(F.col("detail") != "", F.struct("ts", "seq"))).alias("detail"),
    )
    return rows


def stage_catch_up(folded: DataFrame) -> DataFrame:
    """Stages before the latest that a client has reached are complete, whatever their last event said."""
    index = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    rows = folded.withColumn("i", index).withColumn("top", F.max("i").over(Window.partitionBy("client_id")))
    return rows.withColumn("status", F.when((F.col("i") < F.col("top")) & F.col("status").isin("pending", "running"), "complete").otherwise(F.col("status"))).drop("i", "top")


def latest_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: what an idempotent upsert leaves behind. Aggregates map-side, so hot keys do no harm."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"), F.count("*").alias("n_versions"))
    return last.select(key, "r.*", "n_versions")
