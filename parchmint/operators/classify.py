"""Metadata of a document's text: jurisdiction, dates, parties with roles, embeddings, a summary. texts: doc_id, full_text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions import fields as fd
from parchmint.operators import encoder as factored
from parchmint.operators.documents import centroids, nearest_centroid
from parchmint.dims import DATE_LABELS, ROLE_WORDS, TYPE_LABELS

# Patterns whose matches are part of the results, in order.
JURISDICTION = (
    r"(?i)governed\s+by\s+(?:the\s+)?laws?\s+of\s+([A-Z][A-Za-z ,()&'-]{2,60}?)(?:\.|,|;|\s+and\b)",
    r"(?i)courts?\s+of\s+([A-Z][A-Za-z ,()&'-]{2,60}?)(?:\.|,|;|\s+shall\b|\s+will\b)",
    r"(?i)venue\s+(?:shall|will)\s+be\s+(?:in\s+)?([A-Z][A-Za-z ,()&'-]{2,60}?)(?:\.|,|;)",
    r"(?i)subject\s+to\s+(?:the\s+)?(?:exclusive\s+)?jurisdiction\s+of\s+([A-Z][A-Za-z ,()&'-]{2,60}?)(?:\.|,|;)",
    r"(?i)applicable\s+law\s+(?:shall\s+be|is)\s+(?:the\s+)?(?:law\s+of\s+)?([A-Z][A-Za-z ,()&'-]{2,60}?)(?:\.|,|;)",
    r"(?i)construed\s+(?:under|in\s+accordance\s+with)\s+(?:the\s+)?laws?\s+of\s+([A-Z][A-Za-z ,()&'-]{2,60}?)(?:\.|,|;)",
)
JURISDICTION_NOISE = r"(?i)\b(the\s+state\s+of|the\s+laws?\s+of|the\s+courts?\s+of|the\s+country\s+of|pursuant\s+to|in\s+accordance\s+with)\b"
NAMED_DATE = (
    r"(?i)(Effective|Execution|Expir(?:y|ation)|Termination|Commencement|Due|Renewal|Reporting\s+Period|Notice)\s+"
    r"[Dd]ate[:\s]+([A-Z][a-z]+ \d{1,2},? \d{4}|\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4})"
)
PLAIN_DATES = (
    r"\b(\d{1,2})(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?([A-Z][a-z]+)\s+(\d{4})\b",
    r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2}),?\s+(\d{4})\b",
    r"\b(\d{4})[\/\-](\d{1,2})[\/\-](\d{1,2})\b",
    r"\b(\d{1,2})[\/\-\.](\d{1,2})[\/\-\.](\d{2,4})\b",
)
EFFECTIVE = ("Effective Date", "Execution Date", "Commencement Date")

PARTY_SCHEMA = "array<struct<name:string,role:string,basis:string>>"
DATE_SCHEMA = "array<struct<value:string,label:string,context:string>>"
#: Runs of capitalised words, the stand-in for a model of names.
_NAMES = re.compile(r"\b[A-Z][A-Za-z&.'-]*(?:[ ]+(?:of|and|&|[A-Z][A-Za-z&.'-]*))*[ ]+(?:[A-Z][A-Za-z&.'-]*)")


def jurisdiction(text: Column) -> Column:
    """struct(value, context) by the first pattern whose cleaned value has three characters; null if none has."""
    found = []
    for p in JURISDICTION:
        value = F.trim(fd.strip(F.regexp_replace(F.regexp_extract(text, p, 1), JURISDICTION_NOISE, "")), F.lit(".,;"))
        found.append(F.when(F.char_length(value) >= 3, F.struct(value.alias("value"), fd.around(text, p, 40, 40).alias("context"))))
    return F.coalesce(*found)


def dates(text: Column, most: int = 10) -> Column:
    """Array of (value, label, context): labelled dates first, then plain ones pattern by pattern, each value once.

    The contexts need the offset of every match, which built-in expressions don't give: an Arrow batch function.
    """

    @F.pandas_udf(DATE_SCHEMA)
    def scan(texts: pd.Series) -> pd.Series:
        named, plain = re.compile(NAMED_DATE), [re.compile(p) for p in PLAIN_DATES]

        def one(t):
            if t is None:
                return None
            hits = [(m, m[2].strip(), DATE_LABELS.get(m[1].lower().split()[0], "Date"), 20, 60) for m in named.finditer(t)]
            hits += [(m, m[0].strip(), "Date", 40, 80) for p in plain for m in p.finditer(t)]
            seen = {}
            for m, value, label, before, after in hits:
                if value not in seen:
                    seen[value] = {"value": value, "label": label, "context": t[max(0, m.start() - before) : m.end() + after].strip()[:200]}
            return list(seen.values())[:most]

        return texts.map(one)

    return scan(text)


def role(name: Column, window: Column) -> Column:
    """The first role one of whose words is in the name or near it; else Party."""
    near = F.lower(F.concat_ws(" ", name, window))
    hits = [(r, reduce(Column.__or__, (near.contains(w) for w in words))) for r, words in ROLE_WORDS.items()]
    return F.coalesce(*(F.when(hit, r) for r, hit in hits), F.lit("Party"))


def capitalised_names(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _NAMES.finditer(text)]


def parties(text: Column, names: Callable[[str], list[tuple[str, int, int]]] = capitalised_names, most: int = 2) -> Column:
    """Array of (name, role, basis): the first two distinct names in the first 3000 characters.

    `names` finds (name, start, end); a trained recogniser goes here. The default takes runs of capitalised words.
    """

    @F.pandas_udf("array<struct<name:string,basis:string,near:string>>")
    def scan(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            head, seen = t[:3000], {}
            for raw, start, end in names(head):
                raw = raw.strip()
                name = re.sub(r"\s*\(.*?\)\s*", "", raw).strip()
                if 3 <= len(raw) <= 100 and name not in seen:
                    near = head[max(0, start - 100) : end + 100]
                    seen[name] = {"name": name, "basis": near.strip()[:200], "near": near}
                if len(seen) == most:
                    break
            return list(seen.values())

        return texts.map(one)

    return F.transform(scan(text), lambda p: F.struct(p["name"].alias("name"), role(p["name"], p["near"]).alias("role"), p["basis"].alias("basis")))


def summary(doc_type: Column, parties: Column, dates: Column, jurisdiction: Column) -> Column:
    """A sentence of type, parties and first effective date, and one of the law."""
    label = F.coalesce(*(F.when(doc_type == t, v) for t, v in TYPE_LABELS.items()), F.lit("document"))
    who = lambda n: F.concat(parties[n]["name"], F.lit(" ("), parties[n]["role"], F.lit(")"))
    count = F.coalesce(F.size(parties), F.lit(0))
    line = F.when(count >= 2, F.concat(F.lit(" between "), who(0), F.lit(" and "), who(1))).when(count == 1, F.concat(F.lit(" involving "), who(0))).otherwise("")
    when = F.try_element_at(F.filter(dates, lambda d: d["label"].isin(*EFFECTIVE)), F.lit(1))["value"]
    law = F.coalesce(F.concat(F.lit(" Governed by the laws of "), jurisdiction["value"], F.lit(".")), F.lit(""))
    return F.concat(F.lit("This is a "), label, line, F.coalesce(F.concat(F.lit(" dated "), when), F.lit("")), F.lit("."), law)


def embed(text: Column, encoder: Callable[[], Callable[[list[str]], np.ndarray]], instruction: str = "", chars: int = 1500) -> Column:
    """Normalised vectors of the first characters of texts. `encoder()` is called once a worker and gives a batch function."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            if not len(texts):
                yield pd.Series([], dtype=object)
                continue
            v = np.asarray(encode([instruction + (t or "")[:chars] for t in texts]), dtype=np.float32)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            yield pd.Series(list(v), index=texts.index)

    return run(text)


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A batch function that needs no model: counts of hashed words; a trained encoder takes its place where there is one."""
    from zlib import crc32

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z]{3,}", t.lower()):
                out[i, crc32(w.encode()) % dim] += 1
        return out

    return encode


def document_types(texts: DataFrame, prototypes: dict[str, tuple[str, ...]], encoder=None) -> DataFrame:
    """(doc_id, document_type, confidence): the type whose prototypes' mean vector is nearest, the first in order among equals.

    `encoder` makes a batch function of a given model; without one, vectors are fitted on the texts.
    """
    if encoder is None:
        return document_types_by_factors(texts, prototypes)
    names = list(prototypes)
    rows = texts.sparkSession.createDataFrame([(i, p) for i, n in enumerate(names) for p in prototypes[n]], "label int, sentence string")
    cents = centroids(rows.select("label", embed(F.col("sentence"), encoder).alias("embedding")))
    near = nearest_centroid(texts.select(F.col("doc_id").alias("vec_id"), embed(F.col("full_text"), encoder).alias("embedding")), cents)
    return near.select(F.col("vec_id").alias("doc_id"), F.element_at(F.array(*map(F.lit, names)), F.col("nearest").cast("int") + 1).alias("document_type"), F.col("score").alias("confidence"))


def document_types_by_factors(texts: DataFrame, prototypes: dict[str, tuple[str, ...]], factors: DataFrame | None = None, chars: int = 1500) -> DataFrame:
    """`document_types` with vectors of `encoder`: factors fitted on the texts' first characters and the prototypes, unless given.

    A text without words that the factors know is the last type (other), with confidence 0.
    """
    names = list(prototypes)
    rows = texts.sparkSession.createDataFrame([(f"{i} {n}", n, p) for i, n in enumerate(names) for n, p in enumerate(prototypes[names[i]])], "doc_id string, n int, full_text string").drop("n")
    own = texts.select(F.concat(F.lit("t "), F.col("doc_id").cast("string")).alias("doc_id"), "full_text")
    factors = (factored.fit(own.unionByName(rows), chars=chars) if factors is None else factors).persist()
    label = F.regexp_extract("vec_id", r"^(\d+)", 1).cast("int")
    cents = centroids(factored.encode(rows, factors, chars=chars).toDF("vec_id", "embedding").withColumn("label", label))
    vectors = factored.encode(texts, factors, chars=chars).toDF("vec_id", "embedding")
    near = nearest_centroid(vectors, cents)
    kind = F.when(F.col("score") == 0, names[-1]).otherwise(F.element_at(F.array(*map(F.lit, names)), F.col("nearest").cast("int") + 1))
    return near.select(F.col("vec_id").alias("doc_id"), kind.alias("document_type"), F.col("score").alias("confidence"))


def classify(texts: DataFrame, doc_type: Column, names=capitalised_names) -> DataFrame:
    """Type and metadata of every document; a document without text has an error and nothing else."""
    t = F.col("full_text")
    blank = fd.strip(F.coalesce(t, F.lit(""))) == ""
    rows = texts.select("doc_id", t, F.when(blank, "no text").alias("error"), F.when(~blank, doc_type).alias("document_type"))
    rows = rows.withColumns({"jurisdiction": jurisdiction(t), "dates": dates(t), "parties": parties(t, names)})
    made = summary(F.col("document_type"), F.col("parties"), F.col("dates"), F.col("jurisdiction"))
    return rows.withColumn("document_summary", F.when(~blank, made)).drop("full_text")
