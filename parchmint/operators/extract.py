"""Typed payloads of documents by type. texts: doc_id, full_text; elements as in operators.elements."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import fields as fd
from parchmint.functions.text import DATE, DURATION, MONEY, PAYMENT_TERMS, first, parse_number, plain_number, strip
from parchmint.operators import documents as dc
from parchmint.operators.rules import ratios
from parchmint import dims

# Patterns of the law that governs a contract, in order; an agreement of secrecy has the first only.
LAWS = (
    r"(?i)governed\s+by\s+(?:the\s+)?laws?\s+of\s+([A-Z][A-Za-z ,]+?)(?:\.|,|;)",
    r"(?i)courts?\s+of\s+([A-Z][A-Za-z ,]+?)(?:\.|,|;|\s+shall\b)",
    r"(?i)exclusive\s+jurisdiction\s+of\s+([A-Z][A-Za-z ,]+?)(?:\.|,|;)",
    r"(?i)jurisdiction\s+shall\s+be\s+([A-Z][A-Za-z ,]+?)(?:\.|,|;)",
)
# Words of the headers of a table of items; first cells that aren't items.
ITEM_WORDS = ("desc", "item", "service", "qty", "amount", "price")
NO_ITEMS = ("total", "subtotal", "tax", "discount")


def governing_law(text: Column, patterns=LAWS) -> Column:
    return F.coalesce(*(F.nullif(F.rtrim(fd.group(text, p), F.lit(".,;")), F.lit("")) for p in patterns))


def partial_ratio(a: str, b: str) -> float:
    """Best likeness of the shorter text with a window of the longer, 0 to 100: 200 * common subsequence / both lengths.

    Windows are as long as the shorter text, or cut by the ends of the longer one.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    m, best, full = len(short), 0.0, (1 << len(short)) - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    for start in range(1 - m, len(long)):
        window = long[max(0, start) : start + m]
        state = full  # zero bits count the longest common subsequence
        for c in window:
            u = state & masks.get(c, 0)
            state = ((state + u) | (state - u)) & full
        best = max(best, 200.0 * (m - state.bit_count()) / (m + len(window)))
    return best


def likest(table: list[tuple[str, str]], threshold: float = 75):
    """A function from a heading in lower case to the type of its likest variant: the first in order among equals, null below the threshold.

    `table` has (type, variant in lower case). Variants are found by an index of their letters and pairs of letters, and only those are
    scored that can reach the threshold. The bounds are exact: a window of w letters that has a subsequence of c in common with the
    shorter text of m reaches it only if c >= r * (m + w), r = threshold / 200, and so w >= c >= r / (1 - r) * m. Of the m - 1 pairs of
    the shorter text a letter left out breaks two at most, one put in breaks one: m - 1 - 2 * (m - c) - (w - c) are in the window too.
    """
    r = threshold / 200
    least_window = r / (1 - r)
    variants = [v for _, v in table]
    sizes = np.array([len(v) for v in variants])
    grams = [Counter([*v, *map("".join, pairwise(v))]) for v in variants]
    column = {g: i for i, g in enumerate(sorted({g for c in grams for g in c}))}
    single = np.array([len(g) == 1 for g in sorted(column)], bool)
    # A column is a gram's list of postings: how often each variant has it.
    postings = np.zeros((len(column), len(variants)), np.int32)
    for j, c in enumerate(grams):
        for g, n in c.items():
            postings[column[g], j] = n

    def shared(found: dict[int, int]) -> np.ndarray:
        rows = list(found)
        return np.minimum(postings[rows], np.array(list(found.values()), np.int32)[:, None]).sum(axis=0) if rows else np.zeros(len(variants), np.int32)

    def best(name: str) -> str | None:
        own = {column[g]: n for g, n in Counter([*name, *map("".join, pairwise(name))]).items() if g in column}
        m = np.minimum(sizes, len(name))
        letters, pairs = (shared({i: n for i, n in own.items() if single[i] == kind}) for kind in (True, False))
        broken = np.maximum(*((2 - 3 * r) * m + (1 - 3 * r) * w for w in (m, least_window * m)))
        candidates = np.flatnonzero((letters >= least_window * m - 1e-9) & (pairs >= m - 1 - broken - 1e-9))
        most = 200.0 * np.minimum(letters, m) / (m + np.minimum(letters, m) + 1e-12)
        top, kind = 0.0, None
        for j in candidates:
            # No window can be liker than one of just the letters in common.
            if most[j] + 1e-6 < top:
                continue
            score = partial_ratio(name, variants[j])
            if score > top:
                top, kind = score, table[j][0]
            if top == 100:
                break
        return kind if top >= threshold else None

    return best


#: Headings of more letters are scored one by one; so are pairs of which both texts have more than BITS letters, as a word of the machine holds the shorter one.
LONG, BITS = 256, 62
#: Windows that are scored at once.
LANES = 1 << 16


def likest_all(table: list[tuple[str, str]], threshold: float = 75):
    """`likest` for many headings at once: a function from a list of headings to their types, with the same bounds and scores.

    Scores of all pairs of a heading and a variant go on together, a letter at a time, in arrays. A pair's windows that are cut by an end of
    the longer text are read in one pass from each end. The variant of a heading's highest bound is scored first; what can't reach its score is left out.
    """
    one, r = likest(table, threshold), threshold / 200
    least_window = r / (1 - r)
    variants = [v for _, v in table]
    sizes = np.array([len(v) for v in variants], np.int64)
    letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(variants))))}
    base = len(letters) + 1

    def codes(texts: list[str], width: int) -> np.ndarray:
        """Numbers of letters; 0 for those of no variant and behind the end."""
        out = np.zeros((len(texts), width), np.int64)
        for i, t in enumerate(texts):
            out[i, : len(t)] = [letters.get(c, 0) for c in t]
        return out

    def masks(coded: np.ndarray) -> np.ndarray:
        """Bits of the places of each letter, of which 0 has none."""
        out = np.zeros((len(coded), base), np.uint64)
        for p in range(min(coded.shape[1], BITS)):
            out[np.arange(len(coded)), coded[:, p]] |= np.uint64(1 << p)
        out[:, 0] = 0
        return out

    def grams(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each letter, and each pair of letters, is there."""
        rows = np.repeat(np.arange(len(coded)), coded.shape[1]).reshape(coded.shape)
        single = np.bincount((rows * base + coded).ravel(), minlength=len(coded) * base).reshape(-1, base)
        a, b = coded[:, :-1], coded[:, 1:]
        at = rows[:, 1:] * base * base + a * base + b
        double = np.bincount(at[(a > 0) & (b > 0)], minlength=len(coded) * base * base).reshape(-1, base * base)
        single[:, 0] = 0
        return single, double

    own = codes(variants, max([1, *sizes]))
    own_masks, (own_single, own_double) = masks(own), grams(own)
    used = np.flatnonzero(own_double.any(axis=0))
    own_double = own_double[:, used]

    def shared(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Sum of the lesser counts of every heading with every variant: a product for each count."""
        return sum(((mine >= k).astype(np.float32) @ (theirs >= k).astype(np.float32).T for k in range(1, int(theirs.max(initial=0)) + 1)), np.zeros((len(mine), len(theirs)), np.float32))

    def step(state: np.ndarray, mask: np.ndarray, full: np.ndarray) -> np.ndarray:
        u = state & mask
        return ((state + u) | (state - u)) & full

    def scored(short: np.ndarray, long: np.ndarray, m: np.ndarray, n: np.ndarray, every: np.ndarray, table_of: np.ndarray, backward: np.ndarray, most: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Scores of pairs: rows of `every` (letters) and of `table_of`, `backward` (places of letters from the front, from the end), their lengths, the bound of a
        whole window, and what has to be reached: windows that can't are left out."""
        full, best, size = (np.uint64(1) << m.astype(np.uint64)) - np.uint64(1), np.zeros(len(m)), m.astype(np.float64)
        rounds = int(m.max(initial=0))
        for places, at in ((table_of, lambda k: k), (backward, lambda k: n - 1 - k)):
            state = full.copy()
            for k in range(rounds):
                inside = k < m
                mask = np.where(inside, places[short, every[long, np.where(inside, at(k), 0)]], np.uint64(0))
                state = step(state, mask, full)
                # Past a pair's own windows the score only falls.
                best = np.maximum(best, 200.0 * (size - np.bitwise_count(state)) / (size + (k + 1)))
        inner = np.where((most + 1e-6 >= top) & (most > best), np.maximum(n - m - 1, 0), 0)
        pair = np.repeat(np.arange(len(m)), inner)
        start = np.arange(len(pair)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
        for lo in range(0, len(pair), LANES):
            p, s = pair[lo : lo + LANES], start[lo : lo + LANES]
            state, whole, rows, lines, width = full[p], full[p], short[p], long[p], m[p]
            for k in range(int(width.max(initial=0))):
                inside = k < width
                state = step(state, np.where(inside, table_of[rows, every[lines, np.where(inside, s + k, 0)]], np.uint64(0)), whole)
            np.maximum.at(best, p, 200.0 * (width - np.bitwise_count(state)) / (width + width))
        return best

    def batch(names: list[str]) -> list[str | None]:
        n = np.array([len(x) for x in names], np.int64)
        coded = codes(names, max(int(n.max(initial=1)), own.shape[1]))
        single, double = grams(coded)
        common, pairs = shared(single, own_single), shared(double[:, used], own_double)
        m, w = np.minimum(n[:, None], sizes), np.maximum(n[:, None], sizes)
        broken = np.maximum(*((2 - 3 * r) * m + (1 - 3 * r) * x for x in (m, least_window * m)))
        able = (common >= least_window * m - 1e-9) & (pairs >= m - 1 - broken - 1e-9) & (m > 0)
        within = np.minimum(common, m).astype(np.float64)
        most = np.where(able, 200.0 * within / (m + within + 1e-12), -1.0)
        score, rows = np.full(most.shape, -1.0), np.arange(len(names))
        every = np.zeros((len(names) + len(own), coded.shape[1]), np.int64)
        every[: len(names)], every[len(names) :, : own.shape[1]] = coded, own
        front = np.concatenate([masks(coded), own_masks])
        # From the end: the letters of each text in reverse order.
        lengths = np.concatenate([n, sizes])
        turned = np.where(np.arange(every.shape[1]) < lengths[:, None], np.take_along_axis(every, np.maximum(lengths[:, None] - 1 - np.arange(every.shape[1]), 0), 1), 0)
        back, top = masks(turned), np.zeros(len(names))

        def rate(i: np.ndarray, j: np.ndarray) -> None:
            heading = n[i] <= sizes[j]
            short, long = np.where(heading, i, len(names) + j), np.where(heading, len(names) + j, i)
            whole = 100.0 * within[i, j] / m[i, j]
            score[i, j] = scored(short, long, m[i, j], w[i, j], every, front, back, whole, np.maximum(top[i], threshold))
            np.maximum.at(top, i, score[i, j])

        first = most.argmax(axis=1)
        some = rows[most[rows, first] >= 0]
        rate(some, first[some])
        rate(*np.nonzero((score < 0) & able & (most + 1e-6 >= np.maximum(top, threshold)[:, None])))
        chosen = score.argmax(axis=1)  # the first among equals
        return [table[j][0] if score[i, j] >= threshold else None for i, j in enumerate(chosen)]

    def best(names: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(names)
        short = [i for i, x in enumerate(names) if x and table and (len(x) <= BITS or (len(x) <= LONG and sizes.max() <= BITS))]
        for i in set(range(len(names))).difference(short):
            out[i] = one(names[i])
        for lo in range(0, len(short), 2048):
            part = short[lo : lo + 2048]
            for i, kind in zip(part, batch([names[i] for i in part]), strict=True):
                out[i] = kind
        return out

    return best


def match_headers_fuzzy(headers: DataFrame, table: list[tuple[str, str]], threshold: float = 75) -> DataFrame:
    """(header, clause_type): the type of the likest variant, the first in order among equals, null below the threshold.

    Only distinct headings are looked up, and scored against the candidates of `likest_all`; the constant table travels with the function.
    """
    rows = [(kind, variant.lower()) for kind, variant in table]

    @F.pandas_udf("string")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = likest_all(rows, threshold)
        for names in batches:
            yield pd.Series(found(names.tolist()), dtype=object)

    # Dealt out, as few bytes take long: what is distinct would be joined to a few tasks by its size.
    distinct = headers.filter("header <> ''").select("header").distinct().repartition(8 * headers.sparkSession.sparkContext.defaultParallelism)
    return distinct.withColumn("clause_type", best(F.lower("header")))


def clauses(texts: DataFrame, table: DataFrame, types: list[str], fuzzy: bool = True, money_anywhere: bool = False) -> DataFrame:
    """Every type of clause for every document: the first section whose heading matches, else absent.

    With `money_anywhere` a missing payment amount is the first money of the text.
    """
    secs = dc.sections(texts, "full_text").filter("header <> ''")
    found = dc.first_clauses(secs, (match_headers_fuzzy if fuzzy else dc.match_headers)(secs, table))
    rows = dc.fill_clauses(texts, found.withColumn("value", F.nullif("value", F.lit(""))), types)
    if money_anywhere:
        money = texts.select("doc_id", F.lit("payment_amount").alias("clause_type"), first(F.col("full_text"), MONEY).alias("money"))
        spare = ~F.col("present") & F.col("money").isNotNull()
        rows = rows.join(money.filter("money IS NOT NULL"), ["doc_id", "clause_type"], "left").withColumns({
            "value": F.when(spare, F.col("money")).otherwise(F.col("value")), "raw_text": F.when(spare, F.col("money")).otherwise(F.col("raw_text")), "present": F.col("present") | spare,
        }).drop("money")
    return rows.withColumns({"status": F.when(F.col("present"), "present").otherwise("missing"), "ord": F.array_position(F.array(*map(F.lit, types)), F.col("clause_type"))})


def contract(texts: DataFrame, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clauses and header of contracts."""
    t = F.col("full_text")
    head = texts.select(
        "doc_id", governing_law(t).alias("governing_law"), first(F.substring(t, 1, 2000), DURATION).alias("contract_term"),
        t.rlike(fd.AUTO_RENEWAL).alias("auto_renewal"), t.rlike(fd.SIGNED).alias("signed"),
    )
    return clauses(texts, dims.clause_headers(), list(dims.CLAUSE_HEADERS), fuzzy, True), head


def nda(texts: DataFrame, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clauses and header of agreements of secrecy."""
    t = F.col("full_text")
    head = texts.select(
        "doc_id", F.substring(t, 1, 3000).rlike(fd.MUTUAL).alias("mutual"), governing_law(t, LAWS[:1]).alias("governing_law"), t.rlike(fd.SIGNED_NDA).alias("signed"),
    )
    return clauses(texts, dims.clause_headers(nda=True), [*dims.NDA_HEADERS, *dims.NDA_SHARED], fuzzy), head


def invoice_header(texts: DataFrame) -> DataFrame:
    t = F.col("full_text")
    date = lambda n: F.try_element_at(fd.dates(t), F.lit(n))
    return texts.select(
        "doc_id", F.lit(None).cast("string").alias("vendor_name"), fd.email(t, 1).alias("vendor_email"), fd.phone(t).alias("vendor_phone"), fd.group(t, fd.TAX_ID).alias("vendor_tax_id"),
        fd.email(t, 2).alias("bill_to_email"), fd.group(t, fd.INVOICE_NUMBER).alias("invoice_number"), date(1).alias("invoice_date"), date(2).alias("due_date"),
        fd.group(t, fd.PO_NUMBER).alias("purchase_order"), fd.currency(t).alias("currency"), first(t, PAYMENT_TERMS).alias("payment_terms"),
        *(fd.labelled_amount(t, f).alias(f) for f in fd.AMOUNT_LABELS), *(fd.bank(t, f).alias(f) for f in fd.BANK),
    )


def invoice_lines(elements: DataFrame) -> DataFrame:
    """Items of tables whose headers name what items have: the amount is the last cell with a digit."""
    heads = F.lower(F.array_join("headers", " "))
    tables = elements.filter(reduce(Column.__or__, (heads.contains(w) for w in ITEM_WORDS)))
    rows = tables.select("doc_id", "page_no", "el_no", F.posexplode("rows").alias("row_no", "r")).filter("size(r) >= 2")
    cell = lambda n: F.try_element_at("r", F.lit(n))
    last = F.try_element_at(F.filter(F.slice("r", 2, F.size("r")), lambda c: c.rlike(r"\d")), F.lit(-1))
    desc = strip(F.coalesce(cell(1), F.lit("")))
    items = rows.withColumn("description", desc).filter((F.col("description") != "") & ~F.lower("description").isin(*NO_ITEMS))
    order = Window.partitionBy("doc_id").orderBy("page_no", "el_no", "row_no")
    return items.select(
        "doc_id", F.row_number().over(order).alias("line_no"), "description",
        F.when((F.size("r") > 2) & strip(cell(2)).rlike(r"^[\d.]"), parse_number(cell(2))).alias("quantity"),
        F.when(F.size("r") > 3, plain_number(cell(3))).alias("unit_price"), plain_number(last).alias("amount"), F.lit(None).cast("double").alias("tax_rate"),
    )


def statement_header(texts: DataFrame) -> DataFrame:
    t = F.col("full_text")
    return texts.select(
        "doc_id", fd.statement_type(t).alias("statement_type"), F.substring(F.regexp_substr(t, F.lit(fd.PERIOD)), 1, 80).alias("reporting_period"), fd.currency(t).alias("currency"),
        F.coalesce(fd.group(t, fd.UNIT), F.lit("actual")).alias("unit"), t.rlike(fd.AUDITED).alias("audited"),
    )


def statement_metrics(texts: DataFrame) -> DataFrame:
    """doc_id and the 26 metrics, with the ratios made of them."""
    t = F.col("full_text")
    return ratios(texts.select("doc_id", *(fd.statement_row(t, names).alias(m) for block in fd.STATEMENT_LABELS.values() for m, names in block.items())))


def metrics_long(metrics: DataFrame) -> DataFrame:
    """(doc_id, block, metric, value) of the metrics that were found."""
    cells = [F.struct(F.lit(b).alias("block"), F.lit(m).alias("metric"), F.col(m).alias("value")) for b, ms in fd.STATEMENT_LABELS.items() for m in ms]
    return metrics.select("doc_id", F.explode(F.array(*cells)).alias("c")).select("doc_id", "c.*").filter("value IS NOT NULL")


def rfp_header(texts: DataFrame) -> DataFrame:
    t = F.col("full_text")
    return texts.select(
        "doc_id", fd.group(t, fd.RFP_TITLE).alias("rfp_title"), fd.group(t, fd.RFP_NUMBER).alias("rfp_number"), F.coalesce(fd.group(t, fd.RFP_DEADLINE), first(t, DATE)).alias("submission_deadline"),
        fd.group(t, fd.RFP_BUDGET).alias("contract_value"), fd.email(t, -1).alias("contact_email"), F.lit(None).cast("string").alias("contact_phone"),
    )


def rfp_requirements(elements: DataFrame, most: int = 20) -> DataFrame:
    """List items of over 20 characters, with whether they bind; the first 20 of a document."""
    items = elements.select("doc_id", "page_no", "el_no", F.posexplode("items").alias("item_no", "item")).filter(F.char_length("item") > 20)
    items = items.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "el_no", "item_no"))).filter(F.col("ord") <= most)
    return items.select("doc_id", "ord", F.lit("General").alias("category"), F.substring("item", 1, 500).alias("description"), F.col("item").rlike(fd.MANDATORY).alias("mandatory"))


def criteria(text: Column, most: int = 10) -> Column:
    """Array of (criterion, weight_pct): lines of the block of criteria; labels of over 3 characters, the first 10."""
    line = lambda s: F.struct(
        F.substring(strip(F.regexp_replace(s, r"[\-•*\d%]", "")), 1, 200).alias("criterion"), F.nullif(F.regexp_extract(s, r"(\d+)\s*%", 1), F.lit("")).cast("double").alias("weight_pct")
    )
    block = F.regexp_extract(text, fd.CRITERIA, 1)
    return F.slice(F.filter(F.transform(F.split(block, "\n"), line), lambda c: F.char_length(c["criterion"]) > 3), 1, most)


def rfp_criteria(texts: DataFrame, most: int = 10) -> DataFrame:
    """The criteria as rows."""
    return texts.select("doc_id", F.posexplode(criteria(F.col("full_text"), most)).alias("ord", "c")).select("doc_id", F.col("ord") + 1, "c.*").toDF("doc_id", "ord", "criterion", "weight_pct")


def other(texts: DataFrame) -> DataFrame:
    """Facts of lines `Label: value` (15), distinct dates (8), and the squashed start of the text as summary."""
    t = F.col("full_text")
    lines = F.regexp_extract_all(t, F.lit(fd.FACT), F.lit(0))
    fact = lambda s: F.struct(strip(F.regexp_extract(s, fd.FACT, 1)).alias("label"), strip(F.regexp_extract(s, fd.FACT, 2)).alias("value"))
    return texts.select(
        "doc_id", F.substring(strip(F.regexp_replace(F.substring(strip(t), 1, 400), r"\s+", " ")), 1, 500).alias("document_summary"),
        F.slice(F.transform(lines, fact), 1, 15).alias("key_facts"), F.slice(F.array_distinct(fd.dates(t)), 1, 8).alias("dates"),
    )


def _json(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.to_json(F.struct(*[c for c in df.columns if c != "doc_id"])).alias("payload"))


def _with_list(head: DataFrame, rows: DataFrame, name: str, order: str) -> DataFrame:
    inner = [c for c in rows.columns if c not in ("doc_id", order)]
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, *inner))).alias(name))
    return head.join(lists, "doc_id", "left")


def _clause_payload(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    return _json(_with_list(parts[1], parts[0], "clauses", "ord"))


#: Type of document: function of (texts, elements) that gives (doc_id, payload as JSON). Others may be added.
EXTRACTORS = {
    "contract": lambda texts, elements: _clause_payload(contract(texts)),
    "nda": lambda texts, elements: _clause_payload(nda(texts)),
    "invoice": lambda texts, elements: _json(_with_list(invoice_header(texts), invoice_lines(elements), "line_items", "line_no")),
    "financial_statement": lambda texts, elements: _json(statement_header(texts).join(statement_metrics(texts), "doc_id")),
    "rfp": lambda texts, elements: _json(_with_list(_with_list(rfp_header(texts), rfp_requirements(elements), "requirements", "ord"), rfp_criteria(texts), "evaluation_criteria", "ord")),
    "other": lambda texts, elements: _json(other(texts)),
}


def extract(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, doc_type, payload, error) of docs (doc_id, doc_type, full_text): each type by its own function, unknown
    types as other; documents without text have an error and no payload."""
    kind = F.when(F.col("doc_type").isin(*EXTRACTORS), F.col("doc_type")).otherwise("other")
    docs = docs.withColumn("doc_type", kind)
    empty = strip(F.coalesce("full_text", F.lit(""))) == ""
    parts = [docs.filter(empty).select("doc_id", "doc_type", F.lit(None).cast("string").alias("payload"), F.lit("no text").alias("error"))]
    for name, f in EXTRACTORS.items():
        own = docs.filter(~empty & (F.col("doc_type") == name)).select("doc_id", "full_text")
        mine = elements.join(own.select("doc_id"), "doc_id", "left_semi")
        parts.append(f(own, mine).select("doc_id", F.lit(name).alias("doc_type"), "payload", F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, parts)
