"""Elements of a page: their text, lists and tables, order, pages, and pages found again from a snippet.

An element row has doc_id, page_no, el_no, type, and of text, items, headers, rows what its type has (else null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.text import strip

PAGE_ELEMENTS = 50


def element_text(rule: bool = True) -> Column:
    """Text of an element; list items as lines with a dash; tables as lines of cells, with a rule below the headers."""
    items = F.array_join(F.transform("items", lambda i: F.concat(F.lit("- "), i)), "\n")
    line = lambda cells: F.array_join(cells, " | ", "None")
    head = F.when(F.size("headers") > 0, F.concat(F.array(line(F.col("headers"))), F.array(F.lit("-" * 20)) if rule else F.array().cast("array<string>")))
    table = F.array_join(F.concat(F.coalesce(head, F.array().cast("array<string>")), F.transform("rows", line)), "\n")
    return F.coalesce("text", items, table, F.lit(""))


def flatten_pages(docs: DataFrame) -> DataFrame:
    """docs: doc_id, pages array of (number, elements array of struct); one row per element, in order."""
    pages = docs.select("doc_id", F.posexplode("pages").alias("page_ord", "p"))
    rows = pages.select("doc_id", "page_ord", F.col("p.number").alias("page_no"), F.posexplode("p.elements").alias("el_no", "e"))
    return rows.select("doc_id", "page_ord", "page_no", "el_no", "e.*")


def assembled(elements: DataFrame, cap: int = 14000, pages: int | None = None, rule: bool = True, separator: str = "\n\n") -> DataFrame:
    """(doc_id, full_text): the trimmed texts of a document's elements that aren't blank, joined, capped.

    `pages` keeps elements of a document's first pages in order, as a preamble does (2 pages, 4000 characters).
    The cap belongs to the result: a document's row never holds more than what it has.
    """
    rows = elements
    if pages:
        rows = rows.withColumn("nth_page", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_no"))).filter(F.col("nth_page") <= pages)
    rows = rows.withColumn("t", strip(element_text(rule))).filter("t <> ''")
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "el_no", "t"))).alias("e"))
    return rows.select("doc_id", F.substring(F.array_join(F.transform("e", lambda x: x["t"]), separator), 1, cap).alias("full_text"))


def strip_bullet(text: Column) -> Column:
    return F.regexp_replace(text, r"^[•\-* \t]+", "")


def is_list_item(text: Column, lettered: bool = False) -> Column:
    marks = ["•", "-", "*", "1."] + (["a)"] if lettered else [])
    hit = text.startswith(marks[0])
    for mark in marks[1:]:
        hit = hit | text.startswith(mark)
    return hit


def merge_lists(elements: DataFrame) -> DataFrame:
    """Neighbouring list elements of a page become one element with all their items; el_no is the first one's."""
    order = Window.partitionBy("doc_id", "page_no").orderBy("el_no")
    listed = F.col("type") == "list"
    fresh = ~(listed & F.coalesce(F.lag("type").over(order) == "list", F.lit(False)))
    rows = elements.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(order))
    others = [c for c in elements.columns if c not in ("doc_id", "page_no", "el_no", "items")]
    first = rows.groupBy("doc_id", "page_no", "island").agg(
        F.min("el_no").alias("el_no"), F.min_by(F.struct(*others), "el_no").alias("r"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("el_no", "items"))), lambda x: F.coalesce(x["items"], F.array().cast("array<string>")))).alias("merged"),
    )
    return first.select("doc_id", "page_no", "el_no", "r.*", F.when(F.col("r.type") == "list", F.col("merged")).alias("items"))


def paginate(elements: DataFrame, per_page: int = PAGE_ELEMENTS) -> DataFrame:
    """Pages of so many elements for documents without pages of their own; el_no starts again on each."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("el_no")) - 1
    rows = elements.drop("page_no").withColumn("nth", nth)
    return rows.withColumns({"page_no": F.floor(F.col("nth") / per_page).cast("int") + 1, "el_no": F.col("nth") % per_page}).drop("nth")


def layout_order(elements: DataFrame) -> DataFrame:
    """el_no by top, then left edge, as pages with recognised and digital text need; the old number breaks ties."""
    box = Window.partitionBy("doc_id", "page_no").orderBy(F.col("bbox.y0").asc_nulls_first(), F.col("bbox.x0").asc_nulls_first(), "el_no")
    return elements.withColumn("el_no", F.row_number().over(box) - 1)


def rescale_words(words: DataFrame, factor: float = 3.0) -> DataFrame:
    """Word boxes of an enlarged image in the page's own units; origin_x, origin_y are the image's place (null: 0)."""
    at = lambda c, o: F.coalesce(o, F.lit(0.0)) + F.col(c) / factor
    return words.withColumns({
        "left": at("left", F.col("origin_x")), "top": at("top", F.col("origin_y")), "width": F.col("width") / factor, "height": F.col("height") / factor,
    }).drop("origin_x", "origin_y")


def needs_ocr(chars: Column, images: Column) -> Column:
    return (chars < 100) & (images > 0)


def markdown_table(block: Column, clean) -> Column:
    """Headers and rows of a table of at least three lines with bars; rules of dashes are left out; else both empty."""
    lines = F.filter(F.transform(F.split(block, "\n"), lambda s: strip(s)), lambda s: s != "")
    cells = lambda s: F.transform(F.slice(F.split(s, r"\|"), 2, F.greatest(F.size(F.split(s, r"\|")) - 2, F.lit(0))), lambda c: clean(strip(c)))
    fits = (F.size(lines) >= 3) & F.element_at(lines, 1).contains("|")
    rule = lambda s: s.contains("---") & (F.trim(F.translate(s, "|-", "")) == "")
    body = F.filter(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(1))), lambda s: s.contains("|") & ~rule(s))
    none = F.array().cast("array<string>")
    return F.struct(F.when(fits, cells(lines[0])).otherwise(none).alias("headers"), F.when(fits, F.transform(body, cells)).otherwise(F.array().cast("array<array<string>>")).alias("rows"))


def first_row_headers(rows: Column) -> Column:
    """A table's first row is its headers if there are more."""
    more = F.size(rows) > 1
    return F.struct(
        F.when(more, rows[0]).otherwise(F.array().cast("array<string>")).alias("headers"),
        F.when(more, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(rows).alias("rows"),
    )


def page_texts(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, page_text): texts of a page's elements joined by blanks; lists and tables aren't searched."""
    rows = elements.filter(F.coalesce("text", F.lit("")) != "").groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("el_no", "text"))).alias("e"))
    return rows.select("doc_id", "page_no", F.array_join(F.transform("e", lambda x: x["text"]), " ").alias("page_text"))


def attach_page(pages: DataFrame, rows: DataFrame, snippet: str, chars: int = 60, normalise: bool = False) -> DataFrame:
    """rows with page_no of the first page that holds the snippet's first characters in lower case; null if none or blank.

    With `normalise` (and 50 characters) only letters a-z and digits count. Snippets are looked for once each.
    """
    plain = (lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")) if normalise else (lambda c: F.lower(c))
    key = F.substring(plain(strip(F.col(snippet))), 1, chars)
    keyed = rows.withColumn("page_key", key)
    wanted = keyed.filter("page_key <> ''").select("doc_id", "page_key").distinct()
    seen = pages.select("doc_id", F.col("page_no").alias("found_on"), plain(F.col("page_text")).alias("page_text"))
    hits = wanted.join(seen, "doc_id").filter(F.col("page_text").contains(F.col("page_key"))).groupBy("doc_id", "page_key").agg(F.min("found_on").alias("page_no"))
    return keyed.drop("page_no").join(hits, ["doc_id", "page_key"], "left").drop("page_key")
