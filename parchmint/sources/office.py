"""Office files as elements. A small reader per file gives raw blocks or cells; types, lists and pages are made in Spark.

A file that can't be read gives one row with its error. Files are independent rows: a task reads one at a time, in batches
of one partition of `binaryFile`; legacy .xls, PDF and images need libraries that aren't here (see README).
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.functions.text import strip
from parchmint.operators import elements as el
from parchmint.streaming.stages import route

BLOCKS = "doc_id string, n int, kind string, style string, numbered boolean, text string, rows array<array<string>>, error string"
CELLS = "doc_id string, sheet_no int, sheet string, row_no int, col_no int, value string, error string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, format, path, content, error) of the files under path; doc_id is the hash of the content, a format that can't be read an error."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = route(F.col("path"))
    return rows.select(F.sha2("content", 256).alias("doc_id"), kind.alias("format"), "path", "content", F.when(kind.isNull(), "unsupported format").alias("error"))


def _words(node) -> str:
    out = []
    for n in node.iter():
        if n.tag == W + "t":
            out.append(n.text or "")
        elif n.tag == W + "tab":
            out.append("\t")
        elif n.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def _docx_blocks(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ET.fromstring(z.read("word/styles.xml")).iter(W + "style"):
                name = style.find(W + "name")
                names[style.get(W + "styleId")] = name.get(W + "val") if name is not None else ""
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
        for node in body if body is not None else ():
            if node.tag == W + "p":
                style, number = node.find(f"{W}pPr/{W}pStyle"), node.find(f"{W}pPr/{W}numPr")
                key = style.get(W + "val") if style is not None else None
                yield {"kind": "paragraph", "style": names.get(key, key or ""), "numbered": number is not None, "text": _words(node)}
            elif node.tag == W + "tbl":
                yield {"kind": "table", "rows": [["\n".join(_words(p) for p in c.iter(W + "p")).strip() for c in r.findall(W + "tc")] for r in node.findall(W + "tr")]}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


#: Day numbers from here on (the year 10000) are plain numbers.
MOST_DAYS = 2_957_004
#: Numbers of built-in formats that show dates and times.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48)}


def _date_styles(styles: ET.Element) -> list[bool]:
    """Whether each cell style shows its number as a date or a time: by a built-in format, or by d, m, y, h or s in its own."""
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())
    own = {int(f.get("numFmtId")): bool(re.search("[dmyhs]", plain(f.get("formatCode", "")))) for f in styles.iter(S + "numFmt")}
    formats = (int(x.get("numFmtId", 0)) for group in styles.findall(S + "cellXfs") for x in group.findall(S + "xf"))
    return [own.get(n, n in _DATES) for n in formats]


def _moment(serial: float, since: datetime) -> str:
    """A day number as text: a date with its time, or a time of day below 1."""
    # Day 60 of the older calendar never was.
    days = serial + 1 if since.year < 1904 and 1 <= serial < 60 else serial
    at = since + timedelta(seconds=round(days * 86400))
    return str(at.time()) if 0 <= serial < 1 else str(at)


def _xlsx_cells(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        dated = _date_styles(ET.fromstring(z.read("xl/styles.xml"))) if "xl/styles.xml" in z.namelist() else []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(S + "si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        later = any(x.get("date1904") in ("1", "true") for x in book.iter(S + "workbookPr"))
        since = datetime(1904, 1, 1) if later else datetime(1899, 12, 30)
        for i, sheet in enumerate(book.iter(S + "sheet")):
            target = targets[sheet.get(R + "id")]
            name = target.lstrip("/") if target.startswith("/") else "xl/" + target
            yield i, sheet.get("name"), None, None, None
            if "worksheets/" not in name:
                continue
            with z.open(name) as f:
                for _, row in ET.iterparse(f):
                    if row.tag != S + "row":
                        continue
                    for at, c in enumerate(row.findall(S + "c"), 1):
                        v, kind = c.find(S + "v"), c.get("t")
                        if kind == "inlineStr":
                            value = "".join(t.text or "" for t in c.iter(S + "t"))
                        elif v is None or v.text is None:
                            continue
                        else:
                            value = shared[int(v.text)] if kind == "s" else ("True" if v.text == "1" else "False") if kind == "b" else v.text
                            if kind in (None, "n") and (style := int(c.get("s", 0))) < len(dated) and dated[style] and 0 <= float(v.text) < MOST_DAYS:
                                value = _moment(float(v.text), since)
                        if value != "":
                            yield i, sheet.get("name"), int(row.get("r")), _column(c.get("r")) if c.get("r") else at, value
                    row.clear()


def _per_file(read, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                try:
                    rows = read(doc_id, content)
                except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, KeyError, ET.ParseError, ValueError, IndexError, TypeError) as e:
                    rows = [{"doc_id": doc_id, "error": f"{type(e).__name__}: {e}"[:200]}]
                yield pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns, dtype=object)

    return run


def docx_blocks(found: DataFrame) -> DataFrame:
    """Paragraphs and tables of files (doc_id, content), numbered in the order of the body."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    read = lambda d, content: [{"doc_id": d, "n": i, **b} for i, b in enumerate(_docx_blocks(content))]
    return found.select("doc_id", "content").dropDuplicates(["doc_id"]).mapInPandas(_per_file(read, names), BLOCKS)


def docx_elements(blocks: DataFrame) -> DataFrame:
    """Elements of blocks: headings by style, list items joined with their neighbours, tables, paragraphs; 50 to a page."""
    t, style = strip(F.col("text")), F.coalesce("style", F.lit(""))
    low = F.lower(style)
    kind = (
        F.when(F.col("kind") == "table", "table").when(low.startswith("heading"), "heading")
        .when(style.contains("List") | F.coalesce("numbered", F.lit(False)) | el.is_list_item(t, lettered=True), "list").otherwise("paragraph")
    )
    rows = blocks.filter(F.col("error").isNull() & ((F.col("kind") == "table") | (t != ""))).withColumns({"type": kind, "t": t})
    table = el.first_row_headers(F.col("rows"))
    rows = rows.select(
        "doc_id", F.lit(1).alias("page_no"), F.col("n").alias("el_no"), "type", F.when(F.col("type") == "heading", F.coalesce(F.regexp_extract(style, r"(\d+)$", 1).try_cast("int"), F.lit(1))).alias("level"),
        F.when(F.col("type").isin("heading", "paragraph"), F.col("t")).alias("text"), F.when(F.col("type") == "list", F.array(el.strip_bullet(F.col("t")))).alias("items"),
        F.when(F.col("type") == "table", table["headers"]).alias("headers"), F.when(F.col("type") == "table", table["rows"]).alias("rows"),
    )
    return el.paginate(el.merge_lists(rows))


def xlsx_cells(found: DataFrame) -> DataFrame:
    """Cells that aren't empty of files (doc_id, content), and one row without a cell for each sheet."""
    names = [c.split()[0] for c in CELLS.split(", ")]
    read = lambda d, content: [dict(zip(names, (d, *c))) for c in _xlsx_cells(content)]
    return found.select("doc_id", "content").dropDuplicates(["doc_id"]).mapInPandas(_per_file(read, names), CELLS)


def xlsx_elements(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, skipped sheets): a page with one table per sheet that has rows below its first, which names the columns.

    Rows and columns without values below the names are dropped; missing cells are empty text; a missing name is `Unnamed: i`.
    """
    full = cells.filter("row_no IS NOT NULL")
    sheet = Window.partitionBy("doc_id", "sheet_no")
    full = full.withColumn("head", F.min("row_no").over(sheet)).withColumn("at", F.col("col_no") - F.min("col_no").over(sheet))
    body = full.filter("row_no > head")
    names = full.filter("row_no = head").groupBy("doc_id", "sheet_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "value"))).alias("names"))
    shape = body.groupBy("doc_id", "sheet_no").agg(F.array_sort(F.collect_set(F.struct("col_no", "at"))).alias("cols"))
    lines = body.groupBy("doc_id", "sheet_no", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "value"))).alias("m"))
    wide = lines.join(shape, ["doc_id", "sheet_no"]).select("doc_id", "sheet_no", "row_no", "cols", F.transform("cols", lambda c: F.coalesce(F.try_element_at("m", c["col_no"]), F.lit(""))).alias("r"))
    tables = wide.groupBy("doc_id", "sheet_no").agg(F.first("cols").alias("cols"), F.array_sort(F.collect_list(F.struct("row_no", "r"))).alias("l")).join(names, ["doc_id", "sheet_no"])
    head = F.transform("cols", lambda c: F.coalesce(F.try_element_at("names", c["col_no"]), F.concat(F.lit("Unnamed: "), c["at"].cast("string"))))
    none = lambda t: F.lit(None).cast(t)
    made = tables.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_no")).alias("page_no"), F.lit(0).alias("el_no"), F.lit("table").alias("type"), none("int").alias("level"),
        none("string").alias("text"), none("array<string>").alias("items"), head.alias("headers"), F.transform("l", lambda x: x["r"]).alias("rows"),
    )
    skipped = cells.filter("sheet IS NOT NULL").select("doc_id", "sheet_no", "sheet").distinct().join(tables.select("doc_id", "sheet_no"), ["doc_id", "sheet_no"], "left_anti")
    return made, skipped


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of all Word and Excel files under path; `read_errors` has what gave none."""
    found = files(spark, path)
    docx = docx_elements(docx_blocks(found.filter("format = 'docx'")))
    xlsx, _ = xlsx_elements(xlsx_cells(found.filter("format = 'excel'")))
    return docx.unionByName(xlsx)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, format, error) of all files under path that can't be read, damaged or of a format without a reader, and of skipped sheets."""
    found = files(spark, path)
    none = found.filter("format IS NULL OR format NOT IN ('docx', 'excel')")
    cells = xlsx_cells(found.filter("format = 'excel'"))
    _, skipped = xlsx_elements(cells)
    errors = none.select("doc_id", F.coalesce("error", F.concat(F.lit("no reader for "), "format")).alias("error")).distinct()
    for part in (docx_blocks(found.filter("format = 'docx'")), cells):
        errors = errors.unionByName(part.filter("error IS NOT NULL").select("doc_id", "error"))
    errors = errors.unionByName(skipped.select("doc_id", F.concat(F.lit("sheet without rows: "), "sheet").alias("error")))
    return found.select("path", "doc_id", "format").join(errors, "doc_id").select("path", "doc_id", "format", "error")
