"""Uploads: routing by extension, CSV, workbooks, structured JSON, page text. Failures become rows, not exceptions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.sheets import clean_names

MAX_BYTES = 100 << 20
CELLS = "document_key string, sheet string, sheet_state string, r int, c int, v string, v_type string, bold boolean, formula string"
STRUCTURE = (
    "title string, document_name string, document_key string, doc_type string, pages array<struct<page_number:int,sections:array<struct<title:string,level:int,content:string,section_type:string,"
    "lines:array<struct<line_number:int,text:string>>>>>>, expectations struct<max_parents:int,max_children:int,max_duplicate_children:int,max_short_parents:int,max_forbidden_hits:int,"
    "must_include_sections:array<string>,forbidden_section_patterns:array<string>,min_parent_chars:int>"
)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, length, kind (pdf, sheet or rejected) and the reason of a rejection; contents aren't read here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(F.col("length") > MAX_BYTES, "rejected").when(ext == "pdf", "pdf").when(ext.isin("xlsx", "xls", "csv"), "sheet").otherwise("rejected")
    return files.withColumn("kind", kind).withColumn("reason", F.when(F.col("length") > MAX_BYTES, "over 100 MB").when(F.col("kind") == "rejected", "file type"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; names cleaned for SQL. Types are inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.toDF(*clean_names(df.columns))


def structures(spark: SparkSession, path: str) -> DataFrame:
    """Structured documents, one JSON file each, with defaults for what sections leave out."""
    df = spark.read.schema(STRUCTURE).option("multiLine", True).json(path)
    return with_defaults(df)


def with_defaults(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<line_number:int,text:string>>")
    section = lambda s: F.struct(F.coalesce(s["title"], F.lit("")).alias("title"), F.coalesce(s["level"], F.lit(3)).alias("level"), F.coalesce(s["content"], F.lit("")).alias("content"), F.coalesce(s["section_type"], F.lit("text")).alias("section_type"), F.coalesce(s["lines"], none).alias("lines"))
    page = lambda p: F.struct(p["page_number"].alias("page_number"), F.transform(p["sections"], section).alias("sections"))
    return df.withColumn("pages", F.transform("pages", page))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_cells(data: bytes) -> Iterator[tuple[str, str, int, int, str, str, bool, str | None]]:
    """(sheet, state, r, c, value, type, bold, formula) of all cells of an XLSX file. Merged cells hold their value at the top left."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = lambda n: ElementTree.fromstring(z.read(n))
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in xml("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        bold_styles: set[int] = set()
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            fonts = [f.find("m:b", _NS) is not None for f in styles.findall("m:fonts/m:font", _NS)]
            bold_styles = {i for i, x in enumerate(styles.findall("m:cellXfs/m:xf", _NS)) if fonts and fonts[int(x.get("fontId", 0))]}
        targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        for sheet in xml("xl/workbook.xml").findall("m:sheets/m:sheet", _NS):
            target = targets[sheet.get(_REL)].lstrip("/")
            for cell in xml(target if target.startswith("xl/") else f"xl/{target}").iter(f"{{{_NS['m']}}}c"):
                letters, digits = re.match(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                col = 0
                for x in letters:
                    col = col * 26 + ord(x) - 64
                kind, v, f = cell.get("t", "n"), cell.find("m:v", _NS), cell.find("m:f", _NS)
                if kind == "inlineStr":
                    value, v_type = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")), "s"
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    value, v_type = shared[int(v.text)], "s"
                else:
                    value, v_type = v.text, {"b": "b", "str": "s", "e": "s"}.get(kind, "n")
                yield sheet.get("name"), sheet.get("state", "visible"), int(digits) - 1, col - 1, value, v_type, int(cell.get("s", 0)) in bold_styles, f"={f.text}" if f is not None and f.text else None


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all XLSX files under a path. A file that can't be read gives one row with the error as its value and state `error`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path).where(F.col("length") <= MAX_BYTES)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                key = re.sub(r".*/", "", name)
                try:
                    rows = [(key, *c) for c in workbook_cells(bytes(data))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError) as e:
                    rows = [(key, "", "error", 0, 0, str(e), "s", False, None)]
                yield pd.DataFrame(rows, columns=["document_key", "sheet", "sheet_state", "r", "c", "v", "v_type", "bold", "formula"])

    return files.select("path", "content").mapInPandas(read, CELLS)


def raw_cells(cells: DataFrame) -> DataFrame:
    """`A1: value` lines of each visible sheet."""
    from ..functions.text import column_letters

    shown = cells.where("sheet_state = 'visible'").select("document_key", "sheet", "r", "c", F.concat(column_letters(F.col("c")), (F.col("r") + 1).cast("string"), F.lit(": "), "v").alias("t"))
    return shown.groupBy("document_key", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "t"))), lambda x: x["t"]), "\n").alias("content"))


def rest_pages(spark: SparkSession, fetch, pages: int) -> DataFrame:
    """Rows of a paged REST service: `fetch(page)` returns a list of dicts (id, label, doc_type, page_count); pages are read in parallel,
    several a task."""
    schema = "id bigint, label string, doc_type string, page_count int"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["id"]:
                yield pd.DataFrame(fetch(int(p)), columns=["id", "label", "doc_type", "page_count"])

    return spark.range(1, pages + 1, numPartitions=max(1, min(pages, spark.sparkContext.defaultParallelism))).mapInPandas(read, schema)


def csv_preview(df: DataFrame, rows: int = 100) -> str:
    """The first rows as a markdown table; a preview only, the frame stays whole."""
    head = df.limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in head])


def flat_sheets(cells: DataFrame) -> DataFrame:
    """Sheets without any table found, read flat: the first row that holds something names the columns, rows follow.

    cells (as `workbooks` gives them) -> document_key, sheet, row_index (from 0), c, name, v; empty rows and columns have no cells."""
    keys = ["document_key", "sheet"]
    some = cells.where((F.col("sheet_state") != "error") & (F.trim(F.coalesce("v", F.lit(""))) != ""))
    first = some.groupBy(*keys).agg(F.min("r").alias("head"))
    at = some.join(first, keys)
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim("v")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    names = at.where("r = head").select(*keys, "c", F.when(clean != "", clean).alias("name"))
    body = at.where("r > head").withColumn("row_index", F.dense_rank().over(Window.partitionBy(*keys).orderBy("r")) - 1)
    return body.join(names, [*keys, "c"], "left").select(*keys, "row_index", "c", F.coalesce("name", F.concat(F.lit("col_"), F.col("c").cast("string"))).alias("name"), "v")


def parsed(files: DataFrame, parsers: dict[str, Callable[[str, bytes], list[dict]]]) -> DataFrame:
    """(path, content) -> path, parser, error, page_number, title, level, content, section_type. Parsers are tried in their order; the
    first that doesn't raise gives the sections. A file that none can read is one row with a null parser and all errors: a reject."""
    columns = ["page_number", "title", "level", "content", "section_type"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                errors, rows = [], None
                for name, parse in parsers.items():
                    try:
                        rows = [(path, name, None, *(s.get(c, d) for c, d in zip(columns, (1, "", 3, "", "text"), strict=True))) for s in parse(path, bytes(data))]
                        break
                    except Exception as e:  # a parser may raise anything; the next one gets its try
                        errors.append(f"{name}: {e}")
                if rows is None:
                    rows = [(path, None, "; ".join(errors)[:2000], None, None, None, None, None)]
                yield pd.DataFrame(rows, columns=["path", "parser", "error", *columns]).astype({"page_number": "Int32", "level": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, parser string, error string, page_number int, title string, level int, content string, section_type string")


def scanned_pages(versions: DataFrame, scans: DataFrame) -> DataFrame:
    """versions (doc_id, position, version_id), scans (version_id, position from 0, content, text) -> doc_id, page_number, text.

    Only the version listed first counts; a scan's text is its content, else its text."""
    first = versions.groupBy("doc_id").agg(F.min_by("version_id", "position").alias("version_id"))
    said = F.coalesce(F.when(F.col("content") != "", F.col("content")), F.col("text"), F.lit(""))
    return first.join(scans, "version_id").select("doc_id", (F.col("position") + 1).alias("page_number"), said.alias("text"))


def with_metadata(documents: DataFrame, types: DataFrame, tags: DataFrame, cabinets: DataFrame) -> DataFrame:
    """documents (doc_id, ...) with document_type, tags and cabinets; labels are distinct and sorted, none are an empty array.

    types (doc_id, label), tags and cabinets (doc_id, label), many for each document."""
    labels = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias(name))
    none = F.array().cast("array<string>")
    j = documents.join(types.select("doc_id", F.col("label").alias("document_type")), "doc_id", "left").join(labels(tags, "tags"), "doc_id", "left").join(labels(cabinets, "cabinets"), "doc_id", "left")
    return j.withColumn("document_type", F.coalesce("document_type", F.lit(""))).withColumn("tags", F.coalesce("tags", none)).withColumn("cabinets", F.coalesce("cabinets", none))


def rest_documents(spark: SparkSession, ids: DataFrame, token: Callable[[], str], get: Callable[[int, str], dict], download: Callable[[int, str], bytes]) -> DataFrame:
    """(id) -> id, label, doc_type, page_count, content: details and the latest file of each document. A token is fetched once a task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = token()
        for pdf in batches:
            rows = [(i, d.get("label", ""), d.get("doc_type", ""), d.get("page_count", 0), download(i, key)) for i in map(int, pdf["id"]) for d in [get(i, key)]]
            yield pd.DataFrame(rows, columns=["id", "label", "doc_type", "page_count", "content"])

    return ids.select("id").mapInPandas(read, "id bigint, label string, doc_type string, page_count int, content binary")
