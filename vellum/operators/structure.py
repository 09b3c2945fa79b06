"""Document structure from lines, spans and markup, by windows within one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_list, is_subsection, letter_ratio, plain_markdown, prefers_ocr, strip

HEADING, TABLE_ROW, IMAGE = r"^(#{1,6})\s+(\S.*)$", r"^\s*\|.*\|\s*$", r"^\s*!\[.*?\]\(.*?\)|^\s*(\*\*)?==>.*picture.*<==(\*\*)?|^<!-- image -->"


def text_lines(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Non-empty lines with their numbers; empty ones are counted but dropped."""
    rows = pages.select(*[c for c in pages.columns if c != text_col], F.posexplode(F.split(text_col, "\n", -1)).alias("p", "line"))
    return rows.withColumn("line_number", F.col("p") + 1).drop("p").where(strip(F.col("line")) != "")


def line_sections(pages: DataFrame, sheets: bool = False) -> DataFrame:
    """(document_key, page_number, markdown) -> one row for each section: headings, images, tables, lists and bodies.

    Lines get classes; a new block starts at each heading and image, and where text and table rows meet. Blank lines
    end tables only; in markdown made of sheets they end any block, and headings have three levels at most."""
    heading = HEADING.replace("{1,6}", "{1,3}") if sheets else HEADING
    keys = ["document_key", "page_number"]
    raw = F.regexp_replace(F.col("line"), r"\s+$", "")
    lines = pages.select(*keys, F.posexplode(F.split("markdown", "\n", -1)).alias("p", "line")).select(*keys, (F.col("p") + 1).alias("n"), raw.alias("line"))
    kind = F.when(F.col("line").rlike(heading), "heading").when(F.col("line").rlike(IMAGE), "image").when(F.col("line").rlike(TABLE_ROW), "table").when((strip(F.col("line")) == "") | (strip(F.col("line")) == "```"), "blank").otherwise("text")
    order = Window.partitionBy(*keys).orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(order)).withColumn("edge", F.sum(F.col("kind").isin("heading", "image").cast("int")).over(upto))
    inner = Window.partitionBy(*keys, "edge").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("kind").isin("table", "text"), F.col("kind")), ignorenulls=True).over(inner)
    shown = own.withColumn("prev", prev).where("kind != 'blank'")
    starts = F.col("kind").isin("heading", "image") | (~F.col("prev").eqNullSafe(F.col("kind"))) | (F.col("kind").isin(*(("table", "text") if sheets else ("table",))) & F.col("before").eqNullSafe("blank"))
    blocks = shown.withColumn("block", F.sum(starts.cast("int")).over(upto)).withColumn("title", F.last(F.when(F.col("kind") == "heading", plain_markdown(F.regexp_extract("line", heading, 2))), ignorenulls=True).over(upto))
    level = F.when(F.col("kind") == "heading", F.least(F.length(F.regexp_extract("line", heading, 1)), F.lit(3))).otherwise(3)
    g = blocks.withColumn("level", level).groupBy(*keys, "block").agg(
        F.min("n").alias("first_line"), F.count("*").alias("n_lines"), F.max("kind").alias("kind"), F.max("title").alias("own_title"), F.max("level").alias("level"),
        F.array_sort(F.collect_list(F.struct(F.col("n").alias("line_number"), F.col("line").alias("text")))).alias("lines"),
    )
    content = F.when(F.col("kind") == "heading", F.col("own_title")).otherwise(strip(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")))
    title = F.when(F.col("kind") == "table", F.concat(F.lit("[Table on page "), F.col("page_number").cast("string"), F.lit("]"))).when(F.col("kind") == "image", "[image]").otherwise(F.coalesce("own_title", F.lit("[body]")))
    made = g.withColumn("content", content).withColumn("title", title)
    return made.select(*keys, "block", "first_line", "n_lines", "title", "level", "content", F.when((F.col("kind") == "text") & is_list(F.col("content")), "list").otherwise(F.col("kind")).alias("section_type"), "lines")


BLOCKS = r"(?s)<(?:h[1-6]|p)[^>]*>[^<]*"


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings and paragraphs of HTML pages by position: level 1 to 3 and the text up to the next tag."""
    m = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(BLOCKS), 0)).alias("p", "m"))
    n = F.try_to_number(F.regexp_extract("m", "^<h([1-6])", 1), F.lit("9")).cast("int")
    level = F.when(F.startswith("m", F.lit("<h")), F.least(n, F.lit(3))).otherwise(3)
    return m.select(id_col, (F.col("p") + 1).cast("long").alias("pos"), level.cast("long").alias("level"), F.trim(F.regexp_replace(F.regexp_replace("m", "^<[^>]*>", ""), r"\s+", " ")).alias("content"))


def font_levels(spans: DataFrame, numbered: bool = True) -> DataFrame:
    """(document_key, ordinal, text, size, bold) -> level, by size against the size with most characters.

    numbered: bold lines that begin as a numbered subsection are headings at any size."""
    sizes = spans.groupBy("document_key", "size").agg(F.sum(F.length("text")).alias("chars"), F.min("ordinal").alias("seen"))
    body = sizes.groupBy("document_key").agg(F.max_by("size", F.struct("chars", -F.col("seen"))).alias("body"))
    minor = (F.col("size") > F.col("body") * 1.1) | (is_subsection(F.col("text")) if numbered else F.lit(False))
    level = F.when(F.col("size") > F.col("body") * 1.3, 1).when(F.col("bold") & minor, 2).otherwise(3)
    return spans.join(body, "document_key").withColumn("level", level)


def in_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks (document_key, page_number, block, box) with whether a table of the page covers more than half of them."""
    area = lambda b: F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))
    shared = lambda a, b: F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0)) * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    by_page = tables.groupBy("document_key", "page_number").agg(F.collect_list("box").alias("tables"))
    joined = blocks.join(by_page, ["document_key", "page_number"], "left")
    covered = F.exists(F.coalesce("tables", F.array()), lambda t: (shared(F.col("box"), t) > area(F.col("box")) * 0.5))
    return joined.withColumn("in_table", covered & (area(F.col("box")) > 0)).drop("tables")


def pipe_table(rows: Column) -> Column:
    """array<array<string>> -> lines of cells joined by bars, with a rule under the first."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), " | "))
    rule = F.array_join(F.transform(rows[0], lambda c: F.lit("---")), "-+-")
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def with_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages left-joined to their scans: text, use_ocr and both quality scores."""
    j = pages.join(ocr.withColumnRenamed("text", "ocr_text"), ["document_key", "page_number"], "left")
    use = prefers_ocr(F.col("text"), F.col("ocr_text"))
    return j.withColumn("use_ocr", use).withColumn("native_ratio", letter_ratio(F.col("text"))).withColumn("text", strip(F.when(use, F.col("ocr_text")).otherwise(F.coalesce("text", F.lit(""))))).drop("ocr_text")


def source_profile(pages: DataFrame) -> DataFrame:
    used = F.count_if("use_ocr")
    return pages.groupBy("document_key").agg(F.when(used > 0, "hybrid").otherwise("native_only").alias("mode"), used.alias("ocr_pages_used"), (F.count("*") - used).alias("native_pages_used"))


def ocr_sections(sections: Column, ocr: Column) -> Column:
    """Headings and images stay; the scan's paragraphs become one body under the last heading."""
    heads = F.filter(sections, lambda s: (s["section_type"] != "image") & s["level"].isin(1, 2))
    images = F.filter(sections, lambda s: s["section_type"] == "image")
    text = F.regexp_replace(ocr, "\r\n?", "\n")
    body = F.array_join(F.filter(F.transform(F.split(text, r"\n\s*\n", -1), strip), lambda p: p != ""), "\n\n")
    title = F.coalesce(F.try_element_at(heads, F.lit(-1))["title"], F.lit("[ocr]"))
    made = F.struct(title.alias("title"), F.lit(3).alias("level"), body.alias("content"), F.lit("text").alias("section_type"), F.array().cast("array<struct<line_number:int,text:string>>").alias("lines"))
    return F.when(strip(F.coalesce(ocr, F.lit(""))) == "", sections).otherwise(F.concat(heads, images, F.array(made)))


def preview(contents: Column) -> Column:
    """First sections until more than 2000 characters, joined, cut at 3000."""
    step = lambda a, x: F.when(a["n"] > 2000, a).otherwise(F.struct(F.concat(a["parts"], F.array(x)).alias("parts"), (a["n"] + F.length(x)).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("n"))
    return F.aggregate(contents, start, step, lambda a: F.substring(F.array_join(a["parts"], "\n\n"), 1, 3000))
