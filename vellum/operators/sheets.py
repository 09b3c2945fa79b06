"""Tables out of cell grids. cells: document_key, sheet, r, c (from 0), v (text), v_type (s, n or b), bold.

A sheet's cells are few (a workbook is one upload), so islands are found per sheet; all else is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

KEYS = ["document_key", "sheet"]


def filled(cells: DataFrame) -> DataFrame:
    """Cells with content; white space counts if it is bold."""
    return cells.where(F.col("v").isNotNull() & ((strip(F.col("v")) != "") | F.col("bold")))


def islands(cells: DataFrame) -> DataFrame:
    """Bounding boxes of 8-connected cells: document_key, sheet, island (row-major), r1, c1, r2, c2."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        left = set(zip(pdf["r"], pdf["c"], strict=True))
        found = []
        for cell in sorted(left):
            if cell not in left:
                continue
            left.discard(cell)
            todo, box = [cell], [cell[0], cell[1], cell[0], cell[1]]
            while todo:
                r, c = todo.pop()
                box = [min(box[0], r), min(box[1], c), max(box[2], r), max(box[3], c)]
                for near in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if near in left:
                        left.discard(near)
                        todo.append(near)
            found.append((pdf["document_key"].iloc[0], pdf["sheet"].iloc[0], len(found), *box))
        return pd.DataFrame(found, columns=["document_key", "sheet", "island", "r1", "c1", "r2", "c2"])

    return filled(cells).groupBy(*KEYS).applyInPandas(find, "document_key string, sheet string, island int, r1 int, c1 int, r2 int, c2 int")


def region_cells(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """All filled cells of each box, those of other islands too."""
    a, b = filled(cells).alias("a"), boxes.alias("b")
    inside = (F.col("a.document_key") == F.col("b.document_key")) & (F.col("a.sheet") == F.col("b.sheet")) & F.col("r").between(F.col("r1"), F.col("r2")) & F.col("c").between(F.col("c1"), F.col("c2"))
    return a.join(b, inside).select("b.*", "r", "c", "v", "v_type", "bold")


def classified(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes with region_type: heading, key_value, table or text, by the first rule that holds."""
    inside = region_cells(cells, boxes)
    box = [*KEYS, "island", "r1", "c1", "r2", "c2"]
    text = F.col("v_type") == "s"
    columns = inside.groupBy(*box, "c").agg((F.count_if(F.col("v_type") == "n") / F.count("*")).alias("numeric")).groupBy(*box).agg(F.max(F.col("numeric") > 0.5).alias("numeric_column"))
    first = F.col("c") == F.col("c1")
    stats = inside.groupBy(*box).agg(
        F.count("*").alias("n"), F.count_if(text).alias("texts"), F.count_if(~text).alias("numbers"), F.coalesce(F.avg(F.when(text, F.length("v"))), F.lit(0.0)).alias("mean_length"), F.max("bold").alias("any_bold"),
        F.max(text & (F.length(strip(F.col("v"))) > 2) & (F.upper("v") == F.col("v")) & (F.lower("v") != F.col("v"))).alias("any_upper"), F.count_if(first).alias("firsts"), F.count_if(first & text & F.endswith(strip(F.col("v")), F.lit(":"))).alias("colons"),
    )
    s = stats.join(columns, box)
    h, w = F.col("r2") - F.col("r1") + 1, F.col("c2") - F.col("c1") + 1
    density = F.col("n") / (h * w)
    kind = (
        F.when((h == 1) & (F.col("n") <= 2) & (F.col("mean_length") < 80) & (F.col("any_bold") | F.col("any_upper") | ((w <= 2) & (F.col("n") == 1))), "heading")
        .when((w == 2) & (h >= 2) & (F.col("colons") >= F.col("firsts") * 0.4) & (F.col("firsts") >= 2), "key_value")
        .when((w >= 3) & (density > 0.4) & (F.col("numeric_column") | ((h >= 3) & (density > 0.5))), "table")
        .when((w >= 3) & (h >= 3) & (density > 0.3), "table")
        .when((F.col("mean_length") > 40) | ((w <= 2) & (F.col("texts") > F.col("numbers"))), "text")
        .when(h * w <= 6, "text")
        .otherwise("table")
    )
    return s.select(*box, kind.alias("region_type"), F.round(density, 6).alias("density"))


def titled(regions: DataFrame) -> DataFrame:
    """Regions from top to bottom, left to right, each under the last heading before it (the sheet's name at first)."""
    order = Window.partitionBy(*KEYS).orderBy("r1", "c1")
    heading = F.last(F.when(F.col("region_type") == "heading", F.col("content")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return regions.withColumn("title", F.coalesce(heading, F.col("sheet"))).withColumn("place", F.row_number().over(order))


def _rows(cells: DataFrame, cell_text: Column, joiner: str) -> DataFrame:
    box = [*KEYS, "island"]
    row = cells.groupBy(*box, "r").agg(F.array_sort(F.collect_list(F.struct("c", cell_text.alias("t")))).alias("cells"))
    line = row.select(*box, "r", F.array_join(F.transform("cells", lambda x: x["t"]), joiner).alias("line"))
    return line.groupBy(*box).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("content"))


def text_contents(inside: DataFrame) -> DataFrame:
    return _rows(inside, F.col("v"), " ")


def key_value_contents(inside: DataFrame) -> DataFrame:
    box = [*KEYS, "island"]
    row = inside.groupBy(*box, "r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("cells"))
    a, b = strip(F.col("cells")[0]["v"]), F.try_element_at("cells", F.lit(2))["v"]
    line = row.select(*box, "r", F.when(b.isNull(), a).otherwise(F.concat(F.regexp_replace(a, ":+$", ""), F.lit(": "), strip(b))).alias("line"))
    return line.groupBy(*box).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("content"))


def clean_names(names: list[str | None]) -> list[str]:
    """Column names for SQL: lower case, underscores, a counter for repeats."""
    import re

    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        base = re.sub("[^a-z0-9]+", "_", str(n).strip().lower()).strip("_") or f"col_{i}"
        seen[base] = seen.get(base, -1) + 1
        out.append(f"{base}_{seen[base]}" if seen[base] else base)
    return out


def table_grid(inside: DataFrame) -> DataFrame:
    """Cells of table regions with header and row number: document_key, sheet, island, row_index, c, name, v.

    The header is the first of the first three rows with text in half of its cells, else the first. Columns without
    a name or without values drop out."""
    box = [*KEYS, "island"]
    width = F.col("c2") - F.col("c1") + 1
    per_row = inside.groupBy(*box, "r", "r1", "c1", "c2").agg(F.count_if((F.col("v_type") == "s") & (strip(F.col("v")) != "")).alias("texts"))
    good = per_row.where((F.col("r") < F.col("r1") + 3) & (F.col("texts") >= width * 0.5)).groupBy(*box).agg(F.min("r").alias("h"))
    marked = inside.join(good, box, "left").withColumn("h", F.coalesce("h", "r1"))
    heads = marked.where("r = h").select(*box, "c", F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim("v")), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.concat(F.lit("col_"), (F.col("c") - F.col("c1")).cast("string"))).alias("base"))
    nth = F.row_number().over(Window.partitionBy(*box, "base").orderBy("c")) - 1
    named = heads.withColumn("name", F.when(nth > 0, F.concat("base", F.lit("_"), nth.cast("string"))).otherwise(F.col("base"))).where(~F.col("name").rlike(r"^(nan|none)(_\d+)?$"))
    body = marked.where("r > h").join(named.select(*box, "c", "name"), [*box, "c"])
    index = F.dense_rank().over(Window.partitionBy(*box).orderBy("r")) - 1
    return body.select(*box, index.alias("row_index"), (F.col("c") - F.col("c1")).alias("c"), "name", "v")


def numeric_columns(grid: DataFrame) -> DataFrame:
    """Which columns are numbers throughout: one bad cell leaves the column as text."""
    return grid.groupBy(*KEYS, "island", "c", "name").agg((F.count(F.expr("try_cast(v as double)")) == F.count("v")).alias("is_number"))


def markdown_table(names: list[str], rows: Column) -> Column:
    """rows: array<array<string>>."""
    head = "| " + " | ".join(names) + " |\n| " + " | ".join("---" for _ in names) + " |"
    return F.concat_ws("\n", F.lit(head), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))), "\n"))


def formulas(df: DataFrame, text: str = "formula") -> DataFrame:
    """`C5: =SUM(…)` -> column index, row number and formula; positions count from the table's own origin (r1, c1)."""
    from ..functions.text import column_index

    pattern = r"^([A-Z]+)(\d+):\s*(.+)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    hit = df.where(F.col(text).rlike(pattern))
    return hit.withColumn("c", column_index(part(1)) - F.coalesce("c1", F.lit(0))).withColumn("row_index", part(2).cast("int") - F.coalesce("r1", F.lit(0)) - 2).withColumn("expression", part(3))


def semantic_rows(df: DataFrame, sheet: str, order: str) -> DataFrame:
    """Each row in words: sheet, row number (from 1) and the columns that hold something."""
    cols = [c for c in df.columns if c != "__section__"]
    part = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    section = [F.when(F.col("__section__").isNotNull(), F.concat(F.lit("Section: "), "__section__"))] if "__section__" in df.columns else []
    return df.select(F.col(order).alias("row_index"), F.concat_ws(" | ", F.lit(f"Sheet: {sheet}"), *section, F.concat(F.lit("Row "), (F.col(order) + 1).cast("string")), *map(part, cols)).alias("text"))


def profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """A row for each column: place, name, dtype, non_null, total, distinct, samples, min and max. Samples are the least values by
    string order, as a distributed table has no first-seen order.

    One scan: the columns are stacked, values counted once each, then summed up; each task keeps a column's few least values only."""
    kinds = dict(df.dtypes)
    numeric = {c for c, t in kinds.items() if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.lit(kinds[c]).alias("dtype"), F.col(c).cast("string").alias("v"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("x")) for i, c in enumerate(df.columns)])).alias("s")).select("s.*")
    values = stacked.groupBy("place", "name", "dtype", "v").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    some = F.col("v").isNotNull()
    counts = values.groupBy("place", "name", "dtype").agg(F.sum(F.when(some, F.col("n")).otherwise(0)).alias("non_null"), F.sum("n").alias("total"), F.count("v").alias("distinct"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    least = values.where(some).withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy("v"))).where(F.col("r") <= samples)
    shown = least.groupBy("place").agg(F.array_sort(F.collect_list("v")).alias("samples"))
    return counts.join(shown, "place", "left").select("place", "name", "dtype", "non_null", "total", "distinct", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "least", "most")


def schema_text(profiled: DataFrame, table: str) -> DataFrame:
    """A line for each column, for a model that writes SQL."""
    shown = F.concat(F.when(F.col("distinct") <= 10, " — values: [").otherwise(" — e.g.: ["), F.array_join("samples", ", "), F.lit("]"))
    span = F.when(F.col("least").isNotNull(), F.concat(F.lit(" — range: ["), F.round("least", 4).cast("string"), F.lit(", "), F.round("most", 4).cast("string"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("  - "), "name", F.lit(" ("), "dtype", F.lit(", "), F.col("non_null").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" non-null, "), F.col("distinct").cast("string"), F.lit(" unique)"), shown, span)
    return profiled.select(F.lit(table).alias("table_name"), "place", line.alias("line"))


def needs_refinement(sections: DataFrame) -> DataFrame:
    """Pages (document_key, page_number) that look fragmented."""
    t = F.col("section_type")
    bars = F.length("content") - F.length(F.replace("content", F.lit("|"), F.lit("")))
    return sections.groupBy("document_key", "page_number").agg(((F.count_if(F.col("level") == 1) > 6) | (F.count_if((t == "table") & (bars < 10)) > 0) | (F.count_if((t == "text") & (F.col("level") == 3) & (F.length("content") < 30)) > 5)).alias("needs_refinement"))


SECTION_BLOCK = r"(?s)^\s*TYPE:\s*(\S+)\s*\n\s*TITLE:\s*(.*?)\s*\n\s*CONTENT:\s*(.*?)\s*$"


def section_blocks(df: DataFrame, text: str) -> DataFrame:
    """`---SECTION---` blocks of a model's answer -> pos, section_type, title, content."""
    keys = [c for c in df.columns if c != text]
    b = df.select(*keys, F.posexplode(F.split(text, "---SECTION---", -1)).alias("pos", "block")).where(F.col("block").rlike(SECTION_BLOCK))
    part = lambda k: F.regexp_extract("block", SECTION_BLOCK, k)
    return b.select(*keys, "pos", F.lower(part(1)).alias("section_type"), part(2).alias("title"), part(3).alias("content"))


#: Characters of a sheet or page that a model is asked about.
ASKED_CHARS = 8000


def asked_sections(pages: DataFrame, ask: Callable[[pd.Series], pd.Series] | None, text: str = "content") -> DataFrame:
    """A model reads grids, or refines pages: pages (keys..., `text`; `needs_refinement` if only some are asked) -> keys..., pos,
    section_type, title, content of its answers' section blocks. A page that isn't asked, or whose answer has no block, is one
    text section of its own. Without a model all are."""
    keys = [c for c in pages.columns if c not in (text, "needs_refinement")]
    wanted = F.col("needs_refinement") if "needs_refinement" in pages.columns else F.lit(True)
    answer = F.lit(None).cast("string") if ask is None else F.pandas_udf(ask, "string")(F.when(wanted, F.substring(text, 1, ASKED_CHARS)))
    asked = pages.select(*keys, text, answer.alias("answer"))
    blocks = F.filter(F.split(F.coalesce("answer", F.lit("")), "---SECTION---", -1), lambda b: b.rlike(SECTION_BLOCK))
    part = lambda b: F.struct(F.lower(F.regexp_extract(b, SECTION_BLOCK, 1)).alias("section_type"), F.regexp_extract(b, SECTION_BLOCK, 2).alias("title"), F.regexp_extract(b, SECTION_BLOCK, 3).alias("content"))
    own = F.array(F.struct(F.lit("text").alias("section_type"), F.lit("").alias("title"), F.col(text).alias("content")))
    made = asked.select(*keys, F.when(F.size(blocks) > 0, F.transform(blocks, part)).otherwise(own).alias("s"))
    return made.select(*keys, F.posexplode("s").alias("pos", "x")).select(*keys, "pos", "x.*")


def legacy_cells(cells: DataFrame) -> DataFrame:
    """Cleaning for flat sheets: columns that are over four fifths empty go, and, where three columns or more are left,
    so do leading rows of at most one value. Row and column numbers close up."""
    full = filled(cells)
    rows = full.groupBy(*KEYS).agg(F.countDistinct("r").alias("n_rows"))
    kept = full.groupBy(*KEYS, "c").agg(F.count("*").alias("n")).join(rows, KEYS).where(F.col("n") >= F.col("n_rows") * 0.2).select(*KEYS, "c")
    wide = kept.groupBy(*KEYS).agg(F.count("*").alias("n_cols"))
    body = full.join(kept, [*KEYS, "c"]).join(wide, KEYS)
    many = body.groupBy(*KEYS, "r").agg(F.count("*").alias("n")).where("n > 1").groupBy(*KEYS).agg(F.min("r").alias("first"))
    cut = body.join(many, KEYS, "left").where((F.col("n_cols") < 3) | F.col("first").isNull() | (F.col("r") >= F.col("first")))
    place = lambda c: F.dense_rank().over(Window.partitionBy(*KEYS).orderBy(c)) - 1
    return cut.select(*KEYS, place("r").alias("r"), place("c").alias("c"), "v", "v_type", "bold")


def markdown_cells(df: DataFrame, text: str = "markdown") -> DataFrame:
    """Rows of a markdown table (header and rule first): row_index, c, name, v; rows are padded or cut to the header's width."""
    keys = [c for c in df.columns if c != text]
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|", -1), lambda x: F.trim(x))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x).rlike(r"^\|.*\|$") & ~F.trim(x).rlike(r"^\|[-:| ]+\|$"))
    t = df.select(*keys, lines.alias("l")).where(F.size("l") > 1).select(*keys, cells(F.col("l")[0]).alias("h"), F.posexplode(F.slice("l", F.lit(2), F.size("l") - 1)).alias("row_index", "line"))
    base = lambda n, i: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(n), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.concat(F.lit("col_"), i.cast("string")))
    names = t.withColumn("b", F.transform("h", base)).withColumn("v", cells(F.col("line")))
    return names.select(*keys, "row_index", F.posexplode("b").alias("c", "base"), "b", "v").select(*keys, "row_index", "c", F.when(F.size(F.filter(F.slice("b", F.lit(1), F.col("c")), lambda x: x == F.col("base"))) > 0, F.concat("base", F.lit("_"), F.size(F.filter(F.slice("b", F.lit(1), F.col("c")), lambda x: x == F.col("base"))).cast("string"))).otherwise(F.col("base")).alias("name"), F.coalesce(F.get("v", F.col("c")), F.lit("")).alias("v"))
