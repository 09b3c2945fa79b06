"""Operator 4: line dedup by overlapping windows of three lines.

Three consecutive lines are one window, known by 128 hash bits. A window's first occurrence (least id, null ids
last, then least text hash, then position) stays; the lines that later occurrences cover are removed, where
overlapping windows merge. Windows of blank lines only don't count. A text of fewer than three lines has no
window and stays as it is, null stays null, and a text whose lines all go becomes empty. Rows that repeat both id
and text are one document and share one fate; rows that share only the id are different documents. Very long texts go whole
through one array of windows; an empty table gives no rows. Columns come out within `row`, so their names can't clash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch, quoted

WINDOW = 3


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), pos, h1, h2: a row for each window."""
    lines = F.split(F.col(quoted(text_col)), "\n", -1)
    base = docs.where(F.col(quoted(text_col)).contains("\n")).select(F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(text_col))).alias("th"), lines.alias("l")).where(F.size("l") >= WINDOW)
    zipped = F.arrays_zip(F.col("l").alias("a"), F.slice("l", 2, F.size("l")).alias("b"), F.slice("l", 3, F.size("l")).alias("c"))
    hashed = F.transform(F.slice(zipped, 1, F.size("l") - 2), lambda x: F.when(F.trim(F.concat(x["a"], x["b"], x["c"])) != "", F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h1"), F.xxhash64(F.lit("second"), x["c"], x["a"], x["b"]).alias("h2"))))
    return base.select("id", "th", F.posexplode(hashed).alias("pos", "h")).where(F.col("h").isNotNull()).select("id", "th", "pos", "h.h1", "h.h2")


@F.pandas_udf(StringType())
def without(text: pd.Series, starts: pd.Series) -> pd.Series:
    """Texts without the lines that windows from these starts cover; null where there is nothing to do."""
    out = []
    for t, at in zip(text, starts, strict=True):
        if t is None or at is None:
            out.append(None)
            continue
        lines = t.split("\n")
        gone = bytearray(len(lines))
        for p in at:
            gone[p : p + WINDOW] = b"\1" * len(gone[p : p + WINDOW])
        out.append("\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the input row as it was), kept (the text that stays)."""
    scratch = Scratch(docs.sparkSession, "lines")
    found = scratch.write(windows(docs, id_col, text_col), "windows")
    place = F.struct(F.col("id").isNull().alias("n"), "id", "th", "pos")
    first = scratch.write(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")).where(F.col("times") > 1).select("h1", "h2", "first"), "first")
    later = found.join(first.hint("merge"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))  # no more than a text has lines
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(id_col)).alias("k"), F.col(quoted(text_col)).alias("text"))
    joined = rows.join(starts, rows["k"].eqNullSafe(starts["id"]) & (F.xxhash64(rows["text"]) == starts["th"]), "left")
    changed = without(F.when(F.col("starts").isNotNull(), F.col("text")), F.col("starts"))
    return joined.select("row", F.coalesce(changed, F.col("text")).alias("kept"))
