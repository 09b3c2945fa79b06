"""Structured documents to parent and child chunks, by document type.

Input: one row for each document with `pages` (array of page_number and sections). Sections that run over a page's
end are merged, then prepared page by page, both by folds within the row. Everything after is row-wise but for the
rule that a parent without children gives its own body, which is decided inside the row as well: no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import folds
from .splitter import recursive_split

PARENT_MIN = 140


def _line_range(lines: Column) -> tuple[Column, Column]:
    n = lambda k: F.coalesce(F.try_element_at(lines, F.lit(k))["line_number"], F.lit(0))
    return n(1), n(-1)


def matching_lines(chunk: Column, lines: Column) -> Column:
    """The section's lines whose first 40 characters are in the chunk; else its first three."""
    hit = F.filter(lines, lambda x: F.contains(chunk, F.substring(F.coalesce(x["text"], F.lit("")), 1, 40)))
    return F.when(F.size(hit) > 0, hit).otherwise(F.slice(lines, 1, 3))


def sections_of(documents: DataFrame) -> DataFrame:
    """document_key, document_name, title, doc_type, page_number, s_idx, section: merged and prepared."""
    pages = documents.withColumn("pages", folds.merged_across_pages(F.col("pages")))
    rows = pages.select("document_key", "document_name", "title", "doc_type", F.explode("pages").alias("page"))
    made = rows.select("document_key", "document_name", "title", "doc_type", "page.page_number", F.posexplode(folds.prepared_sections(F.col("page.sections"))).alias("s_idx", "section"))
    return made


#: A provider of text: asks a model for each prompt; null or empty where it has none.
Ask = Callable[[pd.Series], pd.Series]
MODES = ("off", "template", "llm", "full_llm")
# Types that a model may give a document.
VALID_TYPES = ("research_paper", "contract", "invoice", "resume", "technical_manual", "financial_report", "presentation", "medical_document", "general")


def asked_type(prompt: Column, fallback: Column, ask: Ask | None) -> Column:
    """A model's document type if it is one of the valid ones, else the fallback; a suffix for images stays."""
    if ask is None:
        return fallback
    said = F.regexp_replace(F.replace(F.lower(T.strip(F.pandas_udf(ask, "string")(prompt))), F.lit(" "), F.lit("_")), "[^a-z_]", "")
    suffix = F.when(F.endswith(fallback, F.lit("_with_images")), "_with_images").otherwise("")
    return F.when(said.isin(*VALID_TYPES), F.concat(said, suffix)).otherwise(fallback)


def enriched(chunks: DataFrame, mode: str = "template", ask: Ask | None = None, preview: str | None = None) -> DataFrame:
    """Adds enriched_content. Parents keep their text in all modes, children too in `off`; else a child gets its context in front: from the
    template, in `llm` with a model's summary of the document (`preview`, one for each title and type), in `full_llm` the model's own words for the chunk.
    Where the model has no answer, the template stands."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    child, own = F.col("chunk_type") == "child", F.col("content")
    context = T.context_prefix(F.col("title"), F.col("doc_type"), F.col("section"), F.col("page_number"))
    if mode in ("llm", "full_llm") and ask is not None:
        model = F.pandas_udf(ask, "string")
        if preview:
            summaries = chunks.groupBy("title", "doc_type").agg(F.min(preview).alias("preview")).select("title", "doc_type", model("preview").alias("summary"))
            chunks = chunks.join(summaries, ["title", "doc_type"], "left")
            usual = F.concat(F.lit("This is a "), F.replace("doc_type", F.lit("_"), F.lit(" ")), F.lit(" titled '"), "title", F.lit("'."))
            context = F.when(T.strip(F.coalesce("summary", F.lit(""))) != "", F.replace(context, usual, F.col("summary"))).otherwise(context)
        if mode == "full_llm":
            chunks = chunks.withColumn("situated", model(F.when(child, own)))
            context = F.when(T.strip(F.coalesce("situated", F.lit(""))) != "", T.strip(F.col("situated"))).otherwise(context)
    made = chunks.withColumn("enriched_content", own if mode == "off" else F.when(child & (context != ""), F.concat(context, F.lit("\n\n"), own)).otherwise(own))
    return made.drop("summary", "situated")


def with_document_metadata(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's type, tags and cabinets (document_key, document_type, tags, cabinets), so that search can filter by them."""
    return chunks.join(documents.select("document_key", "document_type", "tags", "cabinets"), "document_key", "left")


def chunked(documents: DataFrame, mode: str = "template", ask: Ask | None = None, judged: bool = False) -> DataFrame:
    """Rows of chunks: document_key, document_name, doc_type, page_number, section, chunk_type, parent_id, ordinal, content,
    enriched_content, start_line, end_line, lines, id; if judged, also duplicate_ratio, a child's against its parent (null without one)."""
    s = sections_of(documents).withColumnRenamed("section", "sec")
    kind = F.coalesce("doc_type", F.lit("general"))
    paper, contract = F.contains(kind, F.lit("research_paper")), kind == "contract"
    body = T.normalize(F.col("sec.content"))
    title = F.coalesce("sec.title", F.lit(""))
    first_line = F.lower(T.strip(F.substring_index(T.strip(F.coalesce("sec.content", F.lit(""))), "\n", 1)))
    skipped = paper & (F.lower(T.strip(title)).isin(*T.SKIPPED_SECTIONS) | first_line.isin(*T.SKIPPED_SECTIONS) | ((F.col("page_number") == 1) & (F.col("sec.level") == 1) & F.lower(F.coalesce("sec.content", F.lit(""))).rlike(T.FRONT_MATTER)))
    prefix = F.when(title == "", "").when(paper, F.concat(F.lit("[Section: "), title, F.lit("] "))).when(contract, F.concat(F.lit("[Clause: "), title, F.lit("] "))).otherwise(F.concat(F.lit("["), title, F.lit("] ")))
    named = s.where(~skipped).select(
        "document_key", "document_name", "title", kind.alias("doc_type"), "page_number", "s_idx", "sec", paper.alias("paper"), contract.alias("contract"), body.alias("body"), prefix.alias("prefix"),
        F.when(paper | contract | (title != ""), title).otherwise(F.concat(F.lit("Page "), F.col("page_number").cast("string"))).alias("section_name"),
        F.concat("document_key", F.lit(":p"), F.col("page_number").cast("string"), F.lit("_s"), F.col("s_idx").cast("string")).alias("parent_id"),
    )
    is_table = F.col("sec.section_type") == "table"
    is_image = F.col("paper") & (F.col("sec.section_type") == "image")
    plain = ~is_table & ~is_image
    stub = F.col("paper") & (F.length("body") < PARENT_MIN) & T.is_heading_stub(F.col("body"))
    full = named.where(~plain | ((F.length("body") >= T.CHILD_MIN) & ~stub))
    # Only bodies that are cut by characters go to the UDF.
    short_clause = F.col("contract") & (F.floor(F.length("body") / 4) <= T.CHILD_MAX)
    listed = F.col("sec.section_type") == "list"
    split = full.withColumn("cut", recursive_split(F.when(plain & ~short_clause & ~listed, F.col("body"))))
    pieces = F.when(short_clause, F.array("body")).when(listed, folds.packed_list(F.col("body"))).otherwise(F.col("cut"))
    distinct = lambda a: F.filter(F.transform(pieces, T.normalize), lambda c: (F.length(c) >= T.CHILD_MIN) & ~(F.col("paper") & T.is_duplicate_of(a, T.collapse(F.coalesce(c, F.lit(""))))))
    fit = T.let(T.collapse(F.coalesce("body", F.lit(""))), distinct)
    kids = F.when(short_clause, F.array("body")).when(F.col("paper") & (F.size(fit) == 0), F.array("body")).otherwise(fit)
    lines = F.col("sec.lines")
    start, stop = _line_range(lines)
    own = F.concat("prefix", "body")

    def chunk(kind: str, parent: Column, text: Column, lines: Column, a: Column, b: Column, ratio: Column | None = None) -> Column:
        more = [(F.lit(None) if ratio is None else ratio).cast("double").alias("duplicate_ratio")] if judged else []
        return F.struct(F.lit(kind).alias("chunk_type"), parent.alias("parent_id"), text.alias("content"), lines.alias("lines"), a.alias("start_line"), b.alias("end_line"), *more)

    def child(c: Column, parent: Column) -> Column:
        hit = F.when(short_clause, lines).otherwise(matching_lines(c, lines))
        text = F.concat("prefix", c)
        ratio = T.let(T.collapse(text), lambda t: T.overlap(parent, t)) if judged else None
        return T.let(hit, lambda h: chunk("child", F.col("parent_id"), text, h, *_line_range(h), ratio))

    zero, none = F.lit(0), F.lit(None).cast("string")
    page = F.col("page_number").cast("string")
    table_text = F.concat(F.when(F.col("paper"), F.concat(F.lit("[Table on page "), page, F.lit("] "))).otherwise("[Table] "), F.col("sec.content"))
    every = (
        F.when(is_image, F.array(chunk("child", none, F.concat(F.lit("[Figure on page "), page, F.lit("]: "), F.col("sec.content")), lines, zero, zero)))
        .when(is_table, F.array(chunk("child", F.col("parent_id"), table_text, lines, zero, zero)))
        .otherwise(F.concat(F.array(chunk("parent", F.col("parent_id"), own, lines, start, stop)), T.let(T.collapse(own), lambda parent: F.transform(kids, lambda c: child(c, parent)))))
    )
    flat = split.select("document_key", "document_name", "title", "doc_type", "page_number", "s_idx", F.col("section_name").alias("section"), F.posexplode(every).alias("ordinal", "c")).select("*", "c.*").drop("c")
    ident = T.chunk_id(F.col("document_key"), F.concat_ws(":", F.col("page_number").cast("string"), F.col("s_idx").cast("string"), F.col("ordinal").cast("string")), F.col("content"))
    return enriched(flat, mode, ask).withColumn("id", ident)


def semantic_chunks(sentences: DataFrame, percentile: float = 0.25) -> DataFrame:
    """sentences (doc_id, pos, sentence, embedding of its three-sentence window) -> groups cut where neighbours are least alike."""
    from pyspark.sql.window import Window

    from .retrieval import cosine

    order = Window.partitionBy("doc_id").orderBy("pos")
    # All that follows is by document, so rows are exchanged once and embeddings are worked out once.
    alike = sentences.withColumn("sim", cosine(F.lag("embedding").over(order), F.col("embedding"))).drop("embedding")
    limit = F.percentile("sim", F.lit(percentile)).over(Window.partitionBy("doc_id"))
    cut = alike.withColumn("limit", limit).withColumn("group", F.sum((F.coalesce(F.col("sim") < F.col("limit"), F.lit(False))).cast("int")).over(order))
    joined = cut.groupBy("doc_id", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), " ").alias("chunk"))
    ordered = joined.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "chunk"))), lambda s: s["chunk"]).alias("chunks"))
    return ordered.select("doc_id", F.posexplode(folds.limited(F.col("chunks"), T.sentences)).alias("pos", "chunk"))


#: Counts with an upper bound in the expectations, and what a failure calls them.
BOUNDS = {"parents": ("max_parents", "parent count"), "children": ("max_children", "child count"), "duplicates": ("max_duplicate_children", "duplicate child chunks"), "short_parents": ("max_short_parents", "short parent chunks"), "forbidden_hits": ("max_forbidden_hits", "forbidden section hits")}


def evaluated(chunks: DataFrame, expectations: DataFrame | None = None) -> DataFrame:
    """Counts for each document: parents, children, duplicates, short parents, suspicious titles, unenriched, tables; with
    expectations (document_key, expectations: the struct of structured JSON) also forbidden hits (parents only), missing sections, failures
    and whether it passes. Without them, parents are short below 140 characters. Chunks that come judged need no join with their parents."""
    if "duplicate_ratio" in chunks.columns:
        j, ratio = chunks, F.col("duplicate_ratio")
    else:
        parents = chunks.where("chunk_type = 'parent'").select("parent_id", F.col("content").alias("parent_text"))
        j = chunks.join(parents, "parent_id", "left")
        ratio = F.when(F.col("parent_text").isNotNull(), T.duplicate_ratio(F.col("parent_text"), F.col("content")))
    is_parent, is_child = F.col("chunk_type") == "parent", F.col("chunk_type") == "child"
    section = T.strip(F.coalesce("section", F.lit("")))
    odd = F.startswith(section, F.lit("[body]")) | section.rlike("^[^A-Z0-9]") | ((F.size(F.split(section, r"\s+")) <= 2) & F.endswith(section, F.lit(".")))
    dup = is_child & (ratio >= 0.9)
    least, hits = F.lit(PARENT_MIN), F.lit(0)
    if expectations is not None:
        j = j.join(expectations.select("document_key", "expectations"), "document_key", "left")
        least = F.coalesce("expectations.min_parent_chars", least)
        patterns = F.coalesce("expectations.forbidden_section_patterns", F.array().cast("array<string>"))
        found = lambda p: F.regexp_like(section, F.concat(F.lit("(?i)"), p)) | F.regexp_like("content", F.concat(F.lit("(?i)"), p))
        hits = F.when(is_parent, F.size(F.filter(patterns, found))).otherwise(0)
    counts = [
        F.count_if(is_parent).alias("parents"), F.count_if(is_child).alias("children"), F.count_if(dup).alias("duplicates"), F.count_if(is_parent & (F.length("content") < least)).alias("short_parents"),
        F.count_if(is_parent & (section != "") & odd).alias("suspicious_titles"), F.count_if(is_child & (F.coalesce("enriched_content", F.lit("")) == "")).alias("unenriched"), F.count_if(F.contains("content", F.lit("[Table"))).alias("tables"),
    ]
    if expectations is None:
        return j.groupBy("document_key").agg(*counts)
    sections = F.collect_set(F.when(is_parent, F.lower(section)))
    g = j.groupBy("document_key").agg(*counts, F.sum(hits).alias("forbidden_hits"), F.first("expectations").alias("e"), sections.alias("sections"))
    wanted = F.coalesce("e.must_include_sections", F.array().cast("array<string>"))
    missing = F.filter(wanted, lambda w: ~F.exists("sections", lambda x: F.contains(x, F.lower(w))))
    over = [F.when(F.col(c) > F.col(f"e.{bound}"), F.concat(F.lit(f"{said} "), F.col(c).cast("string"), F.lit(" > "), F.col(f"e.{bound}").cast("string"))) for c, (bound, said) in BOUNDS.items()]
    others = [F.when(F.size("missing") > 0, F.concat(F.lit("missing sections: "), F.array_join("missing", ", "))), F.when(F.col("unenriched") > 0, F.concat(F.lit("unenriched children "), F.col("unenriched").cast("string")))]
    judged = g.withColumn("missing", missing).withColumn("failures", F.array_compact(F.array(*over, *others)))
    return judged.withColumn("verdict", F.when(F.size("failures") == 0, "PASS").otherwise("FAIL")).drop("e", "sections")


def page_chunks(pages: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Pages of 30 characters or more: a parent of 4000 characters at most and its pieces. pages: doc_id, label, page_number, text."""
    full = pages.where(F.length(T.strip(F.col("text"))) >= 30)
    head = F.concat(F.lit("["), "label", F.lit(" - Page "), F.col("page_number").cast("string"), F.lit("] "))
    cut = full.withColumn("cut", recursive_split(F.col("text"), size, overlap))
    kids = F.filter("cut", lambda c: F.length(c) >= 30)
    return cut.select("doc_id", "page_number", F.concat(head, F.substring("text", 1, 4000)).alias("parent"), F.posexplode(kids).alias("pos", "chunk"))


def token_windows(tokens: Column, whole: int = 1024, size: int = 512, overlap: int = 64) -> Column:
    """Arrays of tokens: one window up to 1024, else windows of 512 with 64 shared."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n <= whole, F.array(tokens)).otherwise(F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(size))))
