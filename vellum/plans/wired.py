"""Queries on the operators around the core: scans, boxes of text, reranking, metadata, look-ups, facts, coverage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import chunking, folds, sheets, structure
from ..operators import retrieval as R
from ..sources.files import scanned_pages, with_metadata
from ..sources.tables import table
from .retrieval import _COS, asked_vectors, vectors
from .text import S_CHUNKS, _s_ratio, chunk_rows, docs, s_packed, s_sentences, s_strip

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _book(i, n: int = 10):
    return F.concat(F.lit("book"), F.floor(i / n).cast("string"))


def scanned(spark, sf_dir) -> DataFrame:
    """Ten documents make a book; a third of its pages have their source's name for text, and web pages are the scans of
    the version listed first."""
    d = docs(spark, sf_dir).select(_book(F.col("doc_id")).alias("document_key"), (F.col("doc_id") % 10 + 1).alias("page_number"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("text")).alias("text"))
    p = table(spark, sf_dir, "pages")
    versions = p.select(_book(F.col("page_id")).alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position"), _book(F.col("page_id")).alias("b")).distinct().withColumn("version_id", F.concat("b", F.lit("v"), F.col("position").cast("string"))).drop("b")
    scans = p.select(F.concat(_book(F.col("page_id")), F.lit("v0")).alias("version_id"), (F.col("page_id") % 10).alias("position"), F.lit("").alias("content"), F.col("html").alias("text"))
    return structure.with_ocr(d, scanned_pages(versions, scans).withColumnRenamed("doc_id", "document_key"))


_SCANNED = f"""SELECT document_key, page_number, CASE WHEN use_ocr THEN b ELSE a END AS text, use_ocr, ra FROM (SELECT *, b <> '' AND ((length(a) < 80 AND length(b) >= 80) OR (ra < 0.45 AND rb > ra + 0.1) OR (length(a) > 0 AND length(b) > length(a) * 1.5 AND rb >= ra)) AS use_ocr
    FROM (SELECT *, {_s_ratio('a')} AS ra, {_s_ratio('b')} AS rb FROM (SELECT 'book' || d.doc_id // 10 AS document_key, d.doc_id % 10 + 1 AS page_number, {s_strip("coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.source ELSE d.text END, '')")} AS a, {s_strip("coalesce(p.html, '')")} AS b FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)))"""


@query(f"SELECT document_key, page_number, use_ocr, round(ra, 6) AS native_ratio, length(text)::BIGINT AS n FROM ({_SCANNED})")
def ocr_pages(spark, sf_dir):
    return scanned(spark, sf_dir).select("document_key", "page_number", "use_ocr", F.round("native_ratio", 6).alias("native_ratio"), F.length("text").cast("long").alias("n"))


@query(f"SELECT document_key, CASE WHEN count(*) FILTER (use_ocr) > 0 THEN 'hybrid' ELSE 'native_only' END AS mode, count(*) FILTER (use_ocr)::BIGINT AS ocr_pages_used, count(*) FILTER (NOT use_ocr)::BIGINT AS native_pages_used FROM ({_SCANNED}) GROUP BY document_key")
def source_profile(spark, sf_dir):
    return structure.source_profile(scanned(spark, sf_dir))


@query(
    f"""WITH l AS (SELECT doc_id, n, line, CASE WHEN n % 5 = 4 THEN 'image' ELSE 'text' END AS kind, least(n % 4 + 1, 3) AS level, p.html FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents) d LEFT JOIN pages p ON p.page_id = d.doc_id),
    o AS (SELECT doc_id, n, line, kind, level, CASE WHEN html IS NULL OR {s_strip('html')} = '' THEN 1 WHEN kind <> 'image' AND level < 3 THEN 1 WHEN kind = 'image' THEN 2 END AS part, html FROM l),
    b AS (SELECT doc_id, max(html) AS html, coalesce(arg_max(line, n) FILTER (kind <> 'image' AND level < 3), '[ocr]') AS title FROM o WHERE html IS NOT NULL AND {s_strip('html')} <> '' GROUP BY doc_id),
    u AS (SELECT doc_id, part, n, line AS title, level, kind, line AS content FROM o WHERE part IS NOT NULL
      UNION ALL SELECT doc_id, 3, 0, title, 3, 'text', array_to_string(list_filter(list_transform(regexp_split_to_array(replace(html, '<p>', chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {s_strip('x')}), lambda x: x <> ''), chr(10) || chr(10)) FROM b)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, n) - 1 AS pos, title, level::BIGINT AS level, kind, content FROM u"""
)
def ocr_sections(spark, sf_dir):
    """Where a page has a scan, its headings and images stay and the scan's paragraphs become one body."""
    none = F.array().cast("array<struct<line_number:int,text:string>>")
    section = lambda x, i: F.struct(x.alias("title"), F.least(i % 4 + 1, F.lit(3)).alias("level"), x.alias("content"), F.when(i % 5 == 4, "image").otherwise("text").alias("section_type"), none.alias("lines"))
    d = docs(spark, sf_dir).select("doc_id", F.transform(F.split("text", "\n", -1), section).alias("s"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.replace("html", F.lit("<p>"), F.lit("\n\n")).alias("ocr"))
    rows = d.join(p, "doc_id", "left").select("doc_id", F.posexplode(structure.ocr_sections(F.col("s"), F.col("ocr"))).alias("p", "x"))
    return rows.select("doc_id", F.col("p").cast("long").alias("pos"), "x.title", F.col("x.level").cast("long").alias("level"), F.col("x.section_type").alias("kind"), "x.content")


def _nations(spark, sf_dir) -> DataFrame:
    row = F.array(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit(" "), "n_name", F.lit(" "))))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"])
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rows.alias("rows"))


@query("SELECT n_regionkey, 'key | name' || chr(10) || '----+----' || chr(10) || string_agg(n_nationkey || ' | ' || CASE WHEN n_nationkey % 4 <> 0 THEN n_name ELSE '' END, chr(10) ORDER BY n_nationkey) AS shown FROM nation GROUP BY n_regionkey")
def pipe_table(spark, sf_dir):
    head = F.array(F.array(F.lit("key"), F.lit("name")))
    return _nations(spark, sf_dir).select("n_regionkey", structure.pipe_table(F.concat(head, "rows")).alias("shown"))


@query("SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || CASE WHEN n_nationkey % 4 <> 0 THEN ' ' || n_name || ' ' ELSE '' END || ' |', chr(10) ORDER BY n_nationkey) AS shown FROM nation GROUP BY n_regionkey")
def markdown_table(spark, sf_dir):
    return _nations(spark, sf_dir).select("n_regionkey", sheets.markdown_table(["key", "name"], F.col("rows")).alias("shown"))


@query(
    f"""WITH h AS (SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 20),
    s AS (SELECT h.*, CASE WHEN rank <= 15 THEN 0 ELSE 1 END AS tier, CASE WHEN rank <= 15 THEN (coalesce(length(d.text), 0) % 97 + query_id % 2)::DOUBLE END AS again FROM h LEFT JOIN documents d ON d.doc_id = h.vec_id)
    SELECT query_id, vec_id, tier, again, row_number() OVER (PARTITION BY query_id ORDER BY tier, again DESC NULLS LAST, rank)::INT AS rank FROM s"""
)
def rerank_hits(spark, sf_dir):
    """An injected scorer orders the first fifteen anew; the others follow as they were."""

    def score(asked: pd.Series, text: pd.Series) -> pd.Series:
        return text.map(lambda t: float(len(t or "") % 97)) + asked.map(lambda q: float(int(q) % 2))

    hits = R.vector_topk(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), "vec_id", 20)
    texts = docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
    j = hits.join(texts, "vec_id", "left").withColumn("asked", F.col("query_id").cast("string"))
    return R.reranked(j, score, "asked", "text").select("query_id", "vec_id", "tier", "again", "rank")


@query(
    f"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list(label))) AS tags FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS label FROM labels UNION ALL SELECT doc_id, 'q' || quality FROM labels) GROUP BY doc_id)
    SELECT c.doc_id, c.pos, d.lang AS document_type, coalesce(array_to_string(t.tags, ','), '') AS tags, CASE WHEN d.doc_id % 2 = 0 THEN d.source ELSE '' END AS cabinets FROM ({S_CHUNKS}) c JOIN documents d USING (doc_id) LEFT JOIN t USING (doc_id) WHERE NOT list_contains(coalesce(t.tags, []), 'toxic')"""
)
def chunk_metadata(spark, sf_dir):
    """Chunks with their document's type, tags and cabinets, less those of documents with one tag."""
    d, q = docs(spark, sf_dir), table(spark, sf_dir, "labels")
    tags = q.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label")).unionAll(q.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"))))
    known = with_metadata(d.select("doc_id"), d.select("doc_id", F.col("lang").alias("label")), tags, d.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("label")))
    chunks = chunk_rows(spark, sf_dir).withColumnRenamed("doc_id", "document_key")
    made = chunking.with_document_metadata(chunks, known.withColumnRenamed("doc_id", "document_key")).where(~F.array_contains("tags", "toxic"))
    return made.select(F.col("document_key").alias("doc_id"), "pos", "document_type", F.array_join("tags", ",").alias("tags"), F.array_join("cabinets", ",").alias("cabinets"))


@query(f"SELECT doc_id, pos, chunk FROM ({S_CHUNKS}) WHERE doc_id IN (SELECT item_id FROM benchmark) AND pos <= 2")
def chunks_by_ids(spark, sf_dir):
    """Chunks by a list of their ids, which is a table."""
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("pos"))
    return R.chunks_by_id(chunk_rows(spark, sf_dir), ids, ["doc_id", "pos"])


_ITEMS = "SELECT doc_id, source, doc_id % 3 + 1 AS page_number, n_chars % 7 AS start_line FROM documents"


@query(f"SELECT source, doc_id, page_number, start_line, row_number() OVER (PARTITION BY source ORDER BY page_number, start_line, doc_id) AS place FROM ({_ITEMS}) WHERE source IN (SELECT 'src' || item_id FROM benchmark)")
def parents_in_order(spark, sf_dir):
    """The parents of a list of documents by page and line."""
    rows = docs(spark, sf_dir).select("doc_id", F.col("source").alias("document_key"), (F.col("doc_id") % 3 + 1).alias("page_number"), (F.col("n_chars") % 7).alias("start_line"))
    keys = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("document_key"))
    return R.parents_of(rows, keys, "doc_id").select(F.col("document_key").alias("source"), "doc_id", "page_number", "start_line", "place")


@query("SELECT lang, source, dense_rank() OVER (PARTITION BY lang ORDER BY seen) AS place, ids FROM (SELECT lang, source, min(n_chars * 1000000 + doc_id) AS seen, string_agg(doc_id, ',' ORDER BY n_chars, doc_id) AS ids FROM documents GROUP BY lang, source)")
def grouped_by_name(spark, sf_dir):
    """Ranked rows grouped by their document's name, groups in the order in which they are first seen."""
    rows = docs(spark, sf_dir).select("lang", "source", "doc_id", (F.col("n_chars") * 1_000_000 + F.col("doc_id")).alias("rank"))
    return R.in_first_seen_order(rows, "lang", "source", "rank", "doc_id").select("lang", "source", "place", F.array_join("items", ",").alias("ids"))


_SAID = "text || ' Net ' || doc_id % 90 || ' days, payment terms: ' || doc_id % 7 || ' days; 2.5% annual interest, 3 % per fee, $1,' || (doc_id % 900 + 100) || '.50 and $7, effective March ' || (doc_id % 28 + 1) || ', 2024'"


@query(
    f"""WITH t AS (SELECT doc_id, {_SAID} AS t FROM documents), f AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{label}' AS label, list_transform(regexp_extract_all(t, '{pattern}', 1), lambda v: '{before}' || v || '{after}') AS v FROM t" for k, (label, pattern, before, after) in enumerate(T.FACTS))})
    SELECT doc_id, label, unnest(v) AS value, (k * 1000000 + unnest(range(1, len(v) + 1)))::BIGINT AS place FROM f"""
)
def fact_extract(spark, sf_dir):
    i = F.col("doc_id")
    said = F.concat("text", F.lit(" Net "), (i % 90).cast("string"), F.lit(" days, payment terms: "), (i % 7).cast("string"), F.lit(" days; 2.5% annual interest, 3 % per fee, $1,"), (i % 900 + 100).cast("string"), F.lit(".50 and $7, effective March "), (i % 28 + 1).cast("string"), F.lit(", 2024"))
    # Facts come by pattern and place; SQL counts places within a pattern.
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(T.facts(said)).alias("p", "f")).select("doc_id", "p", "f.label", "f.value")
    order = Window.partitionBy("doc_id", "label").orderBy("p")
    number = F.element_at(F.create_map(*[x for k, f in enumerate(T.FACTS) for x in (F.lit(f[0]), F.lit(k))]), F.col("label"))
    return d.select("doc_id", "label", "value", (number * 1_000_000 + F.row_number().over(order)).cast("long").alias("place"))


def _s_form(x: str) -> str:
    for pattern, by in T.MARKUP:
        x = f"regexp_replace({x}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    x = f"lower({s_strip(x)})"
    for pattern in T.PREFIXES:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return x


_PAGED = f"""SELECT doc_id, k::BIGINT AS page_number, l, {s_packed('s')} AS c FROM (SELECT doc_id, k, l, {s_sentences("array_to_string(l, chr(10))")} AS s FROM (SELECT doc_id, k, v[5*k-4:5*k] AS l FROM (SELECT doc_id, v, unnest(range(1, (len(v) + 4) // 5 + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents))))"""
_COVERED = f"""SELECT doc_id, page_number, len(l)::BIGINT AS n_lines, len(list_filter(list_transform(l, lambda x: {_s_form("x")}), lambda t: length(t) < 3 OR len(list_filter(list_transform(c, lambda y: {_s_form("y")}), lambda z: contains(z, t) OR (length(t) > 15 AND contains(z, substr(t, 1, 40))))) > 0))::BIGINT AS covered FROM ({_PAGED})"""
_BAND = "CASE WHEN {0} >= 95 THEN 'good' WHEN {0} >= 50 THEN 'fair' ELSE 'poor' END"


def covered_pages(spark, sf_dir) -> DataFrame:
    """Five lines make a page; its chunks are its packed sentences. Lines and chunks stay in the page's row."""
    d = docs(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("v"))
    page = lambda i: F.struct((i / 5 + 1).cast("long").alias("page_number"), F.slice("v", i + 1, F.lit(5)).alias("l"))
    rows = d.select("doc_id", F.inline(F.transform(F.sequence(F.lit(0), F.size("v") - 1, F.lit(5)), page)))
    chunks = rows.withColumn("s", T.sentences(F.array_join("l", "\n"))).withColumn("c", folds.packed(F.col("s"), " "))
    return chunks.select("doc_id", "page_number", F.size("l").cast("long").alias("n_lines"), T.covered_lines(F.col("l"), F.col("c")).cast("long").alias("covered"))


def band(percent):
    return F.when(percent >= 95, "good").when(percent >= 50, "fair").otherwise("poor")


@query(f"SELECT *, round(100.0 * covered / n_lines, 4) AS percent, {_BAND.format('100.0 * covered / n_lines')} AS band FROM ({_COVERED})")
def line_coverage(spark, sf_dir):
    p = F.col("covered") * 100.0 / F.col("n_lines")
    return covered_pages(spark, sf_dir).select("*", F.round(p, 4).alias("percent"), band(p).alias("band"))


@query(
    f"""SELECT doc_id, count(*)::BIGINT AS pages, sum(n_lines)::BIGINT AS lines, sum(covered)::BIGINT AS matched, round(100.0 * sum(covered) / sum(n_lines), 4) AS percent, count(*) FILTER (covered < n_lines)::BIGINT AS pages_with_gaps, count(*) FILTER (covered = 0)::BIGINT AS zero_pages,
    {_BAND.format('100.0 * sum(covered) / sum(n_lines)')} AS band FROM ({_COVERED}) GROUP BY doc_id"""
)
def coverage_overall(spark, sf_dir):
    p = F.sum("covered") * 100.0 / F.sum("n_lines")
    return covered_pages(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("n_lines").alias("lines"), F.sum("covered").alias("matched"), F.round(p, 4).alias("percent"),
        F.count_if(F.col("covered") < F.col("n_lines")).alias("pages_with_gaps"), F.count_if(F.col("covered") == 0).alias("zero_pages"), band(p).alias("band"),
    )


@query()
def highlight_phrases(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.highlight_terms("show the there and erent words", F.concat(F.lit("[Section: x] "), "text")), "|").alias("terms"))


@query("SELECT page_id, substr(md5(url), 1, 12) || '_p' || page_id % 7 || '_d' || CASE WHEN page_id % 2 = 0 THEN 150 ELSE 200 END AS image FROM pages")
def image_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.image_key(F.col("url"), F.col("page_id") % 7, F.when(F.col("page_id") % 2 == 0, 150).otherwise(200)).alias("image"))
