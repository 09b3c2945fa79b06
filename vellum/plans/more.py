"""Queries on the smaller operators: page deduplication, per-document ranking, prompts, boxes, statistics, sheets, retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import sheets
from ..sources.tables import table
from ..streaming.events import retry_decision, retry_wait
from .retrieval import _COS, asked_vectors, vectors
from .text import S_CHUNKS, chunk_rows, docs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_RANKED = "SELECT query_id, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, v.label, {0} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)".replace("{0}", _COS)


@query(f"SELECT query_id, vec_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label, vec_id % 3 ORDER BY rank) AS r FROM ({_RANKED}) WHERE rank <= 15) WHERE r = 1) WHERE place <= 5")
def page_dedupe(spark, sf_dir):
    hits = R.vector_topk(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), "vec_id", 15).join(vectors(spark, sf_dir).select("vec_id", F.col("label").alias("document_key")), "vec_id")
    return R.first_of_each_page(hits.withColumn("page_number", F.col("vec_id") % 3), 5).select("query_id", "vec_id", "place")


@query(f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, {_COS} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, label, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 2) WHERE rank <= 6")
def per_document_topk(spark, sf_dir):
    return R.vector_topk(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), "vec_id", 6, group="label", each=2).select("query_id", "vec_id", "label", "score", "rank")


@query("SELECT doc_id // 10 AS query_id, string_agg('--- PAGE ' || doc_id % 10 || ' ---' || chr(10) || text, chr(10)||chr(10) ORDER BY doc_id) AS prompt FROM documents GROUP BY doc_id // 10")
def prompt_text(spark, sf_dir):
    items = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).alias("query_id"), F.col("doc_id").alias("item"), (F.col("doc_id") % 10).alias("page_number"), "text")
    return R.prompt_text(items)


@query("SELECT doc_id, n::BIGINT AS line_number, length(line)::DOUBLE AS x1 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) WHERE n % 2 = 0")
def highlight_boxes(spark, sf_dir):
    line = lambda x, i: F.struct((i + 1).cast("long").alias("line_number"), F.when(i % 2 == 1, F.struct(F.lit(0.0).alias("x0"), F.length(x).cast("double").alias("x1"))).alias("bbox"))
    passages = F.array(F.struct(F.transform(F.split("text", "\n", -1), line).alias("lines")))
    boxes = docs(spark, sf_dir).select("doc_id", F.explode(R.highlight_boxes(passages)).alias("b"))
    return boxes.select("doc_id", "b.line_number", F.col("b.bbox.x1").alias("x1"))


@query(f"SELECT count(*)::BIGINT AS total, count(*) FILTER (pos = 1)::BIGINT AS parents, count(*) FILTER (pos > 1)::BIGINT AS children, count(DISTINCT doc_id)::BIGINT AS documents FROM ({S_CHUNKS})")
def chunk_stats(spark, sf_dir):
    c = chunk_rows(spark, sf_dir).select(F.col("doc_id").alias("document_key"), F.when(F.col("pos") == 1, "parent").otherwise("child").alias("chunk_type"))
    return R.chunk_stats(c)


@query("SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 409 WHEN event_id % 3 = 0 THEN 404 WHEN event_id % 4 >= 3 THEN 429 ELSE 202 END AS answer, CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 180 WHEN 2 THEN 540 END AS wait FROM events")
def retry_requests(spark, sf_dir):
    i = F.col("event_id")
    state = F.when(i % 5 == 0, "STARTED").when(i % 5 == 1, "RETRY").when(i % 5 == 2, "SUCCESS").otherwise("FAILURE")
    tries = (i % 4).cast("int")
    return table(spark, sf_dir, "events").select("event_id", retry_decision(state, i % 3 != 0, F.lit(True), tries).alias("answer"), retry_wait(tries).alias("wait"))


@query("SELECT doc_id, 1::BIGINT AS page_number, len(l) > 6 OR len(list_filter(l, lambda x: length(x) < 30)) > 5 AS needs_refinement FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def sheet_refinement(spark, sf_dir):
    s = docs(spark, sf_dir).select(F.col("doc_id").alias("document_key"), F.lit(1).cast("long").alias("page_number"), F.posexplode(F.split("text", "\n", -1)).alias("p", "content"))
    every = s.withColumn("level", F.lit(1)).withColumn("section_type", F.lit("text")).unionAll(s.withColumn("level", F.lit(3)).withColumn("section_type", F.lit("text")))
    return sheets.needs_refinement(every.select("document_key", "page_number", "level", "section_type", "content")).withColumnRenamed("document_key", "doc_id")


@query("SELECT p_partkey, r::INT AS row_index, c::INT AS c, ['name', 'name_1', 'col_2'][c+1] AS name, CASE c WHEN 0 THEN p_name WHEN 1 THEN CASE r WHEN 0 THEN p_brand ELSE '' END ELSE CASE r WHEN 0 THEN p_size::VARCHAR ELSE '' END END AS v FROM part, (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1, 2]) AS c)")
def markdown_cells(spark, sf_dir):
    row = F.concat(F.lit("| Name | name |  |\n|---|:-:|---|\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n| "), "p_name", F.lit(" |"))
    return sheets.markdown_cells(table(spark, sf_dir, "part").select("p_partkey", row.alias("markdown")))


@query("SELECT n_name AS sheet, r::INT AS r, c::INT AS c, n_name || (r + 2) || c AS v FROM nation, (SELECT unnest(range(0, 8)) AS r), (SELECT unnest([0, 1, 2]) AS c)")
def legacy_sheet(spark, sf_dir):
    """Two title rows of one value and a nearly empty column go."""
    n = table(spark, sf_dir, "nation")
    grid = n.select(F.lit("book").alias("document_key"), F.col("n_name").alias("sheet"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("r"), "n_name").select("*", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 5)])).alias("c"))
    shown = grid.where("r >= 2 AND c < 5 OR r < 2 AND c = 0 OR r = 4 AND c = 5")
    cells = shown.select("document_key", "sheet", "r", "c", F.concat("n_name", F.col("r").cast("string"), F.col("c").cast("string")).alias("v"), F.lit("s").alias("v_type"), F.lit(False).alias("bold"))
    return sheets.legacy_cells(cells).select("sheet", "r", "c", "v")
