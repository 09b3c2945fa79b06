"""Queries on chunks and vectors: links, quality, ranking, fusion, related documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.stemming import stem_words
from ..operators import folds
from ..operators import retrieval as R
from ..sources.tables import table
from .text import S_CHUNKS, chunk_rows, docs, s_norm, s_strip

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def asked_vectors(spark, sf_dir) -> DataFrame:
    """Every row whose id is divisible by 20 asks."""
    return vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


_COS = "round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM ({0})) WHERE rank <= {1}"


@query(_TOP.format(f"SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0", 50))
def vector_topk(spark, sf_dir):
    return R.vector_topk(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), "vec_id", 50).select("query_id", "vec_id", "score", "rank")


@query(_TOP.format(f"SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.label <> q.label", 5))
def cross_doc_chunks(spark, sf_dir):
    return R.vector_topk(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), "vec_id", 5, unlike=("label", "q_label")).select("query_id", "vec_id", "score", "rank")


_MEAN = "SELECT label, list(m ORDER BY i) AS embedding FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"


@query(f"SELECT label, i::INT AS i, round(embedding[i], 6) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM ({_MEAN}))")
def doc_mean_vector(spark, sf_dir):
    m = R.mean_vectors(vectors(spark, sf_dir), "label")
    return m.select("label", F.posexplode("embedding").alias("p", "x")).select("label", (F.col("p") + 1).alias("i"), F.round("x", 6).alias("m"))


def _similar(spark, sf_dir, least: float = -2.0) -> DataFrame:
    m = R.mean_vectors(vectors(spark, sf_dir), "label").select("label", "embedding")
    q = m.select(F.col("label").alias("query_id"), F.col("embedding").alias("q"))
    return R.vector_topk(m, q, "label", 5, unlike=("label", "query_id")).where(F.col("score") >= least)


_SIMILAR = f"WITH m AS ({_MEAN}) SELECT * FROM (SELECT query_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label)::INT AS rank FROM (SELECT q.label AS query_id, v.label, {_COS} AS score FROM m v, m q WHERE v.label <> q.label)) WHERE rank <= 5"


@query(_SIMILAR)
def similar_docs(spark, sf_dir):
    return _similar(spark, sf_dir).select("query_id", "label", "score", "rank")


#: Related documents are at least so similar.
RELATED = 0.3


@query(
    f"""WITH m AS ({_MEAN}), s AS ({_SIMILAR}), c AS (SELECT * FROM (SELECT q.label AS query_id, v.label, v.vec_id, {_COS} AS near, row_number() OVER (PARTITION BY q.label ORDER BY {_COS} DESC, v.vec_id) AS r FROM embeddings v, m q WHERE v.label <> q.label) WHERE r <= 5),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY r) AS k FROM c)
    SELECT s.query_id, s.label, round_even(s.score, 3) AS score, n.vec_id, round_even(n.near, 3) AS near, substr(d.text, 1, 200) AS preview FROM s LEFT JOIN n ON n.query_id = s.query_id AND n.label = s.label AND n.k <= 3 LEFT JOIN documents d ON d.doc_id = n.vec_id WHERE s.score >= {RELATED}"""
)
def nudge(spark, sf_dir):
    """Related documents with those of the five best passages of all documents that are theirs, three at most, and a preview of them."""
    m = R.mean_vectors(vectors(spark, sf_dir), "label").select(F.col("label").alias("query_id"), F.col("embedding").alias("q"))
    hits = R.vector_topk(vectors(spark, sf_dir), m, "vec_id", 5, unlike=("label", "query_id"))
    previews = docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 200).alias("preview"))
    labelled = hits.join(vectors(spark, sf_dir).select("vec_id", "label"), "vec_id").join(previews, "vec_id", "left")
    order = Window.partitionBy("query_id", "label").orderBy("rank")
    n = labelled.withColumn("k", F.row_number().over(order)).where("k <= 3").select("query_id", "label", "vec_id", F.bround("score", 3).alias("near"), "preview")
    return _similar(spark, sf_dir, RELATED).withColumn("score", F.bround("score", 3)).join(n, ["query_id", "label"], "left").select("query_id", "label", "score", "vec_id", "near", "preview")


_WORDS = f"list_filter(string_split({s_strip("regexp_replace(lower({0}), '\\s+', ' ', 'g')")}, ' '), lambda w: w <> '')"


def s_words(x: str) -> str:
    return _WORDS.replace("{0}", x)


_PLACES = f"SELECT doc_id, len(w) AS dl, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM (SELECT doc_id, {s_words('text')} AS w FROM documents)"
_INDEX = f"SELECT doc_id, dl, term, count(*) AS tf FROM ({_PLACES}) GROUP BY ALL"
_ASKED = f"SELECT DISTINCT item_id AS query_id, unnest({s_words('text')}) AS term FROM benchmark"
#: All covers by their definition: for each occurrence, the least of the terms' latest places; the first end of each such start.
_KEYWORD = f"""SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
    WITH q AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS need FROM ({_ASKED})), o AS (SELECT q.query_id, q.need, i.doc_id, i.term, i.p FROM ({_PLACES}) i JOIN q USING (term)),
    h AS (SELECT query_id, doc_id FROM o GROUP BY query_id, doc_id, need HAVING count(DISTINCT term) = need), k AS (SELECT o.* FROM o SEMI JOIN h USING (query_id, doc_id)),
    l AS (SELECT x.query_id, x.doc_id, x.need, x.p, y.term, max(y.p) AS latest FROM k x JOIN k y ON x.query_id = y.query_id AND x.doc_id = y.doc_id AND y.p <= x.p GROUP BY ALL),
    c AS (SELECT query_id, doc_id, b, min(p) AS e FROM (SELECT query_id, doc_id, p, min(latest) AS b FROM l GROUP BY query_id, doc_id, need, p HAVING count(*) = need) GROUP BY ALL),
    n AS (SELECT c.query_id, c.doc_id, c.b, c.e, count(*) AS held FROM c JOIN k ON k.query_id = c.query_id AND k.doc_id = c.doc_id AND k.p BETWEEN c.b AND c.e GROUP BY ALL)
    SELECT query_id, doc_id, round(sum(0.1::DOUBLE / (1 + (e - b) - (held - 1))), 6) AS score FROM n GROUP BY ALL)) WHERE rank <= 50"""


def _asked(spark, sf_dir) -> DataFrame:
    """All words of all benchmark items."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.explode(T.words(F.col("text"))).alias("term")).distinct()


def _keyword(spark, sf_dir) -> DataFrame:
    return R.keyword_topk(docs(spark, sf_dir), _asked(spark, sf_dir), "doc_id", T.words(F.col("text")), 50)


@query(_KEYWORD)
def keyword_search(spark, sf_dir):
    return _keyword(spark, sf_dir).select("query_id", "doc_id", "score", "rank")


@query()
def keyword_search_english(spark, sf_dir):
    """As the store's full text search: stop words drop out, the rest is stemmed, on both sides; places count all words."""
    lexemes = lambda df: df.withColumn("w", stem_words(T.words(F.col("text"))))
    asked = lexemes(table(spark, sf_dir, "benchmark")).select(F.col("item_id").alias("query_id"), F.explode("w").alias("term")).where("term <> ''").distinct()
    return R.keyword_topk(lexemes(docs(spark, sf_dir)), asked, "doc_id", F.col("w"), 50).select("query_id", "doc_id", "score", "rank")


@query(
    f"""WITH i AS ({_INDEX}), q AS ({_ASKED}), t AS (SELECT count(*) AS n, avg(len({s_words('text')})) AS mean FROM documents),
    f AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, mean FROM (SELECT term, count(*)::DOUBLE AS df FROM i GROUP BY term), t), w AS (SELECT term, mean, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM f) ELSE raw END AS idf FROM f)
    SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM i JOIN q USING (term) JOIN w USING (term) GROUP BY ALL) WHERE score > 0) WHERE rank <= 50"""
)
def bm25_search(spark, sf_dir):
    return R.bm25_topk(docs(spark, sf_dir), _asked(spark, sf_dir), "doc_id", T.words(F.col("text")), 50).select("query_id", "doc_id", "score", "rank")


_VEC = f"SELECT query_id, vec_id AS doc_id, rank FROM ({_TOP.format(f'SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings v, embeddings q SEMI JOIN benchmark b ON b.item_id = q.vec_id', 50)})"
_FUSED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank_0 NULLS LAST, rank_1 NULLS LAST, doc_id)::INT AS rank FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, min(CASE WHEN l = 0 THEN r END) AS rank_0, min(CASE WHEN l = 1 THEN r END) AS rank_1
    FROM (SELECT query_id, doc_id, rank AS r, 0 AS l FROM ({_VEC}) UNION ALL SELECT query_id, doc_id, rank, 1 FROM ({_KEYWORD})) GROUP BY ALL)"""


def _fused(spark, sf_dir) -> DataFrame:
    """Each benchmark item asks, with its words and with the vector of its number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    q = vectors(spark, sf_dir).join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    v = R.vector_topk(vectors(spark, sf_dir), q, "vec_id", 50).withColumnRenamed("vec_id", "doc_id")
    return R.fused([v, _keyword(spark, sf_dir)], "doc_id")


@query(f"SELECT query_id, doc_id, score, rank FROM ({_FUSED})")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "doc_id", "score", "rank")


@query(
    f"""WITH h AS (SELECT query_id, doc_id, score, rank, (doc_id % 7)::BIGINT AS page_number, 'k' || doc_id % 3 AS document_key, (doc_id % 50)::BIGINT AS start, (doc_id % 50 + 10)::BIGINT AS stop FROM ({_FUSED}) WHERE rank <= 20 AND doc_id % 7 <> 0),
    g AS (SELECT query_id, document_key, page_number, list({{'rank': rank, 'id': doc_id, 'start': start, 'stop': stop}} ORDER BY rank) AS v, max(score) AS page_score, min(rank) AS best FROM h GROUP BY ALL),
    k AS (SELECT *, list_reduce(v[2:], lambda a, x: CASE WHEN len(a) < 3 AND len(list_filter(a, lambda y: y.start <= x.stop AND y.stop >= x.start)) = 0 THEN list_append(a, x) ELSE a END, [v[1]]) AS kept FROM g),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_score DESC, best)::INT AS page_rank FROM k)
    SELECT query_id, page_rank, document_key, page_number, page_score, array_to_string(list_transform(kept, lambda x: x.id), ',') AS passages FROM p WHERE page_rank <= 5"""
)
def hybrid_pages(spark, sf_dir):
    hits = _fused(spark, sf_dir).select("query_id", F.col("doc_id").alias("id"), "score", "rank", (F.col("doc_id") % 7).alias("page_number"), F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string")).alias("document_key"), (F.col("doc_id") % 50).alias("start"), (F.col("doc_id") % 50 + 10).alias("stop"))
    p = R.pages(hits)
    return p.select("query_id", "page_rank", "document_key", "page_number", "page_score", F.array_join(F.transform("passages", lambda x: x["id"].cast("string")), ",").alias("passages"))


_PARENTS = f"SELECT doc_id, 'upload:doc' || doc_id || ':p1_s0' AS parent_id, {s_norm('text')} AS content FROM documents"
_CHILDREN = f"SELECT doc_id, pos, 'upload:doc' || doc_id || ':p1_s0' AS parent_id, chunk FROM ({S_CHUNKS})"


def _parents(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.concat(F.lit("upload:doc"), F.col("doc_id").cast("string"), F.lit(":p1_s0")).alias("parent_id"), T.normalize(F.col("text")).alias("content"))


def _children(spark, sf_dir) -> DataFrame:
    return chunk_rows(spark, sf_dir).withColumn("parent_id", F.concat(F.lit("upload:doc"), F.col("doc_id").cast("string"), F.lit(":p1_s0")))


@query(f"SELECT c.doc_id, c.pos, p.content IS NOT NULL AS has_parent, length(coalesce(p.content, c.chunk))::BIGINT AS context_length FROM ({_CHILDREN}) c LEFT JOIN ({_PARENTS}) p USING (parent_id)")
def parent_child_link(spark, sf_dir):
    j = R.with_parents(_children(spark, sf_dir), _parents(spark, sf_dir))
    return j.select("doc_id", "pos", F.col("parent_text").isNotNull().alias("has_parent"), F.length(F.coalesce("parent_text", "chunk")).cast("long").alias("context_length"))


@query(f"SELECT doc_id, content FROM ({_PARENTS}) p WHERE length(content) >= 90 AND NOT EXISTS (SELECT 1 FROM ({_CHILDREN}) c WHERE c.parent_id = p.parent_id AND c.pos > 1)")
def fallback_child(spark, sf_dir):
    """Parents without further children give their whole body as a child."""
    return _parents(spark, sf_dir).join(_children(spark, sf_dir).where("pos > 1"), "parent_id", "left_anti").where(F.length("content") >= 90).select("doc_id", "content")


def _collapse(x: str) -> str:
    return s_strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


_RATIO = f"SELECT doc_id, pos, CASE WHEN a = '' OR b = '' OR a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE 0.0::DOUBLE END AS ratio FROM (SELECT c.doc_id, c.pos, {_collapse('p.content')} AS a, {_collapse('c.chunk')} AS b FROM ({_CHILDREN}) c JOIN ({_PARENTS}) p USING (parent_id))"


def _ratios(spark, sf_dir) -> DataFrame:
    """doc_id, ratios of its children by place: parent and children are of one row, so nothing is joined."""
    d = docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("content"), folds.packed(T.sentences(F.col("text")), " ").alias("children"))
    return d.select("doc_id", T.duplicate_ratios(F.col("content"), F.col("children")).alias("ratios"))


@query(f"SELECT doc_id, pos, round(ratio, 6) AS ratio FROM ({_RATIO})")
def child_duplicate_ratio(spark, sf_dir):
    return _ratios(spark, sf_dir).select("doc_id", F.posexplode("ratios").alias("p", "ratio")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.round("ratio", 6).alias("ratio"))


@query(f"SELECT doc_id, count(*)::BIGINT AS children, count(*) FILTER (ratio >= 0.9)::BIGINT AS duplicates, CASE WHEN count(*) FILTER (ratio >= 0.9) <= 1 AND count(*) <= 20 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({_RATIO}) GROUP BY doc_id")
def chunk_quality(spark, sf_dir):
    dup = F.size(F.filter("ratios", lambda r: r >= 0.9)).cast("long")
    n = F.size("ratios").cast("long")
    return _ratios(spark, sf_dir).where(n > 0).select("doc_id", n.alias("children"), dup.alias("duplicates"), F.when((dup <= 1) & (n <= 20), "PASS").otherwise("FAIL").alias("verdict"))


@query(f"SELECT d.source, count(*)::BIGINT AS chunks, count(*) FILTER (c.pos = 1)::BIGINT AS firsts, min(c.doc_id) AS least, max(c.pos)::BIGINT AS most, count(DISTINCT c.doc_id)::BIGINT AS documents FROM ({S_CHUNKS}) c JOIN documents d USING (doc_id) GROUP BY d.source")
def chunk_inventory(spark, sf_dir):
    j = chunk_rows(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.col("pos") == 1).alias("firsts"), F.min("doc_id").alias("least"), F.max("pos").alias("most"), F.countDistinct("doc_id").alias("documents"))


@query(f"SELECT lang, doc_id, pos, chunk FROM (SELECT d.lang, c.doc_id, c.pos, c.chunk, row_number() OVER (PARTITION BY d.lang ORDER BY c.doc_id, c.pos) AS r FROM ({S_CHUNKS}) c JOIN documents d USING (doc_id)) WHERE r <= 40")
def topn_per_type(spark, sf_dir):
    j = chunk_rows(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    order = Window.partitionBy("lang").orderBy("doc_id", "pos")
    return j.withColumn("r", F.row_number().over(order)).where("r <= 40").select("lang", "doc_id", "pos", "chunk")


@query(
    """WITH r AS (SELECT doc_id // 50 AS query_id, (doc_id % 50) // 4 + 1 AS page_rank, doc_id % 4 AS passage_rank, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'p' || doc_id % 3 END AS parent_id, doc_id FROM documents),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(parent_id, page_rank || '~' || passage_rank) ORDER BY page_rank, passage_rank) AS again FROM r WHERE page_rank <= 3) WHERE again = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_rank, passage_rank) AS item FROM f), o AS (SELECT *, min(item) OVER (PARTITION BY query_id, page_rank) - 1 AS opened FROM n)
    SELECT query_id::BIGINT AS query_id, item::INT AS item, doc_id FROM o WHERE opened < 3 AND item <= 5"""
)
def context_assembly(spark, sf_dir):
    i = F.col("doc_id")
    rows = docs(spark, sf_dir).select(F.floor(i / 50).alias("query_id"), (F.floor((i % 50) / 4) + 1).alias("page_rank"), (i % 4).alias("passage_rank"), F.when(i % 6 != 0, F.concat(F.lit("p"), (i % 3).cast("string"))).alias("parent_id"), "doc_id")
    return R.assembled(rows).select("query_id", "item", "doc_id")
