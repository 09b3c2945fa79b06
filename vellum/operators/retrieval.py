"""Ranking: vectors, keywords, fusion, pages, related documents and context assembly.

Vector queries go to the rows in blocks of a bounded number, each a matrix; a task multiplies it with its rows and keeps
the best of each query. Terms of queries are joined to the collection before its occurrences are counted or shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from .folds import budgeted, greedy_lines

#: Vector queries of one block, and terms of queries that may be broadcast; more terms go by a shuffled join.
QUERY_BLOCK, BROADCAST_TERMS = 4096, 500_000
#: Scores that a task holds at once (8 MB), and found pairs beyond which it keeps only the best.
SCORES, PAIRS = 1 << 20, 1 << 19


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, each of length one (or zero, if it has no length)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _places(*keys: np.ndarray) -> np.ndarray:
    """Each row's place, from 0, among the rows before it that have the same keys; rows are sorted by the keys."""
    first = np.ones(len(keys[0]), dtype=bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.arange(len(first))
    return at - np.maximum.accumulate(np.where(first, at, 0))


class _Best:
    """The best k rows of each query so far, of each group `each` at most. Ties go to the lesser id. What is held doesn't grow with the rows."""

    def __init__(self, queries: int, k: int, each: int | None):
        self.k, self.each, self.parts, self.held = k, each, [], 0
        self.most = max(PAIRS, 2 * queries * k)
        self.least, self.last = np.full(queries, -np.inf), None  # score and id of each query's k-th row

    def add(self, scores: np.ndarray, ids: pa.Array, groups: pa.Array | None) -> None:
        if self.each is None and len(ids) >= self.k:  # the k-th best score of these rows alone
            floor = np.maximum(self.least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        else:
            floor = self.least
        q, d = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        if self.last is not None:  # of rows as good as the k-th only those with a lesser id
            tied = np.nonzero(scores[q, d] == self.least[q])[0]
            lost = pc.greater(ids.take(pa.array(d[tied])), self.last.take(pa.array(q[tied])))
            q, d = (np.delete(x, tied[pc.fill_null(lost, False).to_numpy(zero_copy_only=False)]) for x in (q, d))
        if len(q):
            self.parts.append(pa.table({"q": q, "score": scores[q, d], "id": ids.take(pa.array(d))} | ({"group": groups.take(pa.array(d))} if groups is not None else {})))
            self.held += len(q)
        if self.held > self.most:
            self.best()

    def best(self) -> pa.Table | None:
        if not self.parts:
            return None
        t = pa.concat_tables(self.parts)
        order = [("q", "ascending"), ("score", "descending"), ("id", "ascending")]
        if self.each is not None:
            # A null group's rows have one number, as in a window.
            codes = pc.dictionary_encode(t["group"].combine_chunks(), null_encoding="encode").indices
            t = t.append_column("code", codes).sort_by([order[0], ("code", "ascending"), *order[1:]])
            t = t.filter(pa.array(_places(t["q"].to_numpy(), t["code"].to_numpy()) < self.each)).drop_columns("code")
        t = t.sort_by(order)
        at = _places(t["q"].to_numpy())
        full = np.nonzero(at == self.k - 1)[0]
        last = np.full(len(self.least), -1)
        last[t["q"].to_numpy()[full]] = full
        self.least[last >= 0] = t["score"].to_numpy()[last[last >= 0]]
        self.last = t["id"].combine_chunks().take(pa.array(last, mask=last < 0))
        t = t.filter(pa.array(at < self.k)).combine_chunks()
        self.parts, self.held = [t], t.num_rows
        return t


def vector_topk(rows: DataFrame, queries: DataFrame, id_col: str, k: int = 50, unlike: tuple[str, str] | None = None, digits: int = 6, group: str | None = None, each: int | None = None) -> DataFrame:
    """rows (id, embedding), queries (query_id, q) -> query_id, id, score (cosine), rank. Ties go to the lesser id.

    unlike: a column of the rows and one of the queries that must differ (nulls differ from nothing). group, each: at most `each` rows of every value
    of the rows' column `group` are ranked, and the column comes out. Null embeddings are left out; vectors have one length."""
    spark = rows.sparkSession
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), id_col: rows.schema[id_col].dataType.simpleString()} | ({group: rows.schema[group].dataType.simpleString()} if group else {})
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", score double"
    own = [id_col, "embedding", *dict.fromkeys(c for c in ((unlike or [None])[0], group) if c and c != id_col)]
    asked = queries.where("q IS NOT NULL").select("query_id", "q", *([F.col(unlike[1]).alias("unlike")] if unlike else []))
    if unlike:
        asked = asked.withColumn("unlike", F.col("unlike").cast(rows.schema[unlike[0]].dataType)).where("unlike IS NOT NULL")
        rows = rows.where(F.col(unlike[0]).isNotNull())
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for block in range(parts):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == block).toArrow()
        if not len(held):
            continue
        named = pc.dictionary_encode(held["unlike"].combine_chunks()) if unlike else None
        sent = spark.sparkContext.broadcast((held["query_id"].combine_chunks(), _matrix(held["q"]), named))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix, named = sent.value
            best, step = _Best(len(ids), k, each), max(1, SCORES // len(ids))
            for whole in batches:
                for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                    scores = np.round(matrix @ _matrix(batch.column("embedding")).T, digits)
                    scores[np.isnan(scores)] = -np.inf
                    if unlike:
                        other = pc.fill_null(pc.index_in(batch.column(unlike[0]), named.dictionary), -1).to_numpy(zero_copy_only=False)
                        scores[named.indices.to_numpy()[:, None] == other[None, :]] = -np.inf
                    best.add(scores, batch.column(id_col), batch.column(group) if group else None)
            made = best.best()
            for part in made.to_batches(max_chunksize=1 << 16) if made else ():
                yield pa.RecordBatch.from_arrays([ids.take(part.column("q")), part.column("id"), *([part.column("group")] if group else []), part.column("score")], names=[*kinds, "score"])

        part = rows.where("embedding IS NOT NULL").select(*own).mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = [F.desc("score"), F.col(id_col)]
    if each is not None:
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", group).orderBy(*best))).where(F.col("r") <= each).drop("r")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)


def mean_vectors(rows: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """The mean vector of each key (not normalised), with the number of rows."""
    parts = rows.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"), F.max("n").alias("n"))


def asked_only(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows whose term some query asks for. The asked terms are broadcast if they are few, which is counted first."""
    asked = queries.select("term").distinct()
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return rows.join(F.broadcast(asked) if few else asked, "term", "left_semi")


def cover_density(places: Column, need: Column) -> Column:
    """Cover density rank at weight 0.1. A cover is a shortest extent that holds all `need` terms; it adds 0.1 / (1 + words in it
    that aren't the terms), so a single term adds 0.1 for each occurrence. places: array of struct(p, t), t the terms' numbers from 0."""
    start = F.struct(F.array_repeat(F.lit(0), need.cast("int")).alias("last"), F.lit(0).alias("begin"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"))

    def summed(ordered: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            i = s["i"] + 1
            last = F.transform(s["last"], lambda v, t: F.when(t == x["t"], i).otherwise(v))  # each term's latest occurrence
            begin = F.array_min(last)
            noise = x["p"] - F.element_at(ordered, F.greatest(begin, F.lit(1)))["p"] - (i - begin)
            new = begin > s["begin"]
            return F.struct(last.alias("last"), F.greatest(begin, s["begin"]).alias("begin"), (s["sum"] + F.when(new, F.lit(0.1) / (noise + 1)).otherwise(0.0)).alias("sum"), i.alias("i"))

        return F.aggregate(ordered, start, step, lambda s: s["sum"])

    return let(F.array_sort(places), summed)


def keyword_topk(rows: DataFrame, queries: DataFrame, id_col: str, words: Column, k: int = 50) -> DataFrame:
    """Rows that hold every term of a query, ranked by cover density. queries: query_id, term (distinct).

    What holds all terms holds the rarest, so only rows with that one are read further; their places are found in the row."""
    w = rows.select(id_col, words.alias("w"))
    asked = queries.groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    held = asked_only(w.select(id_col, F.explode(F.array_distinct("w")).alias("term")), queries)
    df = held.groupBy("term").agg(F.count("*").alias("n"))
    rare = queries.join(df, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("term"))
    likely = held.join(rare, "term").select("query_id", id_col)
    both = likely.join(asked, "query_id").join(w, id_col).where(F.size(F.array_intersect("w", "terms")) == F.size("terms"))
    places = F.filter(F.transform("w", lambda x, i: F.struct((i + 1).alias("p"), (F.array_position("terms", x) - 1).alias("t"))), lambda x: x["t"] >= 0)
    scored = both.select("query_id", id_col, F.round(cover_density(places, F.size("terms")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_topk(rows: DataFrame, queries: DataFrame, id_col: str, words: Column, k: int = 50, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi BM25. A negative idf becomes a quarter of the mean idf of all terms. queries: query_id, term (distinct)."""
    w = rows.select(id_col, words.alias("w"))
    # One pass counts each term's documents and, under a null term, all documents and their words.
    marked = F.concat(F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("dl"))), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("w").alias("dl"))))
    stats = w.select(F.inline(marked)).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("words"))
    total = stats.where("term IS NULL").select(F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("mean"))
    df = stats.where("term IS NOT NULL").select("term", "df")
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # The mean idf is over few rows: terms with one frequency have one idf.
    floor = df.groupBy("df").count().crossJoin(F.broadcast(total)).agg((F.sum(raw * F.col("count")) / F.sum("count") * 0.25).alias("floor"))
    weights = asked_only(df, queries).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(floor)).select("term", "mean", F.when(raw < 0, F.col("floor")).otherwise(raw).alias("idf"))
    posted = asked_only(w.select(id_col, F.size("w").alias("dl"), F.explode("w").alias("term")), queries).groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    scored = posted.join(queries.join(weights, "term"), "term").groupBy("query_id", id_col).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fused(lists: list[DataFrame], id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank from 1). Ties: better first list, then second, then id."""
    tagged = [x.select("query_id", id_col, F.col("rank").alias("r"), F.lit(i).alias("list")) for i, x in enumerate(lists)]
    every = tagged[0]
    for x in tagged[1:]:
        every = every.unionByName(x)
    ranks = [F.min(F.when(F.col("list") == i, F.col("r"))).alias(f"rank_{i}") for i in range(len(lists))]
    made = every.groupBy("query_id", id_col).agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score"), *ranks)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *[F.col(f"rank_{i}").asc_nulls_last() for i in range(len(lists))], id_col)
    return made.withColumn("rank", F.row_number().over(order))


def reranked(hits: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], query: str, text: str, first: int = 15) -> DataFrame:
    """The best `first` by an injected scorer, then the others as they were; `tier` keeps the two scales apart."""
    udf = F.pandas_udf(score, "double")
    head = F.col("rank") <= first
    marked = hits.withColumn("tier", F.when(head, 0).otherwise(1)).withColumn("again", F.when(F.col("tier") == 0, udf(query, text)))
    order = Window.partitionBy("query_id").orderBy("tier", F.desc_nulls_last("again"), "rank")
    return marked.withColumn("rank", F.row_number().over(order))


def pages(hits: DataFrame, pool: int = 20, top: int = 5, per_page: int = 3) -> DataFrame:
    """hits: query_id, document_key, page_number, id, start, stop, score, rank -> pages with their passages.

    Of the best `pool`, page 0 drops out; a page keeps at most three passages whose lines don't overlap."""
    h = hits.where((F.col("rank") <= pool) & (F.col("page_number") != 0))
    g = h.groupBy("query_id", "document_key", "page_number").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "start", "stop", "score"))).alias("hits"), F.max("score").alias("page_score"), F.min("rank").alias("best"))
    kept = g.withColumn("passages", greedy_lines(F.col("hits"), per_page))
    order = Window.partitionBy("query_id").orderBy(F.desc("page_score"), "best")
    return kept.withColumn("page_rank", F.row_number().over(order)).where(F.col("page_rank") <= top).drop("hits", "best")


def with_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Left join: table chunks point at parents that don't exist."""
    return children.join(parents.select("parent_id", F.col("content").alias("parent_text")), "parent_id", "left")


def assembled(results: DataFrame, results_cap: int = 3, outer: int = 3, inner: int = 5) -> DataFrame:
    """Context items of the best results, one for each parent (null parents count each time). A result is opened while
    fewer than `outer` items are held, and may then go on to `inner` in all. results: query_id, page_rank, passage_rank, parent_id, text."""
    by = Window.partitionBy("query_id", F.coalesce("parent_id", F.concat_ws("~", F.col("page_rank").cast("string"), F.col("passage_rank").cast("string")))).orderBy("page_rank", "passage_rank")
    first = results.where(F.col("page_rank") <= results_cap).withColumn("again", F.row_number().over(by)).where("again = 1")
    upto = Window.partitionBy("query_id").orderBy("page_rank", "passage_rank")
    n = first.withColumn("item", F.row_number().over(upto))
    before = n.withColumn("opened_at", F.min("item").over(Window.partitionBy("query_id", "page_rank")) - 1)
    return before.where((F.col("opened_at") < outer) & (F.col("item") <= inner)).drop("again", "opened_at")


def budget_by_group(rows: DataFrame, batch: str, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Each group's texts, in order, until one would exceed what the batch has left; then the next group goes on.

    Texts that a group's own sum already puts beyond the budget are dropped first, so what is collected is bounded."""
    # Each text that isn't empty takes a character at least, so a group's first `budget` of them are enough: a rank that Spark
    # limits in each task before anything is exchanged, however many rows a group has.
    first = Window.partitionBy(batch, group).orderBy(F.length(text) == 0, order)
    few = rows.where(F.col(text).isNotNull()).withColumn("r", F.row_number().over(first)).where(F.col("r") <= budget).drop("r")
    sums = few.withColumn("sum", F.sum(F.length(text)).over(Window.partitionBy(batch, group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    # A group whose first text is too long stays, without texts.
    parts = sums.groupBy(batch, group).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("sum") <= budget, F.struct(order, text)))), lambda s: s[text]).alias("parts"))
    every = parts.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(group, "parts"))).alias("groups"))
    taken = budgeted(F.transform("groups", lambda g: g["parts"]), budget)
    both = every.select(batch, F.posexplode(F.arrays_zip(F.transform("groups", lambda g: g[group]).alias("g"), taken.alias("t"))).alias("p", "x"))
    return both.select(batch, F.col("x.g").alias(group), (F.col("p") + 1).cast("long").alias("k"), F.col("x.t").alias("taken"))


def hashed_vector(text: str, dim: int) -> np.ndarray:
    h = np.array([zlib.crc32(w.encode()) for w in text.lower().split()], dtype=np.int64)
    return np.bincount(h % dim, weights=1.0 - 2.0 * (h >> 16 & 1), minlength=dim).astype(np.float32)


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """A deterministic embedder that needs no model: signed word hashes, counted by place. A model's UDF takes its place."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_vector(t or "", dim))

    return embed


def first_of_each_page(hits: DataFrame, top: int) -> DataFrame:
    """Three times as many hits as wanted, the first of each (document_key, page_number), cut at `top`."""
    pool = hits.where(F.col("rank") <= top * 3)
    once = Window.partitionBy("query_id", "document_key", "page_number").orderBy("rank")
    order = Window.partitionBy("query_id").orderBy("rank")
    one = pool.withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def prompt_text(items: DataFrame) -> DataFrame:
    """Context items (query_id, item, page_number, text) as one text with page marks."""
    part = F.concat(F.lit("--- PAGE "), F.col("page_number").cast("string"), F.lit(" ---\n"), "text")
    return items.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("prompt"))


def highlight_boxes(passages: Column) -> Column:
    """All lines of the passages that have a box: line_number and bbox."""
    return F.flatten(F.transform(passages, lambda p: F.filter(p["lines"], lambda x: x["bbox"].isNotNull())))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total"), F.count_if(F.col("chunk_type") == "parent").alias("parents"), F.count_if(F.col("chunk_type") == "child").alias("children"), F.countDistinct("document_key").alias("documents"))


def chunks_by_id(chunks: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks that a list of ids, which is a table, names; an id named twice gives its chunk once."""
    return chunks.join(ids.select(*keys), keys, "left_semi")


def parents_of(parents: DataFrame, documents: DataFrame, id_col: str) -> DataFrame:
    """The parents of the listed documents (document_key), with their place by page, line and id."""
    order = Window.partitionBy("document_key").orderBy("page_number", "start_line", id_col)
    return parents.join(documents.select("document_key"), "document_key", "left_semi").withColumn("place", F.row_number().over(order).cast("long"))


def in_first_seen_order(rows: DataFrame, query: str, group: str, rank: str, item: str) -> DataFrame:
    """Ranked rows by group: items by rank, and the group's place by its first item's rank."""
    g = rows.groupBy(query, group).agg(F.min(rank).alias("seen"), F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item]).alias("items"))
    return g.withColumn("place", F.dense_rank().over(Window.partitionBy(query).orderBy("seen")).cast("long")).drop("seen")


def answered(prompts: DataFrame, providers: list[Callable[[pd.Series], pd.Series]], prompt: str = "prompt") -> DataFrame:
    """Prompts with `answer`: of the first provider that has one (not null, not blank); later ones are asked for the rest only."""
    out = prompts.withColumn("answer", F.lit(None).cast("string"))
    for ask in providers:
        said = F.trim(F.pandas_udf(ask, "string")(F.when(F.col("answer").isNull(), F.col(prompt))))
        out = out.withColumn("said", said).withColumn("answer", F.coalesce("answer", F.when(F.col("said") != "", F.col("said")))).drop("said")
    return out
