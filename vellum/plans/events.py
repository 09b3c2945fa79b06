"""Queries on events: idempotent processing, status, progress, windows, audit, access, deadlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import accepted_tags, accepted_value, type_change
from ..sources.tables import table
from ..streaming.events import STAGES, event_key, failure_message, progress, recognised, replayed, status_tag

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


_EV = "SELECT event_id, ts, event_type || ':doc:' || user_id || ':version:' || CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE (event_id % 2)::VARCHAR END AS key, CASE WHEN event_id % 4 = 0 THEN 'failed' WHEN event_id % 8 = 5 THEN 'processing' ELSE 'completed' END AS outcome FROM events"


def _outcomes(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    key = event_key(F.lit(None).cast("string"), F.col("event_type"), F.col("user_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2))
    return e.select("event_id", "ts", key.alias("key"), F.when(F.col("event_id") % 4 == 0, "failed").when(F.col("event_id") % 8 == 5, "processing").otherwise("completed").alias("outcome"))


_REPLAYED = f"SELECT *, CASE WHEN done = 1 THEN 'completed' ELSE outcome END AS status FROM (SELECT *, max((outcome = 'completed')::INT) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done FROM ({_EV}))"


@query(f"SELECT event_id, key, status, coalesce(lag(status) OVER (PARTITION BY key ORDER BY ts, event_id) = 'failed', TRUE) AS started FROM ({_REPLAYED})")
def event_dedupe(spark, sf_dir):
    """An event starts work unless its key is done or in work; failures may be tried again."""
    return replayed(_outcomes(spark, sf_dir)).select("event_id", "key", "status", "started")


@query(f"SELECT key, count(*)::BIGINT AS n, arg_max(outcome, (ts, event_id)) AS last, CASE arg_max(status, (ts, event_id)) WHEN 'completed' THEN 'ready' WHEN 'failed' THEN 'error' ELSE 'processing' END AS tag FROM ({_REPLAYED}) GROUP BY key")
def event_status(spark, sf_dir):
    order = F.struct("ts", "event_id")
    g = replayed(_outcomes(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("n"), F.max_by("outcome", order).alias("last"), F.max_by("status", order).alias("status"))
    return g.select("key", "n", "last", status_tag(F.col("status")).alias("tag"))


@query(f"SELECT event_id, key, substr(repeat(outcome || ' ', 300), 1, 2000) AS message FROM ({_EV}) WHERE outcome = 'failed'")
def event_failures(spark, sf_dir):
    return _outcomes(spark, sf_dir).where("outcome = 'failed'").select("event_id", "key", failure_message(F.repeat(F.concat("outcome", F.lit(" ")), 300)).alias("message"))


_RECOGNISED = "SELECT user_id AS document_id, event_id % 3 AS version_id, ts, event_id, CASE WHEN event_type IN ('purchase', 'view') THEN 'finished' ELSE 'running' END AS state FROM events"


@query(f"SELECT 'ocr.document_version_finish' AS event, document_id, version_id, ts, 'ocr.document_version_finish:doc:' || document_id || ':version:' || version_id AS key FROM (SELECT *, lag(state) OVER (PARTITION BY document_id, version_id ORDER BY ts) AS before FROM ({_RECOGNISED})) WHERE state = 'finished' AND before IS DISTINCT FROM 'finished'")
def ocr_triggers(spark, sf_dir):
    states = events(spark, sf_dir).select(F.col("user_id").alias("document_id"), (F.col("event_id") % 3).alias("version_id"), "ts", F.when(F.col("event_type").isin("purchase", "view"), "finished").otherwise("running").alias("state"))
    return recognised(states)


_STATE = "CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'STARTED' WHEN 2 THEN 'PROGRESS' WHEN 3 THEN 'SUCCESS' ELSE 'FAILURE' END"


@query(f"SELECT event_id, s AS state, CASE s WHEN 'PENDING' THEN 0 WHEN 'STARTED' THEN 5 WHEN 'SUCCESS' THEN 100 WHEN 'PROGRESS' THEN CASE event_id % 7 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 50 WHEN 3 THEN 70 WHEN 4 THEN 85 ELSE 0 END + CASE WHEN event_id % 2 = 1 AND event_id % 7 < 4 THEN 10 ELSE 0 END ELSE 0 END::INT AS progress FROM (SELECT event_id, {_STATE} AS s FROM events)")
def event_progress(spark, sf_dir):
    i = F.col("event_id") % 5
    s = F.when(i == 0, "PENDING").when(i == 1, "STARTED").when(i == 2, "PROGRESS").when(i == 3, "SUCCESS").otherwise("FAILURE")
    return events(spark, sf_dir).select("event_id", s.alias("state")).withColumn("progress", progress(F.col("state"), F.get(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 7).cast("int")), F.col("event_id") % 2 == 1))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("window.start").alias("window_start"), "n", "total")


@query("WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE])::TIMESTAMP AS window_start FROM events) SELECT event_type, window_start, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def event_sliding(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return g.select("event_type", F.col("window.start").alias("window_start"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts)::TIMESTAMP AS session_start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def event_session(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), "n")


@query("SELECT user_id, event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY")
def audit_recent(spark, sf_dir):
    e = events(spark, sf_dir)
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 30 DAYS")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, count(*)::BIGINT AS n FROM events WHERE event_type <> 'view' GROUP BY ALL HAVING count(*) > 2")
def audit_having(spark, sf_dir):
    g = events(spark, sf_dir).where("event_type != 'view'").groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n")).where("n > 2")
    return g.select("user_id", F.col("window.start").alias("day"), "n")


@query("SELECT lang, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def facets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, source FROM documents WHERE list_has_any(['group' || doc_id % 7, 'group' || doc_id % 11], ['group3', 'group10'])")
def acl_filter(spark, sf_dir):
    group = lambda n: F.concat(F.lit("group"), (F.col("doc_id") % n).cast("string"))
    return table(spark, sf_dir, "documents").where(F.arrays_overlap(F.array(group(7), group(11)), F.array(F.lit("group3"), F.lit("group10")))).select("doc_id", "source")


@query("SELECT o_orderkey, CASE WHEN d >= 10 THEN 'director' WHEN d >= 5 THEN 'manager' ELSE 'none' END AS escalation FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate) FROM orders)::DATE) AS d FROM orders WHERE o_orderstatus = 'O')")
def sla_flags(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    d = F.datediff("now", "o_orderdate")
    return o.where("o_orderstatus = 'O'").crossJoin(F.broadcast(now)).select("o_orderkey", F.when(d >= 10, "director").when(d >= 5, "manager").otherwise("none").alias("escalation"))


@query("SELECT doc_id, q.quality, q.toxic, coalesce(q.quality, 0) * 10 + d.doc_id % 10 >= 5 AS above FROM documents d LEFT JOIN labels q USING (doc_id)")
def score_threshold(spark, sf_dir):
    d, q = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return d.join(q, "doc_id", "left").select("doc_id", "quality", "toxic", (F.coalesce("quality", F.lit(0)) * 10 + F.col("doc_id") % 10 >= 5).alias("above"))


@query(f"SELECT key, event_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r FROM ({_EV})) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    from ..sources.sinks import latest

    return latest(_outcomes(spark, sf_dir), ["key"], ["ts", "event_id"]).select("key", "event_id", "outcome")


@query("SELECT doc_id, 'new' AS version FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id % 10 <> 0")
def replace_documents(spark, sf_dir):
    from ..sources.sinks import replaced

    d = table(spark, sf_dir, "documents").select("doc_id")
    return replaced(d.withColumn("version", F.lit("old")), d.where("doc_id % 10 = 0").withColumn("version", F.lit("new")), "doc_id")


@query("""SELECT doc_id, CASE WHEN source = 'src0' AND lang IS NOT NULL THEN lang END AS set_type, array_to_string(list_filter(['lang: ' || lang, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'size: ' || n_chars END], lambda x: x IS NOT NULL), ',') AS values,
    array_to_string(list_slice(list_filter(['AI', lang, source, CASE WHEN doc_id % 2 = 0 THEN 'even' END, 'n' || doc_id % 3, 'm' || doc_id % 5], lambda x: x IS NOT NULL), 1, 5), ',') AS tags FROM documents""")
def write_back(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 4 == 0, "N/A").otherwise(F.col("n_chars").cast("string"))
    pair = lambda n, v: F.when(accepted_value(v).isNotNull(), F.concat(F.lit(f"{n}: "), accepted_value(v)))
    tag = lambda p, n: F.concat(F.lit(p), (F.col("doc_id") % n).cast("string"))
    tags = F.array(F.lit(" AI "), F.coalesce("lang", F.lit("")), F.col("source"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise(" "), F.lit("AI"), tag("n", 3), tag("m", 5))
    kind = type_change(F.when(F.col("source") == "src0", "Default").otherwise("Contract"), F.col("lang"))
    return d.select("doc_id", kind.alias("set_type"), F.concat_ws(",", pair("lang", F.col("lang")), pair("size", said)).alias("values"), F.array_join(accepted_tags(tags), ",").alias("tags"))
