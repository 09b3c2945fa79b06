"""Idempotent event processing, in batch and as a stream, and windows with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Retries of a task and the waits before them, in seconds.
RETRY_WAITS = (60, 180, 540)
#: Stages of a task with the percentages at which they begin and go on.
STAGES = {"parsing": (10, 20), "enriching": (30, 40), "chunking": (50, 60), "embedding": (70, 80), "storing": (85, 85)}


def event_key(event_id: Column, event: Column, document: Column, version: Column) -> Column:
    made = F.concat_ws(":", event, F.lit("doc"), document.cast("string"), F.lit("version"), F.coalesce(version.cast("string"), F.lit("unknown")))
    return F.coalesce(event_id.cast("string"), made)


# Fixed value: the name of the event that recognised text sends.
FINISHED = "ocr.document_version_finish"


def recognised(states: DataFrame) -> DataFrame:
    """(document_id, version_id, ts, state) -> an event for each time that a version's text recognition comes to its end: event, document_id,
    version_id, ts, key. A state that is only told again sends nothing."""
    before = F.lag("state").over(Window.partitionBy("document_id", "version_id").orderBy("ts"))
    ended = states.withColumn("before", before).where((F.col("state") == "finished") & ~F.col("before").eqNullSafe("finished"))
    key = event_key(F.lit(None).cast("string"), F.lit(FINISHED), F.col("document_id"), F.col("version_id"))
    return ended.select(F.lit(FINISHED).alias("event"), "document_id", "version_id", "ts", key.alias("key"))


def replayed(outcomes: DataFrame) -> DataFrame:
    """Batch twin of `deduplicated`: (key, ts, event_id, outcome) -> started, status. An event starts work unless its key is done or
    in work; what failed may be tried again. A key once completed stays so; until then its status is its latest outcome."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    status = F.when(F.max(F.col("outcome") == "completed").over(upto), "completed").otherwise(F.col("outcome"))
    known = outcomes.withColumn("status", status)
    return known.withColumn("started", F.coalesce(F.lag("status").over(order) == "failed", F.lit(True)))


def progress(state: Column, stage: Column, going_on: Column) -> Column:
    """Percent for a task's state; `stage` names the stage while it is in progress, `going_on` tells its second half."""
    at = reduce(lambda c, x: c.when(stage == x[0], F.when(going_on, x[1][1]).otherwise(x[1][0])), STAGES.items(), F.when(F.lit(False), 0))
    return F.when(state == "STARTED", 5).when(state == "SUCCESS", 100).when(state == "PROGRESS", F.coalesce(at, F.lit(0))).otherwise(0)


STATUS = "status string, attempts long"
DECIDED = "key string, event_id long, started boolean, status string, attempts long"


def _decider(lease: str | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    wait = int(pd.Timedelta(lease).total_seconds() * 1000) if lease else None

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # stuck work may start again
            state.remove()
            return
        status, attempts = state.get if state.exists else ("new", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for row in rows.itertuples():
            started = status in ("new", "failed")
            if started:
                attempts += 1
                status = row.outcome if row.outcome in ("completed", "failed") else "processing"
            elif status == "processing" and row.outcome in ("completed", "failed"):
                status = row.outcome
            out.append((key[0], row.event_id, started, status, attempts))
        state.update((status, attempts))
        if wait and status == "processing":
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000) + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "event_id", "started", "status", "attempts"])

    return decide


def deduplicated(stream: DataFrame, lease: str | None = None) -> DataFrame:
    """Streaming: (key, ts, event_id, outcome) -> decisions. A key that is done or in work is a duplicate, a failed one
    is tried again. With a lease, work that stays `processing` is forgotten after that time (stream needs a watermark)."""
    return stream.groupBy("key").applyInPandasWithState(_decider(lease), DECIDED, STATUS, "append", GroupStateTimeout.EventTimeTimeout if lease else GroupStateTimeout.NoTimeout)


def status_tag(status: Column) -> Column:
    return F.when(status == "completed", "ready").when(status == "failed", "error").otherwise("processing")


def failure_message(error: Column) -> Column:
    return F.substring(error, 1, 2000)


RUN = "key string, attempt int, status string, stage string, progress int, error string, wait int"


def staged(tasks: DataFrame, stages: dict[str, Callable[[str], str]]) -> DataFrame:
    """(key, attempt from 0, payload) -> how each task ended. Its payload goes through the stages in their order; a stage that raises
    ends it as `failed`, with the error and the wait before its next try (null after the last)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, attempt, payload in zip(pdf["key"], pdf["attempt"], pdf["payload"], strict=True):
                end = (key, attempt, "completed", list(stages)[-1], 100, None, None)
                for name, work in stages.items():
                    try:
                        payload = work(payload)
                    except Exception as e:  # whatever a stage raises becomes a row
                        wait = RETRY_WAITS[attempt] if attempt < len(RETRY_WAITS) else None
                        end = (key, attempt, "failed", name, 0, str(e), wait)
                        break
                out.append(end)
            made = pd.DataFrame(out, columns=["key", "attempt", "status", "stage", "progress", "error", "wait"])
            yield made.astype({"wait": "Int32"})

    ended = tasks.select("key", F.col("attempt").cast("int").alias("attempt"), "payload").mapInPandas(run, RUN)
    return ended.withColumn("error", failure_message(F.col("error")))


def stage_sink(path: str, stages: dict[str, Callable[[str], str]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: runs the stages of a micro-batch's tasks and writes how they ended, once for each batch however often it is run."""

    def sink(batch: DataFrame, number: int) -> None:
        staged(batch, stages).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return sink


def retries(ended: DataFrame, tasks: DataFrame) -> DataFrame:
    """The tasks that may be tried again, with their next attempt."""
    again = ended.where("status = 'failed' AND wait IS NOT NULL").select("key", (F.col("attempt") + 1).alias("next"))
    return tasks.join(again, "key").select("key", F.col("next").alias("attempt"), "payload")


def tumbling(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    w = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(stream: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    w = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")


def retry_decision(state: Column, has_arguments: Column, has_file: Column, attempts: Column) -> Column:
    """HTTP-like answer to a request for another try: 409 while running, 404 without arguments or file, 429 after the last try, else 202."""
    return F.when(state.isin("PENDING", "STARTED", "PROGRESS", "RETRY"), 409).when(~has_arguments | ~has_file, 404).when(attempts >= len(RETRY_WAITS), 429).otherwise(202)


def retry_wait(attempt: Column) -> Column:
    """Seconds before the next try; null after the last."""
    return F.get(F.array(*[F.lit(x) for x in RETRY_WAITS]), attempt)
