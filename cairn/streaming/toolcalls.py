"""Tool-call events as a stream.

``tool_calls_stream``: per call id the state is (completed, last ord,
snapshot).  Events of a call are emitted in order until its first 'done'; later
events of that call are dropped.  ``kept_events_batch`` keeps the completed calls
in a table instead and joins each micro-batch to it.  State expires one day of event time
after the call's last event (watermark-driven timeout) — the reference keeps
it for one run only; a late event after expiry reopens the call.

``completed_calls_stream``: each call completes once —
``dropDuplicatesWithinWatermark`` on the 'done' events bounds the state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from cairn.operators.toolcalls import kept_events
from cairn.session import written

STATE_SCHEMA = "completed boolean, last_ord bigint, snapshot string"
OUT_SCHEMA = "call_id string, ord bigint, phase string, snapshot string"
STATE_TTL_MS = 24 * 3600 * 1000


def tool_call_events(events: DataFrame) -> DataFrame:
    """Driver 'events' rows -> tool-call events (call per user and day)."""
    call_id = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string"))
    phase = (F.when(F.col("event_type") == "purchase", "done")
              .when(F.col("event_type") == "signup", "created").otherwise("delta"))
    return events.select(call_id.alias("call_id"), phase.alias("phase"), F.col("event_id").alias("ord"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("snapshot"))


def _cols(frames, name):
    arrays = [f[name].to_numpy() for f in frames]
    return arrays[0] if len(arrays) == 1 else np.concatenate(arrays)


def _step(key, batches, state):
    """One call id: emit its events in order up to the first 'done' (numpy only, no
    per-row Python; this runs once per call per micro-batch)."""
    (call_id,) = key
    if state.hasTimedOut:
        state.remove()
        return
    completed, last_ord, snapshot = state.get if state.exists else (False, None, None)
    frames = list(batches)
    ords = _cols(frames, "ord")
    order = np.argsort(ords, kind="stable")
    phases = _cols(frames, "phase")[order]
    kept = order[:0]
    if not completed:
        done = np.flatnonzero(phases == "done")
        kept = order[: done[0] + 1] if len(done) else order
        completed = len(done) > 0
    snaps = _cols(frames, "snapshot")
    if len(kept):
        last_ord, snapshot = int(ords[kept[-1]]), snaps[kept[-1]]
    state.update((bool(completed), last_ord, snapshot))
    max_ms = int(_cols(frames, "ts").max().astype("datetime64[ms]").astype(np.int64))
    # late input (older than the watermark) must not push the timeout into the past
    state.setTimeoutTimestamp(max(max_ms + STATE_TTL_MS, state.getCurrentWatermarkMs() + 1))
    if len(kept):
        yield pd.DataFrame({"call_id": np.full(len(kept), call_id, dtype=object), "ord": ords[kept],
                            "phase": phases[: len(kept)], "snapshot": snaps[kept]})


def tool_calls_stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming kept events: (call_id, ord, phase, snapshot), one state and one Python call per
    call id and micro-batch; ``kept_events_batch`` is the form without Python."""
    return (events.withWatermark("ts", watermark).groupBy("call_id").applyInPandasWithState(
        _step, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))


def completed_calls_stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """One row per completed call (its first 'done' event to arrive)."""
    return (events.filter(F.col("phase") == "done")
                  .withWatermark("ts", watermark)
                  .dropDuplicatesWithinWatermark(["call_id"]))


DONE = "call_id string, done_ts timestamp, batch_id bigint"


def _completed(spark: SparkSession, root: str, before_batch: int) -> DataFrame:
    """Calls that earlier batches completed."""
    try:
        done = spark.read.schema(DONE).parquet(f"{root}/done")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], DONE)
    return done.filter(F.col("batch_id") < before_batch)


def kept_events_batch(root: str, ttl: str = "1 day"):
    """foreachBatch function: the batch's events of calls that no earlier batch completed,
    up to their first 'done', to ``root``/kept, and the calls completed to ``root``/done.

    The state is the table of completed calls, a row each, read back by earlier batch ids
    only, and every folder is overwritten by its own batch id, so a replayed batch
    writes the same again.  Completions more than ``ttl`` before the batch's first
    event are passed over.  Plain joins and aggregates: no state per group in memory,
    and a call with a large share of the events splits like in the batch form.
    """
    root = root.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.agg(F.min("ts").cast("timestamp")).scalar()
        done = _completed(spark, root, batch_id).filter(
            F.col("done_ts") >= F.coalesce(first, F.to_timestamp(F.lit("1970-01-01"))) - F.expr(f"INTERVAL {ttl}")).select("call_id").distinct()
        events = written(batch.join(written(done, "completed_calls"), "call_id", "left_anti"), "open_events")
        kept_events(events).select("call_id", "ord", "phase", "snapshot").write.mode("overwrite").parquet(
            f"{root}/kept/batch_id={batch_id}")
        (events.filter(F.col("phase") == "done").groupBy("call_id").agg(F.max("ts").cast("timestamp").alias("done_ts"))
         .write.mode("overwrite").parquet(f"{root}/done/batch_id={batch_id}"))
    return run


def read_kept(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(OUT_SCHEMA).parquet(f"{root.rstrip('/')}/kept").select("call_id", "ord", "phase", "snapshot")
