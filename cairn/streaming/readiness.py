"""Await-readiness with expiry: a stream of status rows per key.

A key is opened at a time that each of its events carries and has until ``opened + ttl``
to complete.  ``in_progress`` is reported with its first event, ``completed`` with the first
'done' event not later than the deadline, ``expired`` when the watermark passes the deadline
without one; a completion that comes after that is refused.  The deadline depends on event time
alone, so batches and their order don't change the end states, as long as events aren't
later than the watermark's delay (those that are don't count).

State is one status per key, which changes at the deadline, by an event-time timer, and is cleared
at ``opened + keep``.  A call on the state or a timer costs much more than a row, so keys are hashed into
``BUCKETS`` (``transformWithStateInPandas``): a bucket holds its keys as one Arrow batch, and its timer stands at
the next time that one of them changes.  Events at or after ``opened + keep`` are ignored, so a cleared key can't open again.  Null keys, times and events without a
time are left out.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

BUCKETS = 512
OUT = "key string, status string, at_ms bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Readiness(StatefulProcessor):
    """One key's way from in_progress to completed or expired, where a group is a key (see ``ReadinessOfMany``).

    Calls on the state and its timers cost more than the rows, so each is made once: a key has one
    timer, at its deadline while it is in progress and at ``opened + keep`` afterwards.
    """

    def __init__(self, ttl_ms: int, keep_ms: int):
        self.ttl_ms, self.keep_ms = ttl_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("readiness", "status string, opened bigint")

    def handleInputRows(self, key, rows, timerValues):
        # one pass over the rows: what they say about the key is two numbers
        opened, done = None, None
        for r in rows:
            if r.at_ms < r.opened_ms + self.keep_ms:
                opened = r.opened_ms if opened is None else min(opened, r.opened_ms)
                if r.phase == "done" and r.at_ms <= r.opened_ms + self.ttl_ms:
                    done = r.at_ms if done is None else min(done, r.at_ms)
        if opened is None:
            return
        held = self.state.get()
        status, opened = held if held is not None else (None, opened)
        if status is None:
            yield Row(key=key[0], status="in_progress", at_ms=opened)
            self.state.update(("in_progress" if done is None else "completed", opened))
            self.handle.registerTimer(opened + (self.ttl_ms if done is None else self.keep_ms))
        elif status == "in_progress" and done is not None:
            self.state.update(("completed", opened))
        if done is not None and status != "expired":
            yield Row(key=key[0], status="completed", at_ms=done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.state.get()
        if held is None:
            return
        status, opened = held
        if status == "in_progress":
            yield Row(key=key[0], status="expired", at_ms=opened + self.ttl_ms)
        if max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) >= opened + self.keep_ms:
            self.state.clear()
            return
        if status == "in_progress":
            self.state.update(("expired", opened))
        self.handle.registerTimer(opened + self.keep_ms)

    def close(self) -> None:
        pass


_STATUS = np.array(["in_progress", "completed", "expired"], dtype=object)
_IN_PROGRESS, _COMPLETED, _EXPIRED = range(3)
_NEVER = np.iinfo(np.int64).max
_HELD = pa.schema([("key", pa.string()), ("status", pa.int8()), ("opened", pa.int64())])


class ReadinessOfMany(Readiness):
    """The same for a bucket of keys at once: their states are one value, with one timer."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("readiness", "held binary, timer bigint")

    def _get(self) -> tuple[pd.DataFrame, int]:
        """(key, status, opened) of the bucket's keys, and when its timer stands (``_NEVER``: there is none)."""
        value = self.state.get()
        if value is None:
            return pd.DataFrame({"key": np.array([], object), "status": np.array([], np.int8), "opened": np.array([], np.int64)}), _NEVER
        return pa.ipc.open_stream(bytes(value[0])).read_pandas(), value[1]

    def _put(self, held: pd.DataFrame, timer: int) -> None:
        """Keep these keys; ``timer`` is the one that stands."""
        status = held["status"].to_numpy()
        due = held["opened"].to_numpy() + np.where(status == _IN_PROGRESS, self.ttl_ms, self.keep_ms)
        following = int(due.min(initial=_NEVER))
        if following != timer:
            if timer != _NEVER:
                self.handle.deleteTimer(timer)
            if following != _NEVER:
                self.handle.registerTimer(following)
        if not len(held):
            self.state.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_pandas(held[_HELD.names], schema=_HELD, preserve_index=False))
        self.state.update((sink.getvalue().to_pybytes(), following))

    def _said(self, rows) -> pd.DataFrame:
        """What the rows say about each key: the first time it was opened at, and the first it was done in time."""
        found = None
        for r in rows:
            r = r[r["at_ms"] < r["opened_ms"] + self.keep_ms]
            in_time = (r["phase"] == "done") & (r["at_ms"] <= r["opened_ms"] + self.ttl_ms)
            new = pd.DataFrame({"key": r["key"], "opened": r["opened_ms"], "done": r["at_ms"].where(in_time, _NEVER)})
            found = (new if found is None else pd.concat([found, new])).groupby("key", sort=False, as_index=False).min()
        return found

    def handleInputRows(self, key, rows, timerValues):
        said = self._said(rows)
        if said is None or not len(said):
            return
        held, timer = self._get()
        at = pd.Index(held["key"]).get_indexer(said["key"])
        known, done = at >= 0, said["done"].to_numpy()
        is_done = done != _NEVER
        before = np.where(known, held["status"].to_numpy()[at] if len(held) else 0, -1)
        completed = is_done & (before != _EXPIRED)
        for which, status, at_ms in ((~known, _IN_PROGRESS, said["opened"].to_numpy()), (completed, _COMPLETED, done)):
            if which.any():
                yield pd.DataFrame({"key": said["key"].to_numpy()[which], "status": _STATUS[status], "at_ms": at_ms[which]})
        changed = known & (before == _IN_PROGRESS) & is_done
        if changed.any() or not known.all():
            status = held["status"].to_numpy().copy()
            status[at[changed]] = _COMPLETED
            new = pd.DataFrame({"key": said["key"][~known], "status": np.where(is_done[~known], _COMPLETED, _IN_PROGRESS).astype(np.int8),
                                "opened": said["opened"][~known]})
            self._put(pd.concat([held.assign(status=status), new], ignore_index=True) if len(held) else new, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, timer = self._get()
        now = timerValues.getCurrentWatermarkInMs()
        status, opened = held["status"].to_numpy().copy(), held["opened"].to_numpy()
        expired = (status == _IN_PROGRESS) & ((opened + self.ttl_ms < now) | (opened + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs()))
        if expired.any():
            yield pd.DataFrame({"key": held["key"].to_numpy()[expired], "status": _STATUS[_EXPIRED], "at_ms": opened[expired] + self.ttl_ms})
        status[expired] = _EXPIRED
        # the timer that has expired is removed by Spark
        self._put(held.assign(status=status)[(status == _IN_PROGRESS) | (opened + self.keep_ms > max(now, expiredTimerInfo.getExpiryTimeInMs()))],
                  _NEVER if timer <= expiredTimerInfo.getExpiryTimeInMs() else timer)


def readiness_stream(events: DataFrame, key: str, opened: Column, ttl_ms: int, keep_ms: int, delay: str) -> DataFrame:
    """(key, status, at_ms) rows, in append mode, of an event stream with ``ts`` and ``phase``."""
    if keep_ms <= ttl_ms:
        raise ValueError("keep_ms must be more than ttl_ms")
    rows = events.select(F.col(key).cast("string").alias("key"), "phase", F.unix_millis(opened).alias("opened_ms"),
                         F.unix_millis("ts").alias("at_ms"), "ts").filter("key IS NOT NULL AND ts IS NOT NULL AND opened_ms IS NOT NULL")
    return (rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).withWatermark("ts", delay).groupBy("bucket")
                .transformWithStateInPandas(ReadinessOfMany(ttl_ms, keep_ms), OUT, "Append", "EventTime"))


def latest_status(rows: DataFrame) -> DataFrame:
    """One row a key: its end state, or in_progress; the first time of it."""
    ended = F.col("status") != "in_progress"
    found = rows.groupBy("key").agg(F.min(F.struct((~ended).alias("open"), "at_ms", "status")).alias("s"))
    return found.select("key", "s.status", "s.at_ms")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
