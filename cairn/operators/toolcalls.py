"""Tool-call event state machine, batch form.

Per call id, events count up to and including the first 'done'; everything
after it is ignored.  The latest kept event carries the call's snapshot.  The
first 'done' is a per-call aggregate, written and joined back: partial aggregation
and AQE's splitting of the join cover a call with a huge share of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import written


def kept_events(events: DataFrame, call: str = "call_id", phase: str = "phase",
                order: str = "ord") -> DataFrame:
    first_done = written(events.filter(F.col(phase) == "done").groupBy(call)
                               .agg(F.min(order).alias("_done")), "first_done")
    return (events.join(first_done, call, "left")
                  .filter(F.col("_done").isNull() | (F.col(order) <= F.col("_done")))
                  .withColumn("completed", F.col("_done").isNotNull())
                  .drop("_done"))


def call_states(events: DataFrame, call: str = "call_id", phase: str = "phase",
                order: str = "ord", snapshot: str = "snapshot") -> DataFrame:
    """Per call: kept events, completed flag, last kept event and its snapshot."""
    kept = kept_events(events, call, phase, order)
    return kept.groupBy(call).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max("completed").alias("completed"),
        F.max(order).alias("last_ord"),
        F.max_by(snapshot, order).alias("snapshot"))
