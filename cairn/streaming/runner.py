"""Stream sources and sinks.

Streams read landed tables with the file source (new files become new
micro-batches).  Every query keeps its checkpoint in a fresh folder under the
session's shared folder, so a restarted driver resumes from it.  ``run_*``
helpers drive a query with ``trigger(availableNow=True)`` and hand back the
result as a DataFrame (batch tests and the driver use them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.session import fresh_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, *columns: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over ``<sf_dir>/<name>.parquet`` (and any later ones of that name).

    Each may be a file or a folder of part files, so the names are matched by the path: a
    ``pathGlobFilter`` tests the files alone, and would leave out all that lie in a folder.
    """
    path = f"{sf_dir.rstrip('/')}/{name}*.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.parquet(path)
    return df.select(*columns) if columns else df


def checkpoint_for(spark: SparkSession, kind: str) -> str:
    return fresh_path(spark, f"streams/{kind}")


def run_to_table(df: DataFrame, mode: str = "append", kind: str = "stream",
                 checkpoint: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over what is available; the result is a table in the shared folder.

    Append mode goes through the exactly-once file sink.  In complete mode each
    micro-batch overwrites a folder of its own with the whole result (a replayed
    batch writes the same folder again), and the last one is the answer.
    """
    spark = df.sparkSession
    path = fresh_path(spark, f"stream_results/{kind}")
    checkpoint = checkpoint or checkpoint_for(spark, kind)
    if mode == "append":
        run_to_files(df, path, checkpoint)
        return spark.read.schema(df.schema).parquet(path)
    last: list[int] = []

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        last.append(batch_id)

    run_foreach_batch(df, store, kind, checkpoint, mode)
    if not last:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{path}/batch_id={max(last)}")


def run_foreach_batch(df: DataFrame, fn, kind: str = "stream", checkpoint: str | None = None,
                      mode: str = "append") -> None:
    """Run ``fn(batch_df, batch_id)`` for every micro-batch of what is available."""
    spark = df.sparkSession
    q = (df.writeStream.foreachBatch(fn).outputMode(mode).trigger(availableNow=True)
           .option("checkpointLocation", checkpoint or checkpoint_for(spark, kind))
           .start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def watch(df: DataFrame, sink, mode: str = "update", every: str = "2 seconds", kind: str = "watch",
          checkpoint: str | None = None):
    """Start a long-running query that re-evaluates every ``every`` (the readiness
    poll of a store is a streaming roll-up watched this way).  ``sink`` is a
    ``foreachBatch`` function; returns the running ``StreamingQuery``."""
    spark = df.sparkSession
    return (df.writeStream.outputMode(mode).foreachBatch(sink)
              .trigger(processingTime=every)
              .option("checkpointLocation", checkpoint or checkpoint_for(spark, kind))
              .start())


def run_to_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Run a streaming DataFrame over what is available into a file sink.

    The file sink commits through its own metadata log, so together with the
    checkpoint a restarted query neither loses nor repeats output (exactly once).
    """
    q = (df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
           .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
