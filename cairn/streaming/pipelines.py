"""Streaming counterparts of the batch operators.

* ``ingest_stream``: new documents -> content hashes -> ids for unseen hashes,
  appended to a hash-cache table partitioned by micro-batch id.  A batch reads
  only the partitions of earlier batches and overwrites its own, so a replayed
  batch writes the same rows again (idempotent).
* ``store_status_stream``: the per-store roll-up over a file-status stream
  (stream-static join with the labels), complete mode.
* ``response_deltas`` is the append-mode stream of assistant text; ``deltas_batch``
  keeps it in a table by micro-batch id, and ``read_response_text`` joins the text of
  every run from that table, so a stream holds no text in its state.
* ``answer_stream``: prompts arriving on a stream are answered in
  ``foreachBatch`` against an index written once before the stream starts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.hashing import content_id, sha256_hex
from cairn.functions.ordinal import ordered_concat
from cairn.operators import block_index as BI
from cairn.operators import stores as ST
from cairn.session import fresh_path
from cairn.sources.records import HASH_CACHE_SCHEMA


def _read_cache(spark: SparkSession, root: str, before_batch: int | None = None) -> DataFrame:
    try:
        df = spark.read.schema("hash string, file_id string, batch_id bigint").parquet(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise  # only a cache that doesn't exist yet is empty
        return spark.createDataFrame([], HASH_CACHE_SCHEMA)
    if before_batch is not None:
        df = df.filter(F.col("batch_id") < before_batch)
    return df.select("hash", "file_id")


def ingest_batch(cache_root: str, text: str = "text"):
    """foreachBatch function: append ids for hashes not cached by earlier batches."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hashes = batch.select(sha256_hex(text).alias("hash")).distinct()
        prior = _read_cache(spark, cache_root, before_batch=batch_id)
        new = (hashes.join(prior, "hash", "left_anti")
                     .select("hash", content_id("file-", "hash").alias("file_id")))
        new.write.mode("overwrite").parquet(f"{cache_root.rstrip('/')}/batch_id={batch_id}")
    return run


def read_hash_cache(spark: SparkSession, cache_root: str) -> DataFrame:
    return _read_cache(spark, cache_root)


def file_status_stream(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents stream (doc_id, source, text) + static labels -> (store, status, bytes)."""
    labelled = labels.select("doc_id").distinct().withColumn("_l", F.lit(True))
    return (docs.join(labelled, "doc_id", "left")
                .select("doc_id", F.col("source").alias("store"),
                        F.when(F.col("_l"), "completed").otherwise("in_progress").alias("status"),
                        F.octet_length("text").cast("bigint").alias("bytes")))


def store_status_stream(status: DataFrame) -> DataFrame:
    return ST.store_status(status, "store")


def response_deltas(messages: DataFrame) -> DataFrame:
    """Append-mode stream of assistant text deltas, as they arrive."""
    return messages.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")


def deltas_batch(root: str):
    """foreachBatch function: the batch's deltas, under its own id (a replayed batch overwrites them)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch_id={batch_id}")
    return run


def read_response_text(spark: SparkSession, root: str, until_batch: int | None = None) -> DataFrame:
    """Full text and number of messages per run, in the order of turns whatever batch they came with.

    ``until_batch`` gives the text as it was after that batch.  Null texts add nothing but count as
    messages.  Stretches of consecutive turns are joined first, so only the finished text of a run is
    one value.
    """
    deltas = spark.read.parquet(root)
    if until_batch is not None:
        deltas = deltas.filter(F.col("batch_id") <= until_batch)
    return ordered_concat(deltas, ["conv_id"], "turn", "text", "", "response_text", count="n_messages")


def index_batch(index: BI.BlockIndex, size: int, overlap: int):
    """foreachBatch function: one segment a micro-batch (a replayed one adds nothing), merged as they pile up."""
    def run(batch: DataFrame, batch_id: int) -> None:
        here = BI.BlockIndex(batch.sparkSession, index.root, index.buckets)
        here.add(batch, size, overlap, batch=batch_id)
        here.merge()
    return run


def answer_batch(chunks_path: str, answers_root: str, k: int = 1):
    """foreachBatch function: answer the batch's prompts from the written chunk index."""
    state: dict = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        chunks = spark.read.parquet(chunks_path)
        if "index" not in state:  # built once per stream run, reused by every micro-batch
            index = BI.BlockIndex(spark, fresh_path(spark, "answer_index"))
            index.add_chunks(chunks)
            state["index"] = index.snapshot()
        prompts = batch.filter(F.col("role") == "user").select(
            F.struct("conv_id", "turn").alias("question_id"), "text")
        hits = BI.search(prompts, state["index"], k=k, qid="question_id")
        out = (hits.join(chunks.select("doc_id", "chunk_no", F.col("text").alias("passage")),
                         ["doc_id", "chunk_no"])
                   .select("question_id.conv_id", "question_id.turn",
                           F.col("rank").cast("bigint").alias("rank"), "doc_id", "chunk_no", "score", "passage"))
        out.write.mode("overwrite").parquet(f"{answers_root.rstrip('/')}/batch_id={batch_id}")
    return run
