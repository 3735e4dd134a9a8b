"""Registered streaming queries, each driven with trigger(availableNow).

Where the final result of a stream is deterministic, its oracle is the same
SQL as the batch operator's, so the stream is checked against the batch answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans import query_registry
from cairn.operators import block_index as BI
from cairn.operators import retrieval as RV
from cairn.plans import retrieval as PR
from cairn.plans.conversation import ORACLE as CONV_ORACLE
from cairn.plans.corpus import ORACLE as CORPUS_ORACLE
from cairn.session import fresh_path
from cairn.sources.tables import read_table
from cairn.streaming import pipelines as PL
from cairn.streaming import readiness as RD
from cairn.streaming import runner as RN
from cairn.streaming import summaries as SU
from cairn.streaming import toolcalls as TS

QUERIES, ORACLE, register = query_registry()

READY_TTL_MS, READY_KEEP_MS, READY_DELAY_MS = 12 * 3_600_000, 24 * 3_600_000, 3_600_000
FILES_PER_BATCH = 16  # files that a micro-batch takes at most, which bounds its size


def stream_frames(spark, sf_dir) -> dict:
    """The streaming DataFrames behind the registered streams (not started), for plan review."""
    events = TS.tool_call_events(RN.table_stream(spark, sf_dir, "events", max_files_per_trigger=FILES_PER_BATCH))
    msgs = RN.table_stream(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text", max_files_per_trigger=FILES_PER_BATCH)
    docs = RN.table_stream(spark, sf_dir, "documents", "doc_id", "source", "text", max_files_per_trigger=FILES_PER_BATCH)
    status = PL.file_status_stream(docs, read_table(spark, sf_dir, "labels", "doc_id"))
    return {
        "tool_calls_stream": TS.tool_calls_stream(events),
        "completed_calls_stream": TS.completed_calls_stream(events),
        "response_deltas_stream": PL.response_deltas(msgs),
        "store_status_stream": PL.store_status_stream(status),
    }


@register("tool_calls_stream", """
SELECT e.call_id, e.ord, e.phase, e.snapshot
FROM tool_events e LEFT JOIN (SELECT call_id, min(ord) AS done FROM tool_events WHERE phase = 'done' GROUP BY call_id) d
  USING (call_id)
WHERE d.done IS NULL OR e.ord <= d.done""")
def q_tool_calls_stream(spark, sf_dir):
    root = fresh_path(spark, "tool_calls")
    events = TS.tool_call_events(RN.table_stream(spark, sf_dir, "events", max_files_per_trigger=FILES_PER_BATCH))
    RN.run_foreach_batch(events, TS.kept_events_batch(root), "tool_calls")
    return TS.read_kept(spark, root)


@register("completed_calls_stream", """
SELECT DISTINCT call_id FROM tool_events WHERE phase = 'done'""")
def q_completed_calls_stream(spark, sf_dir):
    events = TS.tool_call_events(RN.table_stream(spark, sf_dir, "events", max_files_per_trigger=FILES_PER_BATCH))
    return RN.run_to_table(TS.completed_calls_stream(events), "append", "completed_calls").select("call_id")


@register("response_text_stream", CONV_ORACLE["response_text"])
def q_response_text_stream(spark, sf_dir):
    msgs = RN.table_stream(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text", max_files_per_trigger=FILES_PER_BATCH)
    root = fresh_path(spark, "response_text")
    RN.run_foreach_batch(PL.response_deltas(msgs), PL.deltas_batch(root), "response_text")
    return PL.read_response_text(spark, root).select("conv_id", "response_text", "n_messages")


@register("summarize_threads_stream", PR.ORACLE["summarize_threads"])
def q_summarize_threads_stream(spark, sf_dir):
    """Summaries kept by the turns that arrive; earlier turns aren't split again."""
    root = fresh_path(spark, "thread_summaries")
    msgs = RN.table_stream(spark, sf_dir, "conversations", "conv_id", "turn", "text", max_files_per_trigger=FILES_PER_BATCH)
    RN.run_foreach_batch(msgs, SU.summary_batch(root), "thread_summaries")
    return SU.read_summaries(spark, root, PR.SUMMARY_N).select("conv_id", "summary", "n_sentences")


@register("store_status_stream", CORPUS_ORACLE["store_status"])
def q_store_status_stream(spark, sf_dir):
    docs = RN.table_stream(spark, sf_dir, "documents", "doc_id", "source", "text", max_files_per_trigger=FILES_PER_BATCH)
    labels = read_table(spark, sf_dir, "labels", "doc_id")
    status = PL.file_status_stream(docs, labels)
    return RN.run_to_table(PL.store_status_stream(status), "complete", "store_status")


@register("readiness_stream", f"""
WITH w AS (SELECT max(epoch_us(ts) // 1000) - {READY_DELAY_MS} AS mark FROM tool_events),
c AS (SELECT call_id AS key, min(epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // 1000) + {READY_TTL_MS} AS due,
        min(CASE WHEN phase = 'done' THEN epoch_us(ts) // 1000 END) AS done FROM tool_events GROUP BY call_id)
SELECT key, CASE WHEN done <= due THEN 'completed' WHEN due < mark THEN 'expired' ELSE 'in_progress' END AS status,
  CASE WHEN done <= due THEN done WHEN due < mark THEN due ELSE due - {READY_TTL_MS} END AS at_ms
FROM c, w""")
def q_readiness_stream(spark, sf_dir):
    """Calls are opened at the start of their day and must be done by noon."""
    events = TS.tool_call_events(RN.table_stream(spark, sf_dir, "events", max_files_per_trigger=FILES_PER_BATCH))
    stream = RD.readiness_stream(events, "call_id", F.date_trunc("day", "ts"), READY_TTL_MS, READY_KEEP_MS, f"{READY_DELAY_MS} milliseconds")
    with RD.rocksdb_state(spark):
        return RD.latest_status(RN.run_to_table(stream, "append", "readiness"))


@register("ingest_stream", """
SELECT DISTINCT sha256(text) AS hash, 'file-' || substr(sha256(text), 1, 24) AS file_id FROM documents""")
def q_ingest_stream(spark, sf_dir):
    cache_root = fresh_path(spark, "hash_cache_stream")
    docs = RN.table_stream(spark, sf_dir, "documents", "doc_id", "text", max_files_per_trigger=FILES_PER_BATCH)
    RN.run_foreach_batch(docs, PL.ingest_batch(cache_root), "ingest")
    return PL.read_hash_cache(spark, cache_root)


@register("index_stream", PR.ORACLE["build_index"])
def q_index_stream(spark, sf_dir):
    """Document frequencies of an index that micro-batches have grown."""
    index = BI.BlockIndex(spark, fresh_path(spark, "index_stream"))
    docs = RN.table_stream(spark, sf_dir, "documents", "doc_id", "text", max_files_per_trigger=FILES_PER_BATCH)
    RN.run_foreach_batch(docs, PL.index_batch(index, PR.SIZE, PR.OVERLAP), "index")
    return BI.term_stats(index.snapshot())


@register("answer_stream", PR.ORACLE["answer_questions"])
def q_answer_stream(spark, sf_dir):
    chunks_path = fresh_path(spark, "chunk_index")
    RV.chunk_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                       size=PR.SIZE, overlap=PR.OVERLAP).write.parquet(chunks_path)
    answers_root = fresh_path(spark, "answers")
    prompts = RN.table_stream(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text", max_files_per_trigger=FILES_PER_BATCH)
    RN.run_foreach_batch(prompts, PL.answer_batch(chunks_path, answers_root, k=PR.ANSWER_K), "answers")
    return spark.read.parquet(answers_root).drop("batch_id")


@register("response_deltas_stream", """
SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'""")
def q_response_deltas_stream(spark, sf_dir):
    """Each assistant text delta as it arrives (append mode)."""
    msgs = RN.table_stream(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text", max_files_per_trigger=FILES_PER_BATCH)
    return RN.run_to_table(PL.response_deltas(msgs), "append", "response_deltas")
