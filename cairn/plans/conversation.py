"""Registered queries: transcripts, thread messages, exit cuts, response text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans import query_registry
from cairn.operators import cache as C
from cairn.operators import messages as M
from cairn.operators import select as S
from cairn.operators import transcripts as TR
from cairn.plans import sqlx as X
from cairn.sources import fixtures as FX
from cairn.sources.tables import read_table

QUERIES, ORACLE, register = query_registry()


# ----------------------------------------------------------------- transcripts

_NEST_SQL = """
SELECT video_id, CAST(count(*) AS BIGINT) AS n_entries,
  to_json(struct_pack(video_id := video_id, vector_store_id := '', file_id := '',
          entries := list(struct_pack(text := text, start := start, duration := duration) ORDER BY pos))) AS json
FROM transcript_entries GROUP BY video_id"""


@register("nest_transcripts", _NEST_SQL)
def q_nest_transcripts(spark, sf_dir):
    nested = TR.nest_transcripts(FX.transcript_entries(spark, sf_dir))
    return nested.select("video_id", F.size("entries").cast("bigint").alias("n_entries"), "json")


@register("load_transcripts", """
SELECT video_id, '' AS vector_store_id, '' AS file_id,
  CAST(row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS INTEGER) AS pos,
  text, start, duration
FROM transcript_entries""")
def q_load_transcripts(spark, sf_dir):
    records = TR.nest_transcripts(FX.transcript_entries(spark, sf_dir)).select("json")
    return TR.load_transcripts(records, "json")


@register("render_transcripts", f"""
SELECT video_id, string_agg({X.elapsed('start')} || ' ' || text, chr(10) ORDER BY pos) AS transcript,
  count(*) AS n_lines
FROM transcript_entries GROUP BY video_id""")
def q_render_transcripts(spark, sf_dir):
    return TR.render_transcripts(FX.transcript_entries(spark, sf_dir)).select("video_id", "transcript", "n_lines")


# ----------------------------------------------------------------- messages

MESSAGE_LIMIT = 256_000  # fixed value: the largest message payload, in characters

_SEL = f"""
SELECT source AS store,
  CASE WHEN {X.suffix('path')} = '.lua' THEN {X.parent('path')} || {X.stem('path')} || '.txt' ELSE path END AS path,
  content
FROM files WHERE {X.disposition('path', 'content')} IN ('kept', 'converted')"""


@register("build_messages", f"""
WITH sel AS ({_SEL}),
sized AS (SELECT *, {X.payload_len('path', 'content')} AS payload_chars FROM sel)
SELECT store, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS path,
  CAST(length(printf({X.q(M.HEADER_TEMPLATE)}, count(*))) AS BIGINT) AS payload_chars,
  printf({X.q(M.HEADER_TEMPLATE)}, count(*)) AS message
FROM sel GROUP BY store
UNION ALL
SELECT store, row_number() OVER (PARTITION BY store ORDER BY path) AS seq, path, payload_chars,
  CAST(to_json(struct_pack(path := path, content := content)) AS VARCHAR) AS message
FROM sized WHERE payload_chars <= {MESSAGE_LIMIT}""")
def q_build_messages(spark, sf_dir):
    sel = S.convert_extension(S.select_files(FX.files(spark, sf_dir)))
    files = sel.select(F.col("source").alias("store"), F.col("upload_path").alias("path"), "content")
    return M.build_messages(files, limit=MESSAGE_LIMIT)


@register("thread_resources", """
SELECT id,
  array_to_string(list_filter([CASE WHEN file_search THEN 'file_search' END,
                               CASE WHEN interpret_code THEN 'code_interpreter' END], lambda x: x IS NOT NULL), ',') AS tools,
  CASE WHEN respond_with_json THEN 'json_object' ELSE 'auto' END AS response_format,
  CASE WHEN file_search THEN 'file_search' ELSE '' END AS tool_resources
FROM assistants""")
def q_thread_resources(spark, sf_dir):
    r = M.thread_resources(FX.assistants(spark, sf_dir))
    return r.select("id", F.array_join("tools", ",").alias("tools"), "response_format",
                    F.array_join("tool_resources", ",").alias("tool_resources"))


# Fixed literal turns: no conversation contains an exit word, so these are added.
EXIT_TURNS = [(1, 25, "user", "EXIT"), (2, 15, "user", "Quit"), (3, 5, "user", ":q"),
              (4, 15, "user", " exit"), (5, 35, "assistant", "exit"), (6, 45, "user", "quit")]


def _turns(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    base = c.select("conv_id", (F.col("turn") * 10).alias("pos"), "role", "text")
    extra = spark.createDataFrame(EXIT_TURNS, "conv_id bigint, pos bigint, role string, text string")
    return base.unionByName(extra)


_TURNS_SQL = "(SELECT conv_id, turn * 10 AS pos, role, text FROM conversations UNION ALL SELECT * FROM (VALUES " + \
    ", ".join(f"({a}, {b}, {X.q(c)}, {X.q(d)})" for a, b, c, d in EXIT_TURNS) + ") v(conv_id, pos, role, text))"


@register("truncate_at_exit", f"""
WITH t AS {_TURNS_SQL},
cut AS (SELECT conv_id, min(pos) AS c FROM t WHERE role = 'user' AND lower(text) IN ('exit', 'quit', ':q')
        GROUP BY conv_id)
SELECT t.conv_id, t.pos, t.role, t.text FROM t LEFT JOIN cut USING (conv_id)
WHERE cut.c IS NULL OR t.pos < cut.c""")
def q_truncate_at_exit(spark, sf_dir):
    return M.truncate_at_exit(_turns(spark, sf_dir)).select("conv_id", "pos", "role", "text")


@register("response_text", """
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS response_text, count(*) AS n_messages
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def q_response_text(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    msgs = M.message_blocks(c.filter(F.col("role") == "assistant"))
    return M.response_text(msgs, "conv_id", "turn").select("conv_id", "response_text", "n_messages")


# ----------------------------------------------------------------- videos


def _stored_transcripts(spark, sf_dir):
    """Transcripts saved by an earlier run: the videos with conv_id % 3 = 0."""
    e = FX.transcript_entries(spark, sf_dir).select("video_id").distinct()
    stored = e.filter(F.col("video_id").cast("bigint") % 3 == 0)
    h = F.sha2(F.concat(F.lit("stored:"), F.col("video_id")), 256)
    return stored.select("video_id", F.concat(F.lit("vs_"), F.substring(h, 1, 24)).alias("vector_store_id"),
                         F.concat(F.lit("file-"), F.substring(h, 1, 24)).alias("file_id"))


@register("restore_or_create_videos", """
WITH req AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, struct_pack(c := conv_id, t := turn) AS pos FROM conversations
             WHERE role = 'user'),
stored AS (SELECT DISTINCT video_id, 'vs_' || substr(sha256('stored:' || video_id), 1, 24) AS vector_store_id,
             'file-' || substr(sha256('stored:' || video_id), 1, 24) AS file_id
           FROM transcript_entries WHERE CAST(video_id AS BIGINT) % 3 = 0),
first AS (SELECT video_id, min(pos) AS first_pos FROM req GROUP BY video_id)
SELECT r.video_id, r.pos.c AS conv_id, r.pos.t AS turn,
  coalesce(s.vector_store_id, 'vs_' || substr(sha256('transcript_' || r.video_id), 1, 24)) AS vector_store_id,
  coalesce(s.file_id, 'file-' || substr(sha256('transcript_' || r.video_id), 1, 24)) AS file_id,
  (s.video_id IS NOT NULL OR r.pos > f.first_pos) AS restored
FROM req r JOIN first f USING (video_id) LEFT JOIN stored s USING (video_id)""")
def q_restore_or_create_videos(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    req = c.filter(F.col("role") == "user").select(F.col("conv_id").cast("string").alias("video_id"),
                                                   F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t")).alias("pos"))
    return C.restore_or_create_videos(req, _stored_transcripts(spark, sf_dir)).select(
        "video_id", F.col("pos.c").alias("conv_id"), F.col("pos.t").alias("turn"), "vector_store_id", "file_id", "restored")
