"""Registered queries: chunks, index, BM25 search, vector search, summaries,
question answering and the tool-call state machine (batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans import query_registry
from cairn.operators import block_index as BI
from cairn.operators import retrieval as RV
from cairn.operators import summarize as SM
from cairn.operators import toolcalls as TC
from cairn.operators import vector_index as VI
from cairn.plans import sqlx as X
from cairn.sources import fixtures as FX
from cairn.session import co_located, fresh_path, shared_dir
from cairn.sources.tables import read_table

QUERIES, ORACLE, register = query_registry()


SIZE, OVERLAP = 64, 16
STRIDE = SIZE - OVERLAP
TOP_K, ANSWER_K, VECTOR_K, SUMMARY_N = 3, 1, 5, 3


def _chunks(spark, sf_dir, colocate=False):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return RV.chunk_documents(co_located(docs, "doc_id", "text") if colocate else docs, size=SIZE, overlap=OVERLAP)


def _index(spark, sf_dir):
    """The search index of this corpus version, built once per application and
    shared by every search in it.

    Its location is keyed by the identity of all the documents' files (path, size,
    modification time), the chunk parameters and the application id, under the
    shared folder.  (A deployment would drop the application id to keep one
    index per corpus version across jobs; here it keeps every benchmark run cold.)
    """
    import hashlib

    src = f"{sf_dir.rstrip('/')}/documents.parquet"
    files = spark.read.parquet(src).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    # one row per file, folded into one row on the executors
    n, mark = files.distinct().agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*files.columns))).first()
    app = spark.sparkContext.applicationId
    key = hashlib.sha256(f"{src}|{n}|{mark}|{SIZE}|{OVERLAP}|{app}|v3".encode()).hexdigest()[:32]
    index = BI.BlockIndex(spark, f"{shared_dir(spark).rstrip('/')}/bm25/{key}")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    if not index.commits():
        if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # few files: spread their texts over all cores
            docs = docs.repartition("doc_id")
        index.add_chunks(RV.chunk_documents(docs, size=SIZE, overlap=OVERLAP), batch="corpus")
    return index.snapshot()


_CHUNKS_SQL = f"""
ch AS (
  SELECT doc_id, chunk_no, chunk_no * {STRIDE} AS start, tk[chunk_no * {STRIDE} + 1 : chunk_no * {STRIDE} + {SIZE}] AS tokens
  FROM (SELECT doc_id, tk, unnest(range(0, CASE WHEN len(tk) = 0 THEN 0 WHEN len(tk) <= {SIZE} THEN 1
                                       ELSE CAST(ceil((len(tk) - {SIZE}) / {STRIDE}.0) AS BIGINT) + 1 END)) AS chunk_no
        FROM (SELECT doc_id, {X.tokens('text')} AS tk FROM documents))),
chn AS (SELECT *, CAST(len(tokens) AS BIGINT) AS n_tokens FROM ch)"""


@register("chunk_documents", f"""
WITH {_CHUNKS_SQL.strip()}
SELECT doc_id, chunk_no, start, n_tokens, array_to_string(tokens, ' ') AS text FROM chn""")
def q_chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", "start", "n_tokens", "text")


@register("build_index", f"""
WITH {_CHUNKS_SQL.strip()},
post AS (SELECT doc_id, chunk_no, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, unnest(tokens) AS term FROM chn)
         GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term""")
def q_build_index(spark, sf_dir):
    _, stats = RV.build_index(_chunks(spark, sf_dir, colocate=True), colocated=True)
    return stats.select("term", "df", F.col("cf").cast("bigint").alias("cf"))


def _bm25_sql(questions: str, qid: str, k: int) -> str:
    return f"""
WITH {_CHUNKS_SQL.strip()},
post AS (SELECT doc_id, chunk_no, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, unnest(tokens) AS term FROM chn)
         GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(n_tokens) AS avgdl FROM chn),
q AS (SELECT DISTINCT {qid}, unnest({X.tokens('text')}) AS term FROM {questions}),
df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT q.{qid}, p.doc_id, p.chunk_no,
        round(sum(ln(1.0::DOUBLE + (stats.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * p.tf * 2.2::DOUBLE
              / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * c.n_tokens / stats.avgdl))), 6) AS score
      FROM q JOIN post p USING (term) JOIN df USING (term) JOIN chn c USING (doc_id, chunk_no) CROSS JOIN stats
      GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, doc_id, chunk_no) AS rank FROM s)
"""


@register("file_search", _bm25_sql("benchmark", "item_id", TOP_K) + f"""
SELECT item_id, rank, doc_id, chunk_no, score FROM r WHERE rank <= {TOP_K}""")
def q_file_search(spark, sf_dir):
    questions = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    hits = BI.search(questions, _index(spark, sf_dir), k=TOP_K, qid="item_id")
    return hits.select("item_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "chunk_no", "score")


def grown_index(spark, sf_dir):
    """An index that several runs have added to, replaced documents in and removed some from, with merges between:
    its live documents are the whole ``documents`` table, once each."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    index = BI.BlockIndex(spark, fresh_path(spark, "grown_index"))
    run = F.pmod(F.col("doc_id"), F.lit(5))
    # the first run has outdated texts, and documents that go again
    index.add(docs.select("doc_id", F.concat(F.lit("outdated text of "), F.reverse("text")).alias("text")).filter(run < 2)
                  .unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), "text").filter(run == 4)), SIZE, OVERLAP, batch="first")
    for n in range(5):
        index.add(docs.filter(run == n), SIZE, OVERLAP, batch=f"run {n}")
        index.merge()
    index.remove(docs.select((-F.col("doc_id") - 1).alias("doc_id")).filter(run.isNotNull()), batch="withdrawn")
    index.add(docs.filter(run == 4), SIZE, OVERLAP, batch="run 4")  # a repeated run adds nothing
    return index


@register("file_search_grown", ORACLE["file_search"])
def q_file_search_grown(spark, sf_dir):
    """The same answers from an index that grew by batches, replacements, removals and merges."""
    questions = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    hits = BI.search(questions, grown_index(spark, sf_dir).snapshot(), k=TOP_K, qid="item_id")
    return hits.select("item_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "chunk_no", "score")


_USER_Q = "(SELECT struct_pack(conv_id := conv_id, turn := turn) AS question_id, text FROM conversations WHERE role = 'user')"


def _prompts(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conv.filter(F.col("role") == "user").select(F.struct("conv_id", "turn").alias("question_id"), "text")


def _answers(spark, sf_dir, prompts):
    index = _index(spark, sf_dir)
    hits = BI.search(prompts, index, k=ANSWER_K, qid="question_id")
    passages = index.chunks.select("doc_id", "chunk_no", F.col("text").alias("passage"))
    return (hits.join(passages, ["doc_id", "chunk_no"])
                .select("question_id.conv_id", "question_id.turn", F.col("rank").cast("bigint").alias("rank"),
                        "doc_id", "chunk_no", "score", "passage"))


@register("answer_questions", _bm25_sql(_USER_Q, "question_id", ANSWER_K) + f"""
SELECT question_id.conv_id AS conv_id, question_id.turn AS turn, rank, r.doc_id, r.chunk_no, score,
  array_to_string(c.tokens, ' ') AS passage
FROM r JOIN chn c USING (doc_id, chunk_no) WHERE rank <= {ANSWER_K}""")
def q_answer_questions(spark, sf_dir):
    return _answers(spark, sf_dir, _prompts(spark, sf_dir))


@register("append_turns", _bm25_sql(_USER_Q, "question_id", 1) + """
SELECT conv_id, turn, 0 AS step, 'user' AS role, text, '' AS source_doc FROM conversations WHERE role = 'user'
UNION ALL
SELECT r.question_id.conv_id, r.question_id.turn, 1, 'assistant', array_to_string(c.tokens, ' '), CAST(r.doc_id AS VARCHAR)
FROM r JOIN chn c USING (doc_id, chunk_no) WHERE rank = 1""")
def q_append_turns(spark, sf_dir):
    """The threads as extended: every prompt (step 0), followed by the best passage as its answer (step 1)."""
    prompts = _prompts(spark, sf_dir)
    asked = prompts.select("question_id.conv_id", "question_id.turn", F.lit(0).alias("step"), F.lit("user").alias("role"),
                           "text", F.lit("").alias("source_doc"))
    answered = _answers(spark, sf_dir, prompts).filter(F.col("rank") == 1).select(
        "conv_id", "turn", F.lit(1).alias("step"), F.lit("assistant").alias("role"), F.col("passage").alias("text"),
        F.col("doc_id").cast("string").alias("source_doc"))
    return asked.unionByName(answered)


@register("vector_topk", f"""
WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i) GROUP BY label),
s AS (SELECT c.label, v.vec_id, round(list_cosine_similarity(c.q, CAST(v.embedding AS DOUBLE[])), 6) AS score
      FROM c CROSS JOIN embeddings v)
SELECT label, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {VECTOR_K}""")
def q_vector_topk(spark, sf_dir):
    """Nearest vectors to each label's centroid."""
    vec = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    queries = RV.centroids(vec, "label", "embedding")
    hits = RV.vector_topk(vec.select("vec_id", "embedding"), queries, k=VECTOR_K)
    return hits.select("label", F.col("rank").cast("bigint").alias("rank"), "vec_id", "score")


RECALL_K = 10


def _vector_index_search(spark, sf_dir):
    """(index, queries, hits): every row whose id is divisible by 20 as a query against all rows."""
    vec = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    asked = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding").filter(F.col("vec_id") % 20 == 0)
    queries = asked.select(F.col("vec_id").alias("query_id"), "embedding")
    return vec, queries, VI.search_vectors(VI.build_vector_index(vec), queries, k=RECALL_K, qid="query_id")


@register("vector_topk_approx")
def q_vector_topk_approx(spark, sf_dir):
    """Nearest vectors by the approximate index; scores are exact cosines."""
    _, _, hits = _vector_index_search(spark, sf_dir)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "score")


@register("vector_index_recall")
def q_vector_index_recall(spark, sf_dir):
    """Per query, the share of the exact top answers that the approximate index finds."""
    vec, queries, hits = _vector_index_search(spark, sf_dir)
    return VI.recall(hits, RV.vector_topk(vec, queries, k=RECALL_K, qid="query_id"), "query_id")


def _summary_sql(units: str, unit: str, part: str) -> str:
    return f"""
WITH s0 AS (SELECT {unit}, {part} AS part, unnest({X.sentences('text')}) AS raw,
                   unnest(range(len({X.sentences('text')}))) AS i FROM {units}),
s AS (SELECT {unit}, struct_pack(part := part, i := i) AS s_ord, trim(raw) AS sentence FROM s0 WHERE length(trim(raw)) > 0),
t AS (SELECT {unit}, s_ord, unnest({X.tokens('sentence')}) AS term FROM s),
tf AS (SELECT {unit}, term, count(*) AS tf FROM t GROUP BY ALL),
sc AS (SELECT t.{unit}, t.s_ord, sum(tf.tf) / count(*) AS score FROM t JOIN tf USING ({unit}, term) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {unit} ORDER BY score DESC, s_ord) AS r FROM sc)
         WHERE r <= {SUMMARY_N}),
summ AS (SELECT b.{unit}, string_agg(s.sentence, ' ' ORDER BY b.s_ord) AS summary FROM best b JOIN s USING ({unit}, s_ord)
         GROUP BY b.{unit}),
cnt AS (SELECT {unit}, count(*) AS n_sentences FROM s GROUP BY {unit})
SELECT cnt.{unit}, coalesce(summary, '') AS summary, n_sentences FROM cnt LEFT JOIN summ USING ({unit})"""


@register("summarize_documents", _summary_sql("documents", "doc_id", "0"))
def q_summarize_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return SM.summarize(d, "doc_id", "text", None, SUMMARY_N, colocate=True).select(
        "doc_id", "summary", "n_sentences")


@register("summarize_threads", _summary_sql("conversations", "conv_id", "turn"))
def q_summarize_threads(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return SM.summarize(c, "conv_id", "text", "turn", SUMMARY_N).select("conv_id", "summary", "n_sentences")


def _reweighted_sql(units: str, unit: str, part: str) -> str:
    ctes = [f"""
WITH s0 AS (SELECT {unit}, {part} AS part, unnest({X.sentences('text')}) AS raw,
                   unnest(range(len({X.sentences('text')}))) AS i FROM {units}),
s AS MATERIALIZED (SELECT {unit}, struct_pack(part := part, i := i) AS s_ord, trim(raw) AS sentence FROM s0 WHERE length(trim(raw)) > 0),
t AS (SELECT {unit}, s_ord, unnest({X.tokens('sentence')}) AS term FROM s),
h0 AS MATERIALIZED (SELECT {unit}, s_ord, term, count(*) AS n FROM t GROUP BY ALL),
w0 AS MATERIALIZED (SELECT {unit}, term, CAST(sum(n) * {SM.WEIGHT} // sum(sum(n)) OVER (PARTITION BY {unit}) AS BIGINT) AS w
                    FROM h0 GROUP BY {unit}, term)"""]
    for r in range(SUMMARY_N):
        ctes.append(f"""
n{r} AS MATERIALIZED (SELECT {unit}, term, s_ord, n, w FROM h{r} JOIN w{r} USING ({unit}, term)),
top{r} AS (SELECT {unit}, term FROM (SELECT {unit}, term, row_number() OVER (PARTITION BY {unit} ORDER BY w DESC, term) AS k FROM n{r})
           WHERE k = 1),
sc{r} AS (SELECT a.{unit}, a.s_ord, CAST(sum(a.w * a.n) * 1000 // sum(a.n) AS BIGINT) AS score
          FROM n{r} a LEFT JOIN top{r} b ON a.{unit} = b.{unit} AND a.term = b.term
          GROUP BY a.{unit}, a.s_ord HAVING bool_or(b.term IS NOT NULL)),
p{r} AS MATERIALIZED (SELECT {unit}, s_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY {unit} ORDER BY score DESC, s_ord) AS k FROM sc{r}) WHERE k = 1),
said{r} AS (SELECT DISTINCT {unit}, term, true AS said FROM h{r} SEMI JOIN p{r} USING ({unit}, s_ord)),
h{r + 1} AS MATERIALIZED (SELECT * FROM h{r} ANTI JOIN p{r} USING ({unit}, s_ord)),
w{r + 1} AS MATERIALIZED (SELECT {unit}, term, CASE WHEN said THEN w * w // {SM.WEIGHT} ELSE w END AS w
                          FROM w{r} LEFT JOIN said{r} USING ({unit}, term))""")
    picks = " UNION ALL ".join(f"SELECT * FROM p{r}" for r in range(SUMMARY_N))
    return ",".join(ctes) + f""",
summ AS (SELECT b.{unit}, string_agg(s.sentence, ' ' ORDER BY b.s_ord) AS summary FROM ({picks}) b JOIN s USING ({unit}, s_ord)
         GROUP BY b.{unit}),
cnt AS (SELECT {unit}, count(*) AS n_sentences FROM s GROUP BY {unit})
SELECT cnt.{unit}, coalesce(summary, '') AS summary, n_sentences FROM cnt LEFT JOIN summ USING ({unit})"""


@register("summarize_documents_reweighted", _reweighted_sql("documents", "doc_id", "0"))
def q_summarize_documents_reweighted(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return SM.summarize_reweighted(d, "doc_id", "text", None, SUMMARY_N, colocate=True).select("doc_id", "summary", "n_sentences")


@register("summarize_threads_reweighted", _reweighted_sql("conversations", "conv_id", "turn"))
def q_summarize_threads_reweighted(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return SM.summarize_reweighted(c, "conv_id", "text", "turn", SUMMARY_N).select("conv_id", "summary", "n_sentences")


# ----------------------------------------------------------------- tool calls

_FIRST_DONE = "(SELECT call_id, min(ord) AS done FROM tool_events WHERE phase = 'done' GROUP BY call_id)"


@register("tool_calls", f"""
SELECT e.call_id, e.ord, e.phase, d.done IS NOT NULL AS completed
FROM tool_events e LEFT JOIN {_FIRST_DONE} d USING (call_id) WHERE d.done IS NULL OR e.ord <= d.done""")
def q_tool_calls(spark, sf_dir):
    return TC.kept_events(FX.tool_events(spark, sf_dir)).select("call_id", "ord", "phase", "completed")


@register("tool_call_states", f"""
SELECT e.call_id, count(*) AS n_events, bool_or(d.done IS NOT NULL) AS completed, max(e.ord) AS last_ord,
  arg_max(e.snapshot, e.ord) AS snapshot
FROM tool_events e LEFT JOIN {_FIRST_DONE} d USING (call_id) WHERE d.done IS NULL OR e.ord <= d.done
GROUP BY e.call_id""")
def q_tool_call_states(spark, sf_dir):
    return TC.call_states(FX.tool_events(spark, sf_dir))
