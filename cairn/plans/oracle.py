"""DuckDB text of the fixture views, prepended as CTEs to each oracle query.

The driver pre-registers the landed tables as views; these CTEs rebuild the
derived views exactly as ``cairn.sources.fixtures`` does on Spark.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "files": r"""
SELECT doc_id,
  concat('/corpus/', source, '/',
    CASE doc_id % 9 WHEN 0 THEN '.git/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'pkg.egg-info/' ELSE '' END,
    lang, '_', CAST(doc_id AS VARCHAR),
    CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' WHEN 3 THEN '.lua'
                    WHEN 4 THEN '.exe' WHEN 5 THEN '.PY' ELSE '.html' END) AS path,
  source, text AS content
FROM documents""",
    "hash_cache": r"""
SELECT DISTINCT sha256(content) AS hash, concat('file-', substr(sha256(content), 1, 24)) AS file_id
FROM files WHERE doc_id % 3 = 0""",
    "batch": r"""
SELECT doc_id AS pos, path, source, content, sha256(content) AS hash
FROM files WHERE doc_id % 3 <> 0""",
    "file_status": r"""
SELECT d.doc_id, d.source AS store,
  CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'completed' ELSE 'in_progress' END AS status,
  CAST(octet_length(encode(d.text)) AS BIGINT) AS bytes
FROM documents d""",
    "tool_events": r"""
SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS call_id,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'created' ELSE 'delta' END AS phase,
  event_id AS ord, ts, props AS snapshot
FROM events""",
    "transcript_entries": r"""
SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS pos, text,
  CAST(conv_id * 1000.25 + turn * 61.5 AS DOUBLE) AS start, CAST(61.5 AS DOUBLE) AS duration
FROM conversations""",
    "assistants": r"""
SELECT 'asst_' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS instructions,
  c_custkey % 2 = 0 AS file_search, c_nationkey % 3 = 0 AS interpret_code,
  c_mktsegment = 'BUILDING' AS respond_with_json,
  CAST(1704067200 + c_custkey * 60 AS BIGINT) AS created_at, c_custkey AS position
FROM customer""",
    "threads": r"""
SELECT 'thread_' || CAST(o_orderkey AS VARCHAR) AS id, 'order ' || CAST(o_orderkey AS VARCHAR) AS name,
  c.c_name AS assistant_name, 'asst_' || CAST(o_custkey AS VARCHAR) AS assistant_id,
  o_orderdate AS created_at, o_orderkey AS position
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
}

# Views that read other views, so CTE order matters.
_DEPENDS = {"hash_cache": ["files"], "batch": ["files"]}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every fixture view it mentions (dependencies first)."""
    used: list[str] = []

    def need(name: str):
        for dep in _DEPENDS.get(name, []):
            need(dep)
        if name not in used:
            used.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
