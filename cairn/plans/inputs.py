"""Registered queries: input routing, URL handling, page ingest, reject rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans import query_registry
from cairn.functions import text as T
from cairn.operators import route as R
from cairn.plans import sqlx as X
from cairn.sources import fixtures as FX
from cairn.sources.tables import read_table

QUERIES, ORACLE, register = query_registry()


# Fixed literal inputs: the landed pages contain no video URL and no exit word.
EXTRA_INPUTS = (
    "exit", "QUIT", ":q", " exit", "https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1",
    "https://youtu.be/dQw4w9WgXcQ", "https://www.youtube.com/channel/UC1234567890abcdefghijkl",
    "https://youtu.be/x", "notyoutube.com/", "https://a.b/?u=youtu.be/", "https://example.com/",
    "not a path", "/corpus/missing.py", "ftp://files.example.org/pub/readme.txt",
)
# Fixed literal Content-Type headers beyond what the landed pages carry.
EXTRA_CONTENT_TYPES = ("text/html; charset=utf-8", "text/plain", "application/pdf", "image/png", "",
                       "text/htmlx")
# Fixed literal store-id lists exercising every check outcome.
EXTRA_STORE_REFS = ((("vs_1",), "ok"), ((), "empty list"), (("a", "b"), "two ids"), (("x",), "bad prefix"),
                    (("",), "empty id"))


def _inputs(spark, sf_dir):
    files = FX.files(spark, sf_dir).select("path")
    entries = R.listing_entries(files).select(F.col("path").alias("input"))
    urls = read_table(spark, sf_dir, "pages", "url").select(F.col("url").alias("input"))
    made = urls.select(F.explode(F.array(*_made_inputs(F.md5("input")))).alias("input"))
    extra = spark.createDataFrame([(x,) for x in EXTRA_INPUTS], "input string")
    return entries.unionByName(urls).unionByName(made).unionByName(extra), files


def _made_inputs(digest):
    """Inputs that the pages themselves lack, one of each for every page: a video by its
    11-character id in both URL forms, a video URL without an id, and a name of nothing."""
    return [F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(digest, 1, 11)),
            F.concat(F.lit("https://youtu.be/"), F.substring(digest, 12, 11)),
            F.concat(F.lit("https://youtu.be/"), F.substring(digest, 1, 5)),
            F.concat(F.lit("missing "), digest)]


def _routed(spark, sf_dir):
    inputs, files = _inputs(spark, sf_dir)
    return R.extract_video_ids(R.route_inputs(inputs, files))


_LISTING = """
listing AS (
  SELECT path, 'file' AS kind FROM files
  UNION ALL
  SELECT DISTINCT d AS path, 'directory' AS kind FROM (
    SELECT unnest(list_transform(range(2, len(string_split(path, '/'))),
                  lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS d FROM files))"""

_INPUTS = f"""
inputs AS (
  SELECT path AS input FROM listing
  UNION ALL SELECT url FROM pages
  UNION ALL SELECT unnest(['https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11),
    'https://youtu.be/' || substr(md5(url), 12, 11), 'https://youtu.be/' || substr(md5(url), 1, 5),
    'missing ' || md5(url)]) FROM pages
  UNION ALL SELECT * FROM (VALUES {', '.join('(' + X.q(x) + ')' for x in EXTRA_INPUTS)}) v(input))"""

_KIND = f"""CASE WHEN lower(i.input) IN ('exit', 'quit', ':q') THEN 'exit'
  WHEN l.kind IS NOT NULL THEN l.kind
  WHEN regexp_matches(i.input, {X.q(T.URL_PATTERN)}) AND regexp_matches(i.input, {X.q(T.VIDEO_URL_PATTERN)}) THEN 'video'
  WHEN regexp_matches(i.input, {X.q(T.URL_PATTERN)}) THEN 'web'
  ELSE 'unsupported' END"""

_ROUTED = f"""WITH {_LISTING.strip()}, {_INPUTS.strip()},
routed AS (SELECT i.input, {_KIND} AS kind,
  nullif(regexp_extract(i.input, {X.q(T.VIDEO_ID_PATTERN)}, 1), '') AS video_id
  FROM inputs i LEFT JOIN listing l ON i.input = l.path)"""


@register("route_inputs", _ROUTED + "\nSELECT input, kind FROM routed")
def q_route_inputs(spark, sf_dir):
    return _routed(spark, sf_dir).select("input", "kind")


@register("clean_inputs", """
SELECT conv_id, turn, regexp_replace(array_to_string(string_split(text, ' '), ''), '^[''"]+|[''"]+$', '', 'g') AS input
FROM conversations WHERE role = 'user'""")
def q_clean_inputs(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    parts = c.filter(F.col("role") == "user").select("conv_id", "turn", F.split("text", " ").alias("parts"))
    return R.clean_inputs(parts).select("conv_id", "turn", "input")


def _sniff_sql(body: str) -> str:
    return (f"CASE WHEN regexp_matches({body}, {X.q(T.HTML_START)}) "
            f"THEN 'text/html; charset=utf-8' WHEN substr({body}, 1, 5) = '%PDF-' THEN 'application/pdf' "
            f"ELSE 'text/plain' END")


def _ext_sql(h: str) -> str:
    out = "NULL"
    for ctype, ext in reversed(T.CONTENT_TYPES):
        out = f"CASE WHEN starts_with({h}, {X.q(ctype)}) THEN {X.q(ext)} ELSE {out} END"
    return out


@register("resolve_content_type", f"""
WITH h AS (SELECT 'page_' || CAST(page_id AS VARCHAR) AS source, {_sniff_sql('html')} AS content_type FROM pages
  UNION ALL SELECT 'literal_' || CAST(i AS VARCHAR), ct FROM (VALUES {', '.join(f'({i}, {X.q(c)})' for i, c in enumerate(EXTRA_CONTENT_TYPES))}) v(i, ct))
SELECT source, content_type, {_ext_sql('content_type')} AS extension FROM h""")
def q_resolve_content_type(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", "page_id", "html")
    pages = p.select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("source"),
                     R.sniff_content_type(F.col("html")).alias("content_type"))
    extra = spark.createDataFrame([(f"literal_{i}", c) for i, c in enumerate(EXTRA_CONTENT_TYPES)],
                                  "source string, content_type string")
    return R.resolve_content_type(pages.unionByName(extra)).select("source", "content_type", "extension")


@register("classify_video_urls", _ROUTED + f"""
SELECT input, regexp_matches(input, {X.q(T.VIDEO_URL_PATTERN)}) AS is_video FROM inputs""")
def q_classify_video_urls(spark, sf_dir):
    inputs, _ = _inputs(spark, sf_dir)
    return inputs.select("input", T.is_video_url("input").alias("is_video"))


@register("extract_video_id", _ROUTED + "\nSELECT input, video_id FROM routed WHERE kind = 'video'")
def q_extract_video_id(spark, sf_dir):
    return _routed(spark, sf_dir).filter(F.col("kind") == "video").select("input", "video_id")


_STORE_REFS = [(f"literal:{label}", list(ids)) for ids, label in EXTRA_STORE_REFS]


@register("check_store_refs", _ROUTED + f"""
, refs AS (
  SELECT input, CASE WHEN kind IN ('file', 'directory', 'web') OR (kind = 'video' AND video_id IS NOT NULL)
    THEN ['vs_' || substr(sha256(CASE WHEN kind = 'video' THEN 'transcript_' || video_id ELSE input END), 1, 24)]
    ELSE []::VARCHAR[] END AS ids FROM routed
  UNION ALL SELECT * FROM (VALUES {', '.join(f"({X.q(k)}, {('[' + ', '.join(X.q(i) for i in ids) + ']') if ids else '[]::VARCHAR[]'})" for k, ids in _STORE_REFS)}) v(input, ids))
SELECT input, CAST(len(ids) AS INTEGER) AS n_ids,
  CASE WHEN len(ids) = 0 THEN 'Resources object has no vector store id.'
       WHEN len(ids) > 1 THEN 'Resources object has more than 1 vector store id associated with it.'
       WHEN length(ids[1]) = 0 THEN 'empty'
       WHEN NOT starts_with(ids[1], 'vs_') THEN 'invalid format' END AS store_error
FROM refs""")
def q_check_store_refs(spark, sf_dir):
    routed = R.resources(_routed(spark, sf_dir)).select("input", "vector_store_ids")
    extra = spark.createDataFrame(_STORE_REFS, "input string, vector_store_ids array<string>")
    checked = R.check_store_refs(routed.unionByName(extra))
    return checked.select("input", F.size("vector_store_ids").alias("n_ids"), "store_error")


@register("rejected_inputs", _ROUTED + """
SELECT input,
  CASE WHEN kind = 'unsupported' THEN 'NotSupportedError' ELSE 'ValueError' END AS error_class,
  CASE WHEN kind = 'unsupported' THEN 'Failed to vectorize data. Your input is not yet supported.'
       ELSE 'Invalid YouTube video URL' END AS message
FROM routed WHERE kind = 'unsupported' OR (kind = 'video' AND video_id IS NULL)""")
def q_rejected_inputs(spark, sf_dir):
    return R.rejected_inputs(_routed(spark, sf_dir))


@register("ingest_pages", f"""
SELECT page_id, url, {_sniff_sql('html')} AS content_type, {_ext_sql(_sniff_sql('html'))} AS extension,
  'page_' || CAST(page_id AS VARCHAR) || coalesce({_ext_sql(_sniff_sql('html'))}, '') AS name,
  sha256(html) AS hash, CAST(octet_length(encode(html)) AS BIGINT) AS sz_bytes
FROM pages WHERE NOT regexp_matches(url, {X.q(T.VIDEO_URL_PATTERN)}) AND {_ext_sql(_sniff_sql('html'))} IS NOT NULL""")
def q_ingest_pages(spark, sf_dir):
    return R.ingest_pages(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
