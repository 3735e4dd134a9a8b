"""Registered queries: file trees, corpus read/write, record round trips, hashes.

Each query first lands data that Spark derives from the tables into a fresh
folder under the session's shared folder (``spark.checkpoint.dir``), then
reads it back through the source under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans import query_registry
from cairn.functions.hashing import content_id
from cairn.operators import cache as C
from cairn.session import fresh_path
from cairn.sources import files as FS
from cairn.sources import fixtures as FX
from cairn.sources import records as RC
from cairn.sources.tables import read_table
from cairn.sources.schemas import THREAD_RECORD

QUERIES, ORACLE, register = query_registry()


def _land(spark, sf_dir, compress=None):
    root = fresh_path(spark, "landed")
    landed = FS.land_files(FX.files(spark, sf_dir), root, compress=compress)
    landed.write.mode("overwrite").parquet(root + "_manifest")  # runs the landing job, keeps a manifest
    return root


def _rel(col="path"):
    return F.regexp_extract(F.col(col), r"(/corpus/.*)$", 1)


@register("scan_files", """
SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS length FROM files""")
def q_scan_files(spark, sf_dir):
    root = _land(spark, sf_dir)
    return FS.scan_files(spark, root).select(_rel().alias("path"), "length")


@register("walk_files", """
SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS length FROM files""")
def q_walk_files(spark, sf_dir):
    root = _land(spark, sf_dir)
    return FS.walk_files(spark, root).select(_rel().alias("path"), "length")


@register("fingerprint_blocks", """
SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS length, sha256(content) AS hash FROM files""")
def q_fingerprint_blocks(spark, sf_dir):
    """Landed files, hashed in 64 MB blocks (a file of one block has its plain SHA-256)."""
    root = _land(spark, sf_dir)
    return FS.tree_fingerprints(FS.scan_files(spark, root), root).select(_rel().alias("path"), "length", "hash")


@register("read_corpus", """
SELECT path || CASE WHEN doc_id % 5 = 0 THEN '.gz' ELSE '' END AS path, content AS text FROM files""")
def q_read_corpus(spark, sf_dir):
    root = _land(spark, sf_dir, compress=(F.col("doc_id") % 5 == 0))
    return FS.read_corpus(spark, root).select(_rel().alias("path"), "text")


@register("read_text_corpus", """
SELECT path || CASE WHEN doc_id % 5 = 0 THEN '.gz' ELSE '' END AS path, content AS text FROM files""")
def q_read_text_corpus(spark, sf_dir):
    root = _land(spark, sf_dir, compress=(F.col("doc_id") % 5 == 0))
    return FS.read_text_corpus(spark, root).select(_rel().alias("path"), "text")


@register("file_metadata", """
SELECT sha256(content) AS hash, regexp_extract(path, '([^/]*)$', 1) AS name, path AS full_path,
  CAST(octet_length(encode(content)) AS BIGINT) AS sz_bytes, true AS has_mtime
FROM files""")
def q_file_metadata(spark, sf_dir):
    root = _land(spark, sf_dir)
    raw = FS.scan_contents(spark, root).withColumn("path", _rel())
    meta = C.file_metadata(raw, "path", "content")
    return meta.select("hash", "name", "full_path", "sz_bytes",
                       F.col("last_modified_at").isNotNull().alias("has_mtime"))


@register("write_corpus", "SELECT doc_id, text FROM documents")
def q_write_corpus(spark, sf_dir):
    out = fresh_path(spark, "corpus")
    FS.write_corpus(read_table(spark, sf_dir, "documents", "doc_id", "text"), out, "json", compress=True)
    return spark.read.schema("doc_id bigint, text string").json(out)


@register("json_roundtrip", """
SELECT id, name, assistant_name, assistant_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM threads""")
def q_json_roundtrip(spark, sf_dir):
    out = fresh_path(spark, "records")
    t = FX.threads(spark, sf_dir).select("id", "name", "assistant_name", "assistant_id", "created_at")
    RC.to_json_lines(t).write.mode("overwrite").option("compression", "gzip").text(out)
    back = RC.from_json_lines(spark.read.text(out).withColumnRenamed("value", "json"), THREAD_RECORD)
    return back.select("id", "name", "assistant_name", "assistant_id",
                       F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@register("load_hash_cache", """
SELECT DISTINCT sha256(content) AS hash, 'file-' || substr(sha256(content), 1, 24) AS file_id FROM files""")
def q_load_hash_cache(spark, sf_dir):
    path = fresh_path(spark, "hash_cache")
    empty = RC.load_hash_cache(spark, path)  # nothing saved yet -> empty cache, same schema
    every = C.fingerprint(FX.files(spark, sf_dir).select("content")).select("hash", content_id("file-", "hash").alias("file_id"))
    RC.save_hash_cache(empty.unionByName(every.distinct()), path)
    return RC.load_hash_cache(spark, path)
