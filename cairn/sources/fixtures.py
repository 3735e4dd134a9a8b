"""Views that shape the landed tables like the records the engine works on.

Each view is derived from whole tables (nothing is sampled or capped).  The
same definitions exist as SQL text for the DuckDB oracle in
``cairn.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.hashing import content_id, sha256_hex
from cairn.sources.tables import read_table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document: path '/corpus/<source>/[dir/]<lang>_<id><ext>', text as content."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    m9, m7 = F.col("doc_id") % 9, F.col("doc_id") % 7
    sub = (F.when(m9 == 0, ".git/").when(m9 == 1, "node_modules/")
            .when(m9 == 2, "pkg.egg-info/").otherwise(""))
    ext = (F.when(m7 == 0, ".py").when(m7 == 1, ".md").when(m7 == 2, ".txt").when(m7 == 3, ".lua")
            .when(m7 == 4, ".exe").when(m7 == 5, ".PY").otherwise(".html"))
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), sub, F.col("lang"), F.lit("_"),
                    F.col("doc_id").cast("string"), ext)
    return d.select("doc_id", path.alias("path"), "source", F.col("text").alias("content"))


def hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash -> file id of an earlier run: the files with doc_id % 3 = 0 (the batch is the rest)."""
    f = files(spark, sf_dir).filter(F.col("doc_id") % 3 == 0)
    h = sha256_hex("content")
    return (f.select(h.alias("hash"))
             .select("hash", content_id("file-", "hash").alias("file_id"))
             .distinct())  # file_id is a function of hash: one row per hash


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This run's files (doc_id % 3 <> 0), with their position in the run."""
    f = files(spark, sf_dir).filter(F.col("doc_id") % 3 != 0)
    return f.select(F.col("doc_id").alias("pos"), "path", "source", "content",
                    sha256_hex("content").alias("hash"))


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-file indexing status: 'completed' when the document has a label."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    labelled = read_table(spark, sf_dir, "labels", "doc_id").distinct().withColumn("_l", F.lit(True))
    return (d.join(labelled, "doc_id", "left")
             .select("doc_id", F.col("source").alias("store"),
                     F.when(F.col("_l"), "completed").otherwise("in_progress").alias("status"),
                     F.octet_length("text").cast("bigint").alias("bytes")))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool-call events: one call per user and day; purchase = done, signup = created."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    call_id = F.concat(F.col("user_id").cast("string"), F.lit("-"),
                       F.to_date("ts").cast("string"))
    phase = (F.when(F.col("event_type") == "purchase", "done")
              .when(F.col("event_type") == "signup", "created").otherwise("delta"))
    return e.select(call_id.alias("call_id"), phase.alias("phase"), F.col("event_id").alias("ord"),
                    F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("snapshot"))


def transcript_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("pos"),
                    "text",
                    (F.col("conv_id") * F.lit(1000.25) + F.col("turn") * F.lit(61.5)).alias("start"),
                    F.lit(61.5).alias("duration"))


def assistants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant registry: one per customer, default order = c_custkey."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return c.select(
        F.concat(F.lit("asst_"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("instructions"),
        (F.col("c_custkey") % 2 == 0).alias("file_search"),
        (F.col("c_nationkey") % 3 == 0).alias("interpret_code"),
        (F.col("c_mktsegment") == "BUILDING").alias("respond_with_json"),
        (F.lit(1704067200) + F.col("c_custkey") * 60).cast("bigint").alias("created_at"),
        F.col("c_custkey").alias("position"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
             .select(F.concat(F.lit("thread_"), F.col("o_orderkey").cast("string")).alias("id"),
                     F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
                     F.col("c_name").alias("assistant_name"),
                     F.concat(F.lit("asst_"), F.col("o_custkey").cast("string")).alias("assistant_id"),
                     F.col("o_orderdate").cast("timestamp").alias("created_at"),
                     F.col("o_orderkey").alias("position")))
