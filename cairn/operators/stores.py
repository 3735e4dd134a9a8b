"""Stores: membership, contents, status roll-ups and size labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.hashing import content_id, sha256_hex
from cairn.functions.ordinal import group_ordinal

STORE_ID_PREFIX = "vs_"


def store_id(name_col) -> "F.Column":
    return content_id(STORE_ID_PREFIX, sha256_hex(name_col))


def build_store(files: DataFrame, store: str = "store", order: str = "path") -> DataFrame:
    """Store membership, exploded: one row per (store, position, file_id).

    Duplicated file ids stay.  Positions come from a distributed ordinal, so
    a store holding a large share of all files is still numbered in parallel
    (no per-store array is ever collected).
    """
    members = files.select(store, order, "file_id")
    return (group_ordinal(members, [store], [order, "file_id"], "position")
            .withColumn("store_id", store_id(F.col(store))))


def first_files(files: DataFrame, store: str = "store", order: str = "path") -> DataFrame:
    """(store, store_id, path, file_id) of each store's first file: one partially aggregated
    minimum a store, no numbering."""
    first = files.groupBy(store).agg(F.min(F.struct(F.col(order).alias("path"), "file_id")).alias("f"))
    return first.select(store, store_id(F.col(store)).alias("store_id"), "f.path", "f.file_id")


def file_contents(df: DataFrame, path: str = "path", pos: str = "pos",
                  content: str = "content") -> DataFrame:
    """Path -> content; when a path repeats, the last one (highest pos) wins."""
    return df.groupBy(path).agg(F.max_by(content, pos).alias(content))


def store_status(status: DataFrame, store: str = "store") -> DataFrame:
    """Roll-up per store: counts by status, bytes, readiness and a display line."""
    agg = status.groupBy(store).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").cast("bigint").alias("completed"),
        F.count_if(F.col("status") == "in_progress").cast("bigint").alias("in_progress"),
        F.sum("bytes").cast("bigint").alias("usage_bytes"))
    sid = store_id(F.col(store))
    size = T.size_label("usage_bytes")
    return agg.select(
        sid.alias("id"), F.col(store).alias("name"),
        F.when(F.col("in_progress") == 0, "completed").otherwise("in_progress").alias("status"),
        "total", "completed", "in_progress", "usage_bytes", size.alias("size_label"),
        F.format_string("%s (%s), %d/%d file(s), %s", sid, F.col(store), F.col("completed"),
                        F.col("total"), size).alias("info"))
