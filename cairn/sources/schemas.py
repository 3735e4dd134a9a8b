"""Declared record schemas (the reference's dataclasses, as StructTypes)."""

from __future__ import annotations

from pyspark.sql import types as T

FILE_METADATA = T.StructType([
    T.StructField("hash", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("full_path", T.StringType()), T.StructField("sz_bytes", T.LongType()),
    T.StructField("created_at", T.DoubleType()), T.StructField("last_modified_at", T.DoubleType()),
    T.StructField("last_accessed_at", T.DoubleType()),
    T.StructField("vector_store_id", T.StringType()), T.StructField("file_id", T.StringType())])

THREAD_RECORD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("assistant_name", T.StringType()), T.StructField("assistant_id", T.StringType()),
    T.StructField("created_at", T.TimestampType())])

ASSISTANT_RECORD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("instructions", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("file_search", T.BooleanType()), T.StructField("interpret_code", T.BooleanType()),
    T.StructField("respond_with_json", T.BooleanType()), T.StructField("description", T.StringType()),
    T.StructField("temperature", T.DoubleType()), T.StructField("top_p", T.DoubleType()),
    T.StructField("created_at", T.LongType())])
