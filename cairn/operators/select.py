"""Corpus selection: which listed files are usable, and which need converting.

Input: a DataFrame with ``path`` and, for the encoding test, either
``content`` (string) or ``content_bytes`` (binary).  Cheap path predicates
come first in their own ``filter`` so the bytes-dependent encoding test only
runs on survivors (the reference's 'cheap predicate first' ordering).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T

KEPT, CONVERTED = "kept", "converted"
REJECT_EXTENSION, REJECT_ENCODING = "rejected_extension", "rejected_encoding"
REJECT_DIRECTORY, REJECT_PATTERN = "rejected_directory", "rejected_pattern"


def filter_extension(df: DataFrame, path: str = "path") -> DataFrame:
    """Keep whitelisted or convertible suffixes (case-sensitive, last suffix)."""
    allowed = T.EXTENSION_WHITELIST + T.EXTENSIONS_CONVERT
    return df.filter(T.path_suffix(path).isin(*allowed))


def detect_encoding(df: DataFrame) -> DataFrame:
    """Add ``encoding`` ('ASCII' / 'UTF-8' / null) from the first 4 KB (of text, only these are encoded)."""
    if "content_bytes" in df.columns:
        return df.withColumn("encoding", T.detect_encoding("content_bytes"))
    head = F.encode(F.substring("content", 1, T.ENCODING_SAMPLE_BYTES), "UTF-8")
    return df.withColumn("encoding", T.detect_encoding(head, F.octet_length("content")))


def filter_encoding(df: DataFrame) -> DataFrame:
    if "encoding" not in df.columns:
        df = detect_encoding(df)
    return df.filter(F.col("encoding").isin(*T.ENCODING_WHITELIST))


def filter_directories(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(~T.in_blacklisted_directory(path))


def filter_patterns(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(~T.matches_blacklisted_pattern(path))


def classify(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``disposition``: the first failing test in the order extension,
    directory, pattern, encoding — else 'converted' for convertible suffixes,
    else 'kept'.  Every input row stays (dispositions partition the input)."""
    if "encoding" not in df.columns:
        df = detect_encoding(df)
    suffix = T.path_suffix(path)
    allowed = T.EXTENSION_WHITELIST + T.EXTENSIONS_CONVERT
    disposition = (
        F.when(~suffix.isin(*allowed), REJECT_EXTENSION)
         .when(T.in_blacklisted_directory(path), REJECT_DIRECTORY)
         .when(T.matches_blacklisted_pattern(path), REJECT_PATTERN)
         .when(~F.coalesce(F.col("encoding").isin(*T.ENCODING_WHITELIST), F.lit(False)),
               REJECT_ENCODING)
         .when(suffix.isin(*T.EXTENSIONS_CONVERT), CONVERTED)
         .otherwise(KEPT))
    return df.withColumn("disposition", disposition)


def select_files(df: DataFrame, path: str = "path") -> DataFrame:
    """Selected files (kept + to-convert) with ``disposition``.

    Path-only predicates run first; the encoding (needs bytes) runs last.
    """
    allowed = T.EXTENSION_WHITELIST + T.EXTENSIONS_CONVERT
    cheap = (df.filter(T.path_suffix(path).isin(*allowed))
               .filter(~T.in_blacklisted_directory(path))
               .filter(~T.matches_blacklisted_pattern(path)))
    return (filter_encoding(cheap)
            .withColumn("disposition",
                        F.when(T.path_suffix(path).isin(*T.EXTENSIONS_CONVERT), CONVERTED)
                         .otherwise(KEPT)))


def convert_extension(df: DataFrame, path: str = "path") -> DataFrame:
    """Convertible files get '<stem>.txt' in the same folder; content is untouched.

    Every row keeps its own content (two '.lua' files with one stem stay two rows).
    """
    is_conv = T.path_suffix(path).isin(*T.EXTENSIONS_CONVERT)
    new_path = F.concat(T.path_parent(path), T.path_stem(path), F.lit(".txt"))
    return df.withColumn("upload_path", F.when(is_conv, new_path).otherwise(F.col(path)))


def kept_files(selected: DataFrame) -> DataFrame:
    return selected.filter(F.col("disposition") == KEPT)


def convertible_files(selected: DataFrame) -> DataFrame:
    return selected.filter(F.col("disposition") == CONVERTED)


def union_selected(kept: DataFrame, converted: DataFrame) -> DataFrame:
    """Kept files followed by converted ones, as one DataFrame."""
    return kept.unionByName(convert_extension(converted).withColumn("path", F.col("upload_path"))
                            .drop("upload_path"), allowMissingColumns=True)


def except_converted(passing: DataFrame, path: str = "path") -> DataFrame:
    """Files passing every test minus the convertible ones.

    Whether a file is convertible depends on its own path only, so the set
    difference is a filter (no anti-join, no shuffle)."""
    return passing.filter(~T.path_suffix(path).isin(*T.EXTENSIONS_CONVERT))


def selection_stats(classified: DataFrame, group_cols=("source",)) -> DataFrame:
    """Per group: listed, kept unconverted (the reference's valid count),
    converted, and selected (kept + converted)."""
    d = F.col("disposition")
    return classified.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(d == KEPT).cast("bigint").alias("valid_count"),
        F.count_if(d == CONVERTED).cast("bigint").alias("converted_count"),
        F.count_if(d.isin(KEPT, CONVERTED)).cast("bigint").alias("selected_count"))
