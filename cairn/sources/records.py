"""Record persistence: JSON round trips and the hash-cache table.

Records are rows with a declared schema: saved as JSON lines (``to_json`` of
the row struct) or Parquet, loaded back with the same schema.  The hash cache
is a two-column table unique on ``hash``; loading a missing cache yields an
empty DataFrame of the right schema instead of failing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_CACHE_SCHEMA = T.StructType([T.StructField("hash", T.StringType()),
                                  T.StructField("file_id", T.StringType())])


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row (all columns)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def from_json_lines(lines: DataFrame, schema: T.StructType, col: str = "json") -> DataFrame:
    return lines.select(F.from_json(F.col(col), schema).alias("r")).select("r.*")


def save_records(df: DataFrame, path: str, mode: str = "json", compress: bool = False) -> None:
    w = df.write.mode("overwrite")
    if mode == "json":
        (w.option("compression", "gzip") if compress else w).json(path)
    elif mode == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown mode {mode!r}")


def load_records(spark: SparkSession, path: str, schema: T.StructType, mode: str = "json") -> DataFrame:
    r = spark.read.schema(schema)
    return r.json(path) if mode == "json" else r.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    import pyarrow.fs as pafs
    import posixpath
    fs, base = pafs.FileSystem.from_uri(path if "://" in path else "file://" + posixpath.abspath(path))
    return fs.get_file_info(base).type != pafs.FileType.NotFound


def load_hash_cache(spark: SparkSession, path: str) -> DataFrame:
    """The saved cache, or an empty one when nothing was saved yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], HASH_CACHE_SCHEMA)
    return spark.read.schema(HASH_CACHE_SCHEMA).parquet(path)


def save_hash_cache(cache: DataFrame, path: str) -> None:
    """Write the cache (one row per hash) as a new table version at ``path``."""
    cache.select("hash", "file_id").dropDuplicates(["hash"]).write.mode("overwrite").parquet(path)
