"""Content-addressed ingest: fingerprint, reuse earlier ids, remember new ones.

Duplicates are resolved with per-hash aggregates, written and joined back on the
hash: partial aggregation absorbs a hash that holds a third of the batch, and
AQE splits the skewed join partition, as both its sides are scans with a shuffle
of their own.  Never a window over a hot hash.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashing import content_id, hash_udf, sha256_hex
from cairn.functions import text as T
from cairn.session import written

FILE_ID_PREFIX = "file-"
STORE_ID_PREFIX = "vs_"
FILTER_WORDS = 8  # words of 64 bits in a filter's block, and bits a key sets
FILTER_BYTES = 64 << 20  # a filter up to this size is broadcast


def fingerprint(df: DataFrame, content: str = "content", out: str = "hash", algorithm: str = "sha256") -> DataFrame:
    """Hex digest of the content (string as UTF-8, or binary; null: null).  SHA-256 is built in;
    the other ``ALGORITHMS`` go through Arrow batches."""
    return df.withColumn(out, sha256_hex(content) if algorithm == "sha256" else hash_udf(algorithm)(content))


def first_positions(batch: DataFrame, key: str = "hash", pos: str = "pos") -> DataFrame:
    return written(batch.groupBy(key).agg(F.min(pos).alias("first_pos")), "first_positions")


def batch_duplicates(batch: DataFrame, key: str = "hash", pos: str = "pos") -> DataFrame:
    """Rows whose key already occurred earlier in the same batch."""
    return (batch.join(first_positions(batch, key, pos), key)
                 .filter(F.col(pos) > F.col("first_pos")))


def assign_file_ids(batch: DataFrame, cache: DataFrame, key: str = "hash",
                    pos: str = "pos") -> DataFrame:
    """Per batch row: ``file_id`` and ``cached``.

    A hash found in ``cache(hash, file_id)`` reuses its id; a miss gets an id
    derived from the hash, and later rows with that hash in the same batch
    count as cached (the id was remembered at once).
    """
    cached_ids = cache.select(F.col(key), F.col("file_id").alias("_cached_id"))
    # one row per hash, so the batch is joined once
    known = written(batch.groupBy(key).agg(F.min(pos).alias("first_pos")).join(cached_ids, key, "left"), "known_hashes")
    return _with_ids(batch, known, key, pos)


def _with_ids(batch: DataFrame, known: DataFrame, key: str, pos: str) -> DataFrame:
    return (batch.join(known, key)
                 .withColumn("file_id", F.coalesce("_cached_id", content_id(FILE_ID_PREFIX, key)))
                 .withColumn("cached", F.col("_cached_id").isNotNull() | (F.col(pos) > F.col("first_pos")))
                 .drop("_cached_id", "first_pos"))


def filter_geometry(n: int, error: float = 0.01) -> int:
    """Blocks of a filter that lets about ``error`` of the absent keys pass when it holds ``n``."""
    bits = -FILTER_WORDS / math.log(1 - error ** (1 / FILTER_WORDS))  # a key, as for a plain Bloom filter
    return max(1, math.ceil(1.25 * n * bits / (64 * FILTER_WORDS)))  # keys spread unevenly over blocks: a quarter more


def _filter_bits(key: str, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block, and its bit in each of the block's words."""
    second = F.xxhash64(F.lit("bits"), key)
    return (F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"),
            [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(second, 6 * i).bitwiseAND(63).cast("int"))
             for i in range(FILTER_WORDS)])


def build_filter(keys: DataFrame, blocks: int, key: str = "hash") -> DataFrame:
    """Bloom filter of ``key`` as a table: a row a block (block, w0..w7), words of 64 bits.

    Each key sets one bit in every word of one block, so the table is a ``bit_or`` by block: map
    tasks combine first, repeated and hot keys add nothing, and null keys aren't held.
    """
    block, bits = _filter_bits(key, blocks)
    return (keys.filter(F.col(key).isNotNull()).select(block, *[b.alias(f"w{i}") for i, b in enumerate(bits)])
                .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(FILTER_WORDS)]))


def merge_filters(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter of both key sets (of equal geometry); as exact as one built from all keys."""
    return one.unionByName(other).groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(FILTER_WORDS)])


def may_hold(df: DataFrame, held: DataFrame, blocks: int, key: str = "hash", out: str = "maybe") -> DataFrame:
    """``df`` with a flag: false only where ``key`` certainly isn't among the filter's keys.

    The filter is broadcast while its ``blocks`` are within ``FILTER_BYTES``; a larger one is joined by block.
    """
    block, bits = _filter_bits(key, blocks)
    names = [f"_w{i}" for i in range(FILTER_WORDS)]
    side = held.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(n) for i, n in enumerate(names)])
    if blocks * 8 * (FILTER_WORDS + 1) <= FILTER_BYTES:
        side = F.broadcast(side)
    hit = reduce(lambda a, b: a & b, [F.col(n).bitwiseAND(b) != 0 for n, b in zip(names, bits, strict=True)])
    return (df.withColumn("_block", block).join(side, "_block", "left")
              .withColumn(out, F.coalesce(hit, F.lit(False))).drop("_block", *names))


def assign_file_ids_filtered(batch: DataFrame, cache: DataFrame, held: DataFrame, blocks: int, key: str = "hash",
                             pos: str = "pos") -> DataFrame:
    """``assign_file_ids`` with a filter of the cache's hashes (kept beside the cache, grown by
    ``merge_filters``): hashes that the filter rules out get their ids without meeting the cache.

    The batch's distinct hashes are written once with the filter's verdict; only possible hits are joined
    with the cache, which is read once.  A filter that is too full lets more of them pass and changes no result.
    """
    distinct = written(may_hold(batch.groupBy(key).agg(F.min(pos).alias("first_pos")), held, blocks, key, "_maybe"),
                       "filtered_hashes")
    cached_ids = cache.select(F.col(key), F.col("file_id").alias("_cached_id"))
    hits = distinct.filter("_maybe").drop("_maybe").join(cached_ids, key, "left")
    misses = distinct.filter("NOT _maybe").drop("_maybe").withColumn("_cached_id", F.lit(None).cast("string"))
    known = written(hits.unionByName(misses), "known_hashes")
    return _with_ids(batch, known, key, pos)


def update_hash_cache(cache: DataFrame, assigned: DataFrame, key: str = "hash") -> DataFrame:
    """The cache after this batch: old entries plus one entry per new hash."""
    # within one batch every row of a hash carries the same id, so distinct() gives
    # one row per hash (a hash aggregate; dropDuplicates would sort)
    new = (assigned.select(key, "file_id").distinct()
                   .join(cache.select(key), key, "left_anti"))
    return cache.select(key, "file_id").unionByName(new)


def cache_stats(assigned: DataFrame, group_cols=("source",)) -> DataFrame:
    return assigned.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if("cached").cast("bigint").alias("n_cached"),
        F.count_if(~F.col("cached")).cast("bigint").alias("n_new"))


def file_metadata(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """FileMetadata rows: hash, name, full_path, sz_bytes and the three times.

    ``modificationTime`` is used when the input came from a file listing;
    Spark does not expose creation or access times, so those stay null.
    """
    size = F.col("length") if "length" in df.columns else F.octet_length(content)
    mtime = (F.unix_micros(F.col("modificationTime")) / F.lit(1e6)
             if "modificationTime" in df.columns else F.lit(None).cast("double"))
    return df.select(
        sha256_hex(content).alias("hash"), T.path_name(path).alias("name"),
        F.col(path).alias("full_path"), size.cast("bigint").alias("sz_bytes"),
        F.lit(None).cast("double").alias("created_at"), mtime.alias("last_modified_at"),
        F.lit(None).cast("double").alias("last_accessed_at"),
        F.lit("").alias("vector_store_id"), F.lit("").alias("file_id"))


def restore_or_create(requests: DataFrame, stored: DataFrame, key: str, pos: str,
                      new_cols: dict) -> DataFrame:
    """Resolve each request against stored records by ``key``.

    A stored record wins; otherwise the first request of the key in this run
    creates the record (``new_cols``: column name -> expression over the
    request row) and later requests of that key restore it.  Output: the
    request rows with the record's columns and ``restored``.
    """
    names = list(new_cols)
    first = (requests.groupBy(key)
                     .agg(F.min(pos).alias("_first_pos"),
                          F.min_by(F.struct(*[e.alias(n) for n, e in new_cols.items()]), pos)
                           .alias("_new")))
    old = stored.select(key, F.struct(*names).alias("_old"))
    canon = written(first.join(old, key, "left"), "canonical_records")
    picked = [F.coalesce(F.col(f"_old.{n}"), F.col(f"_new.{n}")).alias(n) for n in names]
    return (requests.join(canon, key)
                    .select(*[F.col(c) for c in requests.columns if c not in names], *picked,
                            (F.col("_old").isNotNull() | (F.col(pos) > F.col("_first_pos")))
                            .alias("restored")))


def restore_or_create_files(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Per file: stored metadata when its hash is known (first-seen name and path), else new."""
    return restore_or_create(
        batch, stored, "hash", "pos",
        {"name": T.path_name("path"), "full_path": F.col("path"),
         "sz_bytes": F.octet_length("content").cast("bigint"),
         "vector_store_id": content_id(STORE_ID_PREFIX, "hash"),
         "file_id": content_id(FILE_ID_PREFIX, "hash")})


def restore_or_create_videos(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Per video request: the stored transcript's store/file ids, else new ones."""
    h = sha256_hex(F.concat(F.lit("transcript_"), F.col("video_id")))
    return restore_or_create(
        requests, stored, "video_id", "pos",
        {"vector_store_id": content_id(STORE_ID_PREFIX, h), "file_id": content_id(FILE_ID_PREFIX, h)})
