"""Content fingerprints and ids derived from them.

SHA-256 is the built-in, JVM-side default and the dedup key everywhere.  The
other algorithms of the reference (SHA3-256 and the XXH family, seed 0) have
no Spark built-in, so they run as one Arrow-batched ``pandas_udf`` each.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # optional: only the XXH algorithms need it
    import xxhash
except ImportError:  # pragma: no cover
    xxhash = None

# Algorithms the reference offers (name -> constructor name), in its order.
ALGORITHMS = ("sha256", "sha3_256", "xxh32", "xxh64", "xxh128", "xxh3_128", "xxh3_64")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sha256_hex(col) -> Column:
    """Hex SHA-256 of a string (UTF-8) or binary column."""
    return F.sha2(_c(col), 256)


def content_id(prefix: str, hash_hex, width: int = 24) -> Column:
    """Stable id derived from a content hash, e.g. 'file-<24 hex>' or 'vs_<24 hex>'."""
    return F.concat(F.lit(prefix), F.substring(_c(hash_hex), 1, width))


def int64_digest(hash_hex) -> Column:
    """Unsigned integer (decimal text) of the first 64 bits of a hex digest, big-endian."""
    return F.conv(F.substring(_c(hash_hex), 1, 16), 16, 10)


def _constructor(alg: str):
    if alg in ("sha256", "sha3_256"):
        return getattr(hashlib, alg)
    if xxhash is None:
        raise ImportError("xxhash is required for the XXH algorithms")
    return getattr(xxhash, alg)


def hash_udf(alg: str = "sha3_256"):
    """A vectorised UDF computing ``alg`` hex digests of a string or binary column."""
    if alg not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {alg!r}")

    @F.pandas_udf(T.StringType())
    def _digest(values: pd.Series) -> pd.Series:
        ctor = _constructor(alg)
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            data = v.encode("utf-8") if isinstance(v, str) else bytes(v)
            out.append(ctor(data).hexdigest())
        return pd.Series(out, dtype="object")

    return _digest
