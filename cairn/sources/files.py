"""File-tree sources and sinks.

* ``scan_files``: every file under a root, hidden and empty ones included, which
  Spark's own file sources leave out; levels of directories are listed by tasks.
* ``scan_contents``: their bytes, read by tasks by path; files above a size become
  reject rows (``oversize_files``) instead of disappearing.
* ``tree_fingerprints``: digests of files of any size, read by tasks in blocks.
* ``read_corpus``: bytes -> text, gunzipping '.gz'/'.bin' files that carry
  the gzip magic, then strict UTF-8 (invalid text becomes null, row kept).
* ``land_files``: writes one file per row (optionally gzip) under a root in
  the shared folder, from the executors; a retried task rewrites the same
  files, so it is idempotent.
* ``write_corpus``: Spark's own writers with gzip compression.
"""

from __future__ import annotations

import functools
import gzip
import hashlib
import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import written

GZIP_MAGIC = b"\x1f\x8b"
MAX_FILE_BYTES = (1 << 31) - (1 << 20)  # what one row can hold


def _fs(root: str):
    import pyarrow.fs as pafs
    return pafs.FileSystem.from_uri(root if "://" in root else "file://" + posixpath.abspath(root))


LISTED = "path string, is_dir boolean, length bigint, modificationTime timestamp"
LISTING_TASKS = 256  # directories are dealt to at most so many tasks of one level


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file under ``root``, hidden and empty ones included: (path, length,
    modificationTime).

    Levels are listed one after the other, each level's directories dealt out to
    tasks and its listing written once, so no task walks a whole tree, whatever its shape.
    """
    def list_children(batches):
        import pyarrow.fs as pafs

        fs, _ = _fs(root)
        for pdf in batches:
            for entry in pdf["path"]:
                infos = fs.get_file_info(pafs.FileSelector(entry, recursive=False))
                for at in range(0, len(infos), 10_000):
                    part = [i for i in infos[at:at + 10_000] if i.type in (pafs.FileType.File, pafs.FileType.Directory)]
                    yield pd.DataFrame({
                        "path": [i.path for i in part], "is_dir": [i.type == pafs.FileType.Directory for i in part],
                        "length": pd.Series([i.size or 0 for i in part], dtype="int64"),
                        "modificationTime": pd.to_datetime([i.mtime_ns // 1000 for i in part], unit="us", utc=True)})

    _, base = _fs(root)
    level = spark.createDataFrame([(base,)], "path string")
    found, directories = [], 1
    while directories:
        listed = written(level.repartition(min(directories, LISTING_TASKS)).mapInPandas(list_children, LISTED), "listing")
        found.append(listed.filter(~F.col("is_dir")).select("path", "length", "modificationTime"))
        level = listed.filter("is_dir").select("path")
        directories = level.count()
    return functools.reduce(DataFrame.unionByName, found)


def scan_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of all regular files under ``root``, or right in it."""
    files = walk_files(spark, root)
    return files if recursive else files.filter(F.regexp_replace("path", "/[^/]*$", "") == _fs(root)[1].rstrip("/"))


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """The listing with ``content``: tasks read the files of their rows by path."""
    def read(batches):
        fs, _ = _fs(root)
        for pdf in batches:
            for i in range(len(pdf)):  # a file at a time: the largest one bounds the memory
                with fs.open_input_stream(pdf["path"].iloc[i], compression=None) as f:
                    yield pdf.iloc[i:i + 1].assign(content=[f.read()])

    spark = listing.sparkSession
    schema = T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType())])
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return listing.repartition(tasks, "path").mapInPandas(read, schema)


def oversize_files(listing: DataFrame, max_bytes: int) -> DataFrame:
    """Reject rows (path, length, error) of the files that are too large to read whole."""
    return listing.filter(F.col("length") > max_bytes).select(
        "path", "length", F.format_string("file is larger than %d bytes", F.lit(max_bytes)).alias("error"))


def scan_contents(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, length, modificationTime, content) of all files up to ``max_bytes``;
    ``oversize_files`` of the same listing has the others."""
    return read_files(scan_files(spark, root).filter(F.col("length") <= max_bytes), root)


BLOCK_BYTES = 64 << 20
READ_BYTES = 1 << 20


def block_digests(listing: DataFrame, root: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, length, node, digest): the SHA-256 of each block of each file of the listing; an
    empty file has one empty block.  Tasks get blocks, not files, and hold a megabyte."""
    def read(batches):
        fs, _ = _fs(root)
        for pdf in batches:
            out = []
            for path, node in zip(pdf["path"], pdf["node"]):
                digest, left = hashlib.sha256(), block_bytes
                with fs.open_input_file(path) as f:
                    f.seek(int(node) * block_bytes)
                    while left and (data := f.read(min(READ_BYTES, left))):
                        digest.update(data)
                        left -= len(data)
                out.append(digest.hexdigest())
            yield pdf.assign(digest=out)

    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0)).cast("bigint")
    blocks = listing.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("node"))
    tasks = max(1, int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(tasks, "path", "node").mapInPandas(read, "path string, length bigint, node bigint, digest string")


def tree_fingerprints(listing: DataFrame, root: str, block_bytes: int = BLOCK_BYTES, fan: int = 1024) -> DataFrame:
    """(path, length, hash) of every file of the listing, of any size: no row or task holds a file.

    Block digests are combined by a tree: a node is the SHA-256 of the hex digests of up to
    ``fan`` children, one after the other, until one is left.  A file of one block keeps that
    block's digest, the plain SHA-256 of its bytes, so its id is that of ``fingerprint``.
    """
    nodes = written(block_digests(listing, root, block_bytes), "block_digests")
    most = (nodes.agg(F.max("node")).first()[0] or 0) + 1
    while most > 1:
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        joined = F.array_join(F.transform("children", lambda x: x["digest"]), "")
        only = (F.col("parent") == 0) & (F.size("children") == 1)
        nodes = (nodes.groupBy("path", "length", F.floor(F.col("node") / fan).alias("parent")).agg(children.alias("children"))
                      .select("path", "length", F.col("parent").alias("node"),
                              F.when(only, F.col("children")[0]["digest"]).otherwise(F.sha2(joined, 256)).alias("digest")))
        most = -(-most // fan)
    return nodes.select("path", "length", F.col("digest").alias("hash"))


@F.pandas_udf(T.BinaryType())
def _gunzip(paths: pd.Series, data: pd.Series) -> pd.Series:
    out = []
    for p, b in zip(paths, data):
        if b is None:
            out.append(None)
            continue
        b = bytes(b)
        name = p.rsplit("/", 1)[-1]
        suffixes = ["." + s for s in name.split(".")[1:]] if not name.startswith(".") else \
            ["." + s for s in name[1:].split(".")[1:]]
        if (".gz" in suffixes or ".bin" in suffixes) and b[:2] == GZIP_MAGIC:
            try:
                b = gzip.decompress(b)
            except (OSError, EOFError):
                pass
        out.append(b)
    return pd.Series(out, dtype="object")


def decode_corpus(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Binary content -> ``text``: gunzip when the name says so and the bytes agree,
    then strict UTF-8 (null when invalid)."""
    raw = _gunzip(F.col(path), F.col(content))
    return (df.withColumn("_raw", raw)
              .withColumn("text", F.try_validate_utf8(F.col("_raw").cast("string")))
              .withColumn("raw_length", F.length("_raw"))
              .drop("_raw"))


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime, text, raw_length) for every file under ``root``."""
    return decode_corpus(scan_contents(spark, root)).drop("content")


def read_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every file: Spark's text source (``wholetext``, '.gz' by the Hadoop
    codec, strict UTF-8, null when invalid) for the files that it lists, and ``read_files``
    for hidden and empty ones.

    It does not recognise gzip data behind a '.bin' name, which ``read_corpus`` does.
    """
    listing = scan_files(spark, root)
    base = _fs(root)[1].rstrip("/")
    passed_over = F.substring("path", len(base) + 1, 1 << 30).rlike("/[._]") | (F.col("length") == 0)
    rest = decode_corpus(read_files(listing.filter(passed_over), root)).select("path", "text")
    df = (spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
               .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), "value"))
    return df.filter("size > 0").select("path", F.try_validate_utf8("value").alias("text")).unionByName(rest)


def land_files(df: DataFrame, root: str, path: str = "path", content: str = "content",
               compress=None) -> DataFrame:
    """Write each row's content to ``root + path`` (parents created).

    ``compress`` is a boolean Column; compressed files get '.gz' appended unless
    the name already has a '.gz' suffix or ends in '.bin'.  Returns (path,
    landed_path, bytes) — lazy: it writes when an action runs.
    """
    flag = compress if compress is not None else F.lit(False)
    src = df.select(F.col(path).alias("path"), F.col(content).alias("content"), flag.alias("gz"))

    def write(batches):
        fs, base = _fs(root)
        for pdf in batches:
            landed, sizes = [], []
            for p, c, gz in zip(pdf["path"], pdf["content"], pdf["gz"]):
                data = (c or "").encode("utf-8")
                dest = posixpath.join(base, p.lstrip("/"))
                if gz:
                    name = dest.rsplit("/", 1)[-1]
                    if not (name.endswith(".bin") or ".gz" in ["." + s for s in name.split(".")[1:]]):
                        dest += ".gz"
                    data = gzip.compress(data, mtime=0)
                fs.create_dir(posixpath.dirname(dest), recursive=True)
                with fs.open_output_stream(dest, compression=None) as f:
                    f.write(data)
                landed.append(dest)
                sizes.append(len(data))
            yield pd.DataFrame({"path": pdf["path"], "landed_path": landed,
                                "bytes": pd.Series(sizes, dtype="int64")})

    return src.mapInPandas(write, "path string, landed_path string, bytes bigint")


def write_corpus(df: DataFrame, out: str, fmt: str = "json", compress: bool = True) -> None:
    """Spark writer with gzip compression (text/json/csv) or Parquet's own codec."""
    w = df.write.mode("overwrite")
    if compress:
        w = w.option("compression", "gzip")
    getattr(w, fmt)(out)
