"""Input routing: what each user input is, and what it resolves to.

Inputs are rows; existence of a path is a join against the scanned listing,
never a file-system call per row.  Bad inputs are reported as reject rows and
never fail the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.hashing import content_id, sha256_hex

EXIT, FILE, DIRECTORY, VIDEO, WEB, UNSUPPORTED = "exit", "file", "directory", "video", "web", "unsupported"


def listing_entries(listing: DataFrame, path: str = "path") -> DataFrame:
    """(path, kind) for every listed file and every ancestor directory of it."""
    parts = F.split(F.col(path), "/")
    idx = F.filter(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: i < F.size(parts))
    dirs = F.transform(idx, lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    files = listing.select(F.col(path).alias("path"), F.lit(FILE).alias("kind"))
    directories = (listing.select(F.explode(dirs).alias("path")).distinct()
                          .select("path", F.lit(DIRECTORY).alias("kind")))
    return files.unionByName(directories)


def clean_inputs(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Argument parts joined with no separator, surrounding quotes stripped."""
    return df.withColumn("input", T.strip_quotes(F.array_join(F.col(parts), "")))


def route_inputs(inputs: DataFrame, listing: DataFrame, col: str = "input") -> DataFrame:
    """Add ``kind``: exit word, then existing file, directory, then URL (video / web),
    else unsupported."""
    entries = listing_entries(listing).withColumnRenamed("path", col).withColumnRenamed("kind", "_listed")
    kind = (F.when(T.is_exit_word(col), EXIT)
             .when(F.col("_listed").isNotNull(), F.col("_listed"))
             .when(T.is_url(col) & T.is_video_url(col), VIDEO)
             .when(T.is_url(col), WEB)
             .otherwise(UNSUPPORTED))
    return inputs.join(entries, col, "left").withColumn("kind", kind).drop("_listed")


def extract_video_ids(df: DataFrame, url: str = "input") -> DataFrame:
    return df.withColumn("video_id", T.video_id(url))


def resolve_content_type(df: DataFrame, header: str = "content_type") -> DataFrame:
    return df.withColumn("extension", T.content_type_extension(header))


def sniff_content_type(body) -> "F.Column":
    """Content-Type a server would send for a landed body (our own rule)."""
    return (F.when(F.col(body).rlike(T.HTML_START) if isinstance(body, str) else body.rlike(T.HTML_START), "text/html; charset=utf-8")
             .when(F.substring(body, 1, 5) == "%PDF-", "application/pdf")
             .otherwise("text/plain"))


def resources(routed: DataFrame, col: str = "input") -> DataFrame:
    """Store ids each routed input resolves to (empty when it resolves to nothing)."""
    key = F.when(F.col("kind") == VIDEO, F.concat(F.lit("transcript_"), F.col("video_id"))).otherwise(F.col(col))
    ids = F.when(F.col("kind").isin(FILE, DIRECTORY, WEB)
                 | ((F.col("kind") == VIDEO) & F.col("video_id").isNotNull()),
                 F.array(content_id("vs_", sha256_hex(key)))).otherwise(F.array().cast("array<string>"))
    return routed.withColumn("vector_store_ids", ids)


def check_store_refs(df: DataFrame, ids: str = "vector_store_ids") -> DataFrame:
    """``store_ok`` and ``store_error``: exactly one non-empty id starting with 'vs_'."""
    n = F.size(ids)
    first = F.try_element_at(F.col(ids), F.lit(1))
    err = (F.when(n == 0, "Resources object has no vector store id.")
            .when(n > 1, "Resources object has more than 1 vector store id associated with it.")
            .when(F.length(first) == 0, "empty")
            .when(~first.startswith("vs_"), "invalid format"))
    return df.withColumn("store_error", err).withColumn("store_ok", err.isNull())


# The error classes and messages below.


def rejected_inputs(routed: DataFrame, col: str = "input") -> DataFrame:
    """(input, error_class, message) for every input that cannot be processed."""
    err = (F.when(F.col("kind") == UNSUPPORTED, F.lit("NotSupportedError"))
            .when((F.col("kind") == VIDEO) & F.col("video_id").isNull(), F.lit("ValueError")))
    msg = (F.when(F.col("kind") == UNSUPPORTED,
                  F.lit("Failed to vectorize data. Your input is not yet supported."))
            .otherwise(F.lit("Invalid YouTube video URL")))
    return (routed.withColumn("error_class", err).filter(F.col("error_class").isNotNull())
                  .select(col, "error_class", msg.alias("message")))


def typed_pages(pages: DataFrame) -> DataFrame:
    """Pages that aren't videos with content_type (the landed one if there is one) and extension."""
    if "content_type" not in pages.columns:
        pages = pages.withColumn("content_type", sniff_content_type(F.col("html")))
    return resolve_content_type(pages.filter(~T.is_video_url("url")))


def rejected_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, error_class, message) of the pages whose Content-Type isn't supported."""
    return typed_pages(pages).filter(F.col("extension").isNull()).select(
        "page_id", "url", F.lit("NotSupportedError").alias("error_class"),
        F.concat(F.lit("Unsupported content type: "), F.coalesce("content_type", F.lit(""))).alias("message"))


def ingest_pages(pages: DataFrame) -> DataFrame:
    """Landed pages -> corpus rows keyed by URL: video pages are routed away, the
    rest typed by Content-Type; unsupported types are refused (``rejected_pages``)."""
    typed = typed_pages(pages).filter(F.col("extension").isNotNull())
    return typed.select(
        "page_id", "url", "content_type", "extension",
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.col("extension")).alias("name"),
        sha256_hex("html").alias("hash"), F.octet_length("html").cast("bigint").alias("sz_bytes"))
