"""Token counts through a digest cache.

The cache is a Parquet table in the shared folder that maps (content digest,
tokenizer digest) to a token count.  A run joins the distinct digests of its
texts to it, encodes one text for each digest that the cache lacks, appends the
new counts, and joins every document to its count.  A byte-level vocabulary
tells all texts apart, so the normalised content is the text with null as
empty; the tokenizer digest covers the vocabulary file and the library version.

A text shared by any number of rows is encoded once; the join of documents to
counts reads written tables on both sides, which lets AQE split a digest that a
third of the rows share.  An append that two runs race on only repeats equal
counts; they are made distinct when read.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows each
give a row; null and repeated doc_ids are kept as they are; an empty table
gives an empty table; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize
from cairn.llm.pieces import encoder_of

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens bigint"


def tokenizer_digest(spec: str) -> str:
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}\n{spec}".encode()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; an empty one where nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_misses(docs: DataFrame, missing: DataFrame, spec: str) -> DataFrame:
    """(digest, n_tokens) of the documents that ``missing`` (digest, doc_id) names."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts = [len(ids) // 4 for ids in encoder.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_pydict({"digest": part.column(0), "n_tokens": pa.array(counts, pa.int64())})

    texts = (docs.join(missing.withColumnRenamed("doc_id", "rep_id"), F.col("doc_id").eqNullSafe(F.col("rep_id")))
                 .filter(F.sha2("text", 256) == F.col("digest"))  # a repeated doc_id may name other texts too
                 .select("digest", "text"))
    return texts.mapInArrow(run, "digest string, n_tokens bigint").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    tokenizer = tokenizer_digest(spec)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digests = materialize(texts.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"),
                                       F.sha2("text", 256).alias("digest")), "token_digests")
    wanted = digests.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == tokenizer)
    missing = materialize(wanted.join(stored, "digest", "left_anti"), "token_misses")
    counted = count_misses(texts, missing, spec)
    if not missing.isEmpty():  # a run of hits alone adds no file
        counted.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == tokenizer)
    # distinct digests: a text that a third of all rows repeat is one row of this side
    counts = materialize(stored.join(wanted.select("digest"), "digest", "left_semi").groupBy("digest")
                               .agg(F.max("n_tokens").alias("n_tokens")), "token_counts")
    return (digests.join(counts, "digest", "left")
                   .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
