"""Lexical and vector retrieval over a corpus, as Spark jobs.

* Chunks: fixed token windows with overlap (both parameters).
* Index: postings (chunk, term, tf) and document frequencies as one table each; the index
  that is searched, and grows by batches, is ``block_index``.
* Vector search: exact cosine top-k.  Vectors and queries are paired block by
  block in a cogroup, with blocks of a fixed number of bytes, so no task ever
  holds the whole of either.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.ordinal import top_k
K1, B = 1.2, 0.75
BLOCK_BYTES = 64 << 20  # vectors in a block, and similarities in a slice, of vector search


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = 64, overlap: int = 16) -> DataFrame:
    """(id, chunk_no, start, n_tokens, tokens, text): windows of ``size`` tokens starting
    every ``size - overlap`` tokens; the last window reaches the end of the text."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    stride = size - overlap
    toks = docs.select(id_col, T.tokens(text_col).alias("_t")).withColumn("_n", F.size("_t"))
    n_chunks = F.when(F.col("_n") == 0, 0).when(F.col("_n") <= size, 1).otherwise(
        F.ceil((F.col("_n") - size) / F.lit(stride)).cast("int") + 1)
    starts = F.when(n_chunks > 0, F.sequence(F.lit(0), (n_chunks - 1) * stride, F.lit(stride))) \
        .otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("_t", s + 1, size).alias("tokens")))
    return (toks.select(id_col, F.posexplode(windows).alias("chunk_no", "w"))
                .select(id_col, F.col("chunk_no").cast("bigint").alias("chunk_no"),
                        F.col("w.start").cast("bigint").alias("start"),
                        F.size("w.tokens").cast("bigint").alias("n_tokens"), F.col("w.tokens").alias("tokens"),
                        F.array_join("w.tokens", " ").alias("text")))


def _by_document(chunks: DataFrame, keys, colocated: bool) -> DataFrame:
    """Chunk rows hash-partitioned by document: the (chunk, term) aggregation that
    follows then needs no shuffle of the exploded tokens.  A document is one
    bounded row, so this cannot concentrate a hot key.  ``colocated``: the documents
    were partitioned so before they were chunked, which moves each token once."""
    return chunks if colocated else chunks.repartition(keys[0])


def build_index(chunks: DataFrame, keys=("doc_id", "chunk_no"), colocated: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings(keys..., term, tf), term_stats(term, df, cf)).

    Both are plain aggregations (partial aggregation absorbs very common terms);
    at scale the postings are written once, bucketed by term, and searched many times.
    """
    postings = (_by_document(chunks, keys, colocated).select(*keys, F.explode("tokens").alias("term"))
                      .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")))
    stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return postings, stats


def centroids(vectors: DataFrame, group: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per group, as double arrays (dimension-wise average)."""
    comp = vectors.select(group, F.posexplode(vec).alias("i", "x"))
    means = comp.groupBy(group, "i").agg(F.avg("x").alias("m"))
    return (means.groupBy(group)
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vec)))


def _safe_norm(m: np.ndarray) -> np.ndarray:
    """Row norms; an all-zero vector gets norm 1 (similarity 0 instead of NaN)."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n == 0, 1.0, n)


def _cosine_candidates(query_ids, queries, vector_ids, vectors, k, id_col, qid):
    """Candidates of one block pair: everything within 1e-6 of a query's k-th best raw score.

    A vector below that can't reach the global top-k after rounding to 6 decimals, so the
    candidate set is exact (ties included).  Vectors are taken in slices whose
    similarities stay within ``BLOCK_BYTES``.
    """
    q = queries / _safe_norm(queries)
    step = max(1, int(BLOCK_BYTES // (8 * max(1, len(q)))))
    for at in range(0, len(vectors), step):
        v = vectors[at:at + step]
        sims = q @ (v / _safe_norm(v)).T  # (queries, slice)
        kk = min(k, sims.shape[1])
        kth = -np.partition(-sims, kk - 1, axis=1)[:, kk - 1:kk]
        rows_q, cols = np.nonzero(sims >= kth - 1e-6)
        yield pd.DataFrame({qid: query_ids[rows_q], id_col: vector_ids[at + cols], "score": sims[rows_q, cols]})


def vector_blocks(n_rows: int, dims: int) -> int:
    """Blocks that hold at most about ``BLOCK_BYTES`` of vectors each."""
    return max(1, -(-n_rows * dims * 8 // BLOCK_BYTES))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                vec_col: str = "embedding", qid: str = "label") -> DataFrame:
    """Exact top-``k`` vectors per query by cosine similarity: (qid, rank, id, score).

    Vectors and queries are hashed into blocks of a fixed number of bytes, and each
    (vector block, query block) pair is one cogroup: a vector is copied once per
    query block and a query once per vector block, and no task holds more than two
    blocks and one slice of similarities, however many there are of either.  A
    per-query top-k over the pairs' candidates follows.  Ties after rounding to 6
    decimals break on the vector id.
    """
    dims = F.max(F.size(vec_col))
    n_v, dim = vectors.agg(F.count(F.lit(1)), dims).first()
    n_q = queries.agg(F.count(F.lit(1))).first()[0]
    vector_n, query_n = vector_blocks(n_v, dim or 1), vector_blocks(n_q, dim or 1)
    vq = (vectors.select(id_col, vec_col)
                 .withColumn("_vb", F.pmod(F.xxhash64(id_col), F.lit(vector_n)))
                 .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(query_n - 1)))))
    qq = (queries.select(qid, vec_col)
                 .withColumn("_qb", F.pmod(F.xxhash64(qid), F.lit(query_n)))
                 .withColumn("_vb", F.explode(F.sequence(F.lit(0), F.lit(vector_n - 1)))))
    qtype = queries.schema[qid].dataType.simpleString()
    itype = vectors.schema[id_col].dataType.simpleString()

    def pair(vpdf: pd.DataFrame, qpdf: pd.DataFrame) -> pd.DataFrame:
        if vpdf.empty or qpdf.empty:
            return pd.DataFrame({qid: [], id_col: [], "score": []})
        mats = [np.vstack(f[vec_col].to_numpy()).astype(np.float64) for f in (qpdf, vpdf)]
        return pd.concat(list(_cosine_candidates(qpdf[qid].to_numpy(), mats[0], vpdf[id_col].to_numpy(), mats[1], k,
                                                 id_col, qid)), ignore_index=True)

    cand = (vq.groupBy("_vb", "_qb").cogroup(qq.groupBy("_vb", "_qb"))
              .applyInPandas(pair, f"{qid} {qtype}, {id_col} {itype}, score double"))
    return top_k(cand.withColumn("score", F.round("score", 6)), [qid], [F.col("score").desc(), F.col(id_col)], k)
