"""An approximate vector index: inverted lists of product-quantised residuals, re-ranked exactly.

* **Centres** of the lists, and the codebooks of the residuals, are fitted with k-means on a sample of
  at most ``SAMPLE`` vectors (chosen by a hash of the id); both are small and go to all tasks.
* **Every** row is assigned: its unit vector goes to the nearest centre, and the difference is coded
  in ``PARTS`` pieces of one byte.  Codes are written in order of lists, range-partitioned by list and a hash
  of the id, so a list that holds a third of all rows lies in many partitions; vectors are a table of their own.
* **Search** gives each query its ``probes`` nearest lists, scores the rows decoded from the codes there, and
  keeps the ``keep`` best by that approximate score; their exact cosine is taken from the
  stored vectors.  The search reads the codes of the lists that queries ask for, and vectors only of the rows kept.
* **Calibration.**  How many lists, and how many rows for each answer, is measured when the index is built: on
  ``TRIALS`` of the sample's vectors, with their exact neighbours in the sample, the least numbers that find
  the share ``WANTED`` of them.  How well lists work depends on the data, so no fixed number would do.

The exact search over all rows is ``retrieval.vector_topk``; recall is measured against it.
Defined cases: rows with a null id or vector, or a null or non-finite component, aren't indexed, as
they can't be compared; a zero vector has similarity 0 to everything; vectors and queries
must have one dimension; ties after rounding to six decimals are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.ordinal import top_k
from cairn.session import fresh_path, written

SAMPLE, SAMPLE_BYTES = 50_000, 32 << 20  # vectors, and bytes of them, that centres are fitted on at most
TRIALS, TRIAL_K, WANTED = 200, 10, 0.97  # queries of the calibration, their neighbours, and the share to be found
LIST_ROWS = 256  # rows of a list on average, until there are MAX_LISTS of them
MAX_LISTS = 4096
PARTS = 16  # bytes of a code
CODES = 256  # entries of a codebook
QUERY_BYTES = 4 << 20  # queries searched together


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Each point's nearest centre by distance."""
    return np.argmin((centres ** 2).sum(axis=1)[None, :] - 2 * (points @ centres.T), axis=1)


def kmeans(points: np.ndarray, count: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Centres of ``points``; a centre that loses all its points goes to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), size=min(count, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        far = np.argsort(-((points - centres[own]) ** 2).sum(axis=1))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        empty = np.flatnonzero(sizes == 0)
        centres[empty] = points[far[:len(empty)]]
    return centres


class Quantiser(NamedTuple):
    """Centres of lists and, for each part of the dimensions, the codebook of residuals."""
    centres: np.ndarray
    books: list

    def parts(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.centres.shape[1]), len(self.books))

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each vector."""
        units = _units(vectors)
        lists = _nearest(units, self.centres)
        residuals = units - self.centres[lists]
        codes = np.stack([_nearest(residuals[:, at], book) for at, book in zip(self.parts(), self.books)], axis=1)
        return lists, codes.astype(np.uint8)

    def probes(self, queries: np.ndarray, count: int) -> np.ndarray:
        """(queries x count) lists nearest to each query."""
        near = _units(queries) @ self.centres.T - 0.5 * (self.centres ** 2).sum(axis=1)[None, :]
        return np.argsort(-near, axis=1, kind="stable")[:, :count]

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        out = self.centres[lists].copy()
        for part, (at, book) in enumerate(zip(self.parts(), self.books)):
            out[:, at] += book[codes[:, part]]
        return out


class VectorIndex(NamedTuple):
    """``codes`` (list, id, code) in order of lists; ``vectors`` (id, vec); the calibrated number of lists to probe
    and of rows to keep for each answer."""
    quantiser: Quantiser
    probes: int
    refine: int
    codes: DataFrame
    vectors: DataFrame


def _matrix(vectors) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def _sample(vectors: DataFrame, dims: int) -> np.ndarray:
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    return _units(_matrix(vectors.orderBy(F.xxhash64("id"), "id").limit(size).select("vec").toPandas()["vec"]))


def fit_quantiser(units: np.ndarray, n_rows: int) -> Quantiser:
    centres = kmeans(units, max(1, min(MAX_LISTS, n_rows // LIST_ROWS, len(units) // 8)))
    residuals = units - centres[_nearest(units, centres)]
    dims = units.shape[1]
    return Quantiser(centres, [kmeans(residuals[:, at], CODES) for at in np.array_split(np.arange(dims), min(PARTS, dims))])


def calibrate(quantiser: Quantiser, units: np.ndarray, n_rows: int) -> tuple[int, int]:
    """(probes, refine) that find the share WANTED of the trials' neighbours in the sample."""
    trials = units[:TRIALS]
    k = min(TRIAL_K, len(units) - 1)
    if k < 1:
        return 1, 1
    exact = trials @ units.T
    exact[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    lists, codes = quantiser.encode(units)
    place = np.argsort(quantiser.probes(trials, len(quantiser.centres)), axis=1)  # a list's place in each trial's order
    probes = int(np.quantile(np.take_along_axis(place, lists[best], axis=1), WANTED, method="higher")) + 1
    near = trials @ quantiser.decode(lists, codes).T
    behind = -np.sort(-near, axis=1)
    ranks = [np.searchsorted(-behind[q], -near[q, best[q]], side="right") for q in range(len(trials))]
    # ranks grow as the rows do
    keep = np.quantile(np.concatenate(ranks), (1 + WANTED) / 2, method="higher") * max(1.0, n_rows / len(units))
    return min(probes, len(quantiser.centres)), max(2, int(np.ceil(keep / k)))


def build_vector_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex | None:
    """The index of all rows that can be compared, written to the shared folder; None if there is none."""
    spark = vectors.sparkSession
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = written(vectors.select(F.col(id_col).cast("bigint").alias("id"), vec_col)
                          .filter(F.col("id").isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).filter(sound)
                          .select("id", F.col(vec_col).cast("array<double>").alias("vec")), "index_vectors")
    n_rows, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n_rows:
        return None
    units = _sample(rows, dims)
    quantiser = fit_quantiser(units, n_rows)
    probes, refine = calibrate(quantiser, units, n_rows)
    shared = spark.sparkContext.broadcast(quantiser)  # MAX_LISTS centres and PARTS * CODES entries at most

    @F.pandas_udf("list int, code binary")
    def encoded(vec: pd.Series) -> pd.DataFrame:
        lists, codes = shared.value.encode(_matrix(vec))
        return pd.DataFrame({"list": lists, "code": [c.tobytes() for c in codes]})

    path = fresh_path(spark, "vector_lists")
    (rows.withColumn("e", encoded("vec")).select("e.list", "id", "e.code")
         .repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list").write.parquet(path))
    return VectorIndex(quantiser, probes, refine, spark.read.parquet(path), rows)


def search_vectors(index: VectorIndex, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                   qid: str = "label", probes: int | None = None, refine: int | None = None) -> DataFrame:
    """Top-``k`` rows per query by cosine, among the ``refine * k`` best by code of the ``probes`` nearest lists
    (both as calibrated, unless given): (qid, rank, id, score)."""
    spark = queries.sparkSession
    dims = index.quantiser.centres.shape[1]
    asked = queries.select(F.col(qid).alias("q"), F.col(vec_col).cast("array<double>").alias("qv"))
    groups = max(1, -(-asked.count() * dims * 8 // QUERY_BYTES))
    qtype = queries.schema[qid].dataType.simpleString()
    out = None
    for g in range(groups):
        part = _search_group(spark, index, asked.filter(F.pmod(F.xxhash64("q"), F.lit(groups)) == g), k, probes or index.probes, refine or index.refine, qtype)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"`{qid}` {qtype}, rank int, `{id_col}` bigint, score double")
    return out.select(F.col("q").alias(qid), "rank", F.col("id").alias(id_col), "score")


def _search_group(spark, index: VectorIndex, asked: DataFrame, k: int, probes: int, refine: int, qtype: str) -> DataFrame | None:
    held = asked.toPandas()  # QUERY_BYTES of queries
    if not len(held):
        return None
    matrix = _matrix(held["qv"])
    near = index.quantiser.probes(matrix, probes)
    of_list: dict = {}
    for q, lists in enumerate(near.tolist()):
        for x in lists:
            of_list.setdefault(x, []).append(q)
    of_list = {x: np.array(q) for x, q in of_list.items()}
    shared = spark.sparkContext.broadcast((index.quantiser, matrix, of_list))
    keep = refine * k

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's ``keep`` best of a task's rows."""
        quantiser, queries, asking = shared.value
        units = _units(queries)
        best, ids = np.full((len(units), keep), -np.inf), np.zeros((len(units), keep), dtype=np.int64)
        for batch in batches:
            lists, of = batch.column("list").to_numpy(), batch.column("id").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(len(lists), -1)
            decoded = quantiser.decode(lists, codes)
            begins = np.flatnonzero(np.append(True, np.diff(lists) != 0))
            for a, b in zip(begins, np.append(begins[1:], len(lists))):
                own = asking[int(lists[a])]
                step = max(1, (1 << 21) // (b - a + keep))  # scores held at once
                for at in range(0, len(own), step):
                    some = own[at:at + step]
                    scores = np.concatenate([best[some], units[some] @ decoded[a:b].T], axis=1)
                    names = np.concatenate([ids[some], np.broadcast_to(of[a:b], (len(some), b - a))], axis=1)
                    top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                    best[some], ids[some] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(names, top, axis=1)
        q, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids[q, at]), pa.array(best[q, at])], ["q", "id", "near"])

    codes = index.codes.filter(F.col("list").isin(sorted(of_list)))
    found = codes.mapInArrow(scan, "q int, id bigint, near double")
    kept = written(top_k(found, ["q"], [F.col("near").desc(), "id"], keep).select("q", "id").distinct(), "vector_candidates")

    @F.pandas_udf("double")
    def cosine(q: pd.Series, vec: pd.Series) -> pd.Series:
        own = _units(shared.value[1])[q.to_numpy()]
        return pd.Series((own * _units(_matrix(vec))).sum(axis=1))

    names = spark.createDataFrame(list(enumerate(held["q"].tolist())), f"q int, name {qtype}")
    exact = index.vectors.join(kept, "id").withColumn("score", F.round(cosine("q", "vec"), 6))
    ranked = top_k(exact, ["q"], [F.col("score").desc(), "id"], k)
    return ranked.join(F.broadcast(names), "q").select(F.col("name").alias("q"), "rank", "id", "score")


def recall(found: DataFrame, exact: DataFrame, qid: str = "label", id_col: str = "vec_id") -> DataFrame:
    """(qid, n_exact, n_found, recall): the share of each query's exact answers that were found."""
    hits = exact.select(qid, id_col).join(found.select(qid, id_col).withColumn("_f", F.lit(1)), [qid, id_col], "left")
    return (hits.groupBy(qid).agg(F.count(F.lit(1)).alias("n_exact"), F.count("_f").alias("n_found"))
                .withColumn("recall", F.col("n_found") / F.col("n_exact")))
