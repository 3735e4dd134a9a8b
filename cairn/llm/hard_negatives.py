"""Hard negatives from lists shared by clusters of anchors.

Anchors are clustered by direction.  For each cluster the candidates are sorted once by
an upper bound of their score against any member: with a candidate's norm r, its angle t to
the cluster's centre and the cluster's greatest angle b, no member of length 1 scores more
than r * cos(max(0, t - b)).  Every member walks that list from the top, a step of rows at a
time for all members still walking, and stops as soon as its result is certified: what it
holds beats everything that the next bound allows.

Two walks are made.  The first finds each anchor's positives (the best rows of its label),
the second, for every positive, the best rows of other labels whose score lies within the
positive's window; a member also stops there once the next bound is below all its windows.

Candidates are dealt by a hash of their id into segments and anchors into blocks, both of at
most BLOCK_BYTES, and each (segment, block) is one group: a cluster's list is sorted
segment by segment, and the segments' winners meet in a top-k of a few rows each.
Vectors are copied once per block and anchors once per segment.  Nothing but the cluster
centres, fitted on at most SAMPLE anchors, goes through the driver; centres only decide
the order of the walk, never its result.

Defined cases: a row without an id takes no part, nor does one with a null label, vector or
component, a component that isn't finite or whose floor(256 * x) passes 2^20 in size (scores
stay exact 64-bit integers up to 8,192 components); an empty vector scores 0 and a shorter
vector counts as filled up with zeros; of rows that share an id the one with the least (label,
components) counts; equal scores are ordered by id; an anchor without another row of its label,
or a positive without a row in its window, gives no row; an empty table gives an empty result.
Only the id, label and vector are read, so other columns can't clash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.ordinal import top_k
from cairn.llm.common import materialize

BLOCK_BYTES = 64 << 20  # components (8 bytes each) that a segment, or a block of anchors, holds at most
SEGMENT_ROWS = 1024  # a segment has about so many rows until there are MAX_SEGMENTS of them
MAX_SEGMENTS = 4096
CLUSTERS = 64  # centres at most; a cluster has about CLUSTER_ROWS anchors until there are so many
CLUSTER_ROWS = 32
SAMPLE, SAMPLE_BYTES = 20_000, 16 << 20  # anchors, and bytes of them, that centres are fitted on at most (chosen by a hash of the id)
STEP = 256  # rows of a list walked at once
LARGEST = 1 << 20  # size of a component at most
NONE = np.iinfo(np.int64).min


class Window(NamedTuple):
    """Which negatives a positive of score p takes: low * p <= 100 * score <= high * p."""
    low: int = 50
    high: int = 95
    positives: int = 5
    negatives: int = 3


def usable_rows(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(vec_id, label, v): rows that take part, one an id, components as whole numbers."""
    floors = F.transform(F.col("x"), lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LARGEST / 256.0))
    return (rows.select(F.col(id_col).cast("bigint").alias("vec_id"), label.alias("label"), F.col(vec_col).alias("x"))
                .filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(sound)
                .select("vec_id", F.struct("label", floors.alias("v")).alias("row"))
                .groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as the rows of one matrix of whole numbers, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _directions(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def fit_centres(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of the vectors' directions by spherical k-means, begun with rows far apart."""
    units = _directions(vectors)
    nearest, chosen = np.full(len(units), -2.0), [0]
    for _ in range(1, count):
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
        chosen.append(int(np.argmin(nearest)))
    centres = units[chosen]
    for _ in range(rounds):
        own = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _directions(sums), centres)
    return centres


class Walk:
    """One cluster's members on its list over one segment: the best ``k`` rows of each of a member's windows.

    ``low`` and ``high`` (members x windows) bound a window's scores; ``same`` says whether rows
    of the member's label or rows of other labels count.
    """

    def __init__(self, ids, labels, matrix, k: int, same: bool):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.matrix = ids[order], labels[order], matrix[order]
        self.norms, self.units = np.linalg.norm(self.matrix, axis=1), _directions(self.matrix)
        self.k, self.same, self.walked = k, same, 0

    def shared_list(self, centre: np.ndarray, widest: float):
        """Rows in order of their bound for a member of length 1, highest first, and the bounds."""
        angles = np.arccos(np.clip(self.units @ centre, -1.0, 1.0))
        bounds = self.norms * np.cos(np.clip(angles - widest, 0.0, np.pi))
        order = np.argsort(-bounds, kind="stable")
        return order, bounds[order]

    def best(self, member_ids, member_labels, members, centre, low, high):
        """Ids and scores (members x windows x k; NONE: no such row)."""
        n, count = len(self.ids), len(members)
        units = _directions(members)
        widest = float(np.arccos(np.clip(units @ centre, -1.0, 1.0)).max()) + 1e-6
        order, bounds = self.shared_list(centre, widest)
        lengths = np.linalg.norm(members, axis=1)
        # a row's score and place by id as one number: a greater score first, then a smaller id
        held = np.full((count, low.shape[1], self.k), NONE, dtype=np.int64)
        live = np.arange(count)
        for at in range(0, n, STEP):
            # slack for the rounding of angles and norms
            top = lengths[live] * bounds[at] * (1 + 1e-9) + 1e-6 * (1 + lengths[live] * self.norms.max())
            last = held[live, :, self.k - 1]
            enough = (last != NONE) & (last // n > top[:, None])
            live = live[~np.all(enough | (low[live] > top[:, None]), axis=1)]
            if not len(live):
                break
            rows = order[at:at + STEP]
            self.walked += len(rows) * len(live)
            scores = np.rint(members[live] @ self.matrix[rows].T).astype(np.int64)
            wanted = (self.labels[rows] == member_labels[live][:, None]) == self.same
            wanted &= self.ids[rows] != member_ids[live][:, None]
            keys = scores * n + (n - 1 - rows)
            for w in range(low.shape[1]):
                inside = wanted & (scores >= low[live, w][:, None]) & (scores <= high[live, w][:, None])
                both = np.concatenate([held[live, w], np.where(inside, keys, NONE)], axis=1)
                held[live, w] = -np.sort(-np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:], axis=1)
        found = held != NONE
        return np.where(found, self.ids[np.where(found, n - 1 - held % n, 0)], 0), np.where(found, held // n, NONE)


def _walked(candidates: DataFrame, anchors: DataFrame, centres: np.ndarray, k: int, same: bool) -> DataFrame:
    """(anchor_id, window, vec_id, score): the best ``k`` rows of each segment for each window of each anchor.

    ``candidates``: vec_id, label, v, segment, block; ``anchors`` also cluster, low and high (arrays, an entry a window).
    """
    width = centres.shape[1]

    def walk(segment: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(segment) and len(block):
            rows = Walk(segment["vec_id"].to_numpy(), segment["label"].to_numpy(), _matrix(segment["v"], width), k, same)
            for cluster, members in block.groupby("cluster", sort=True):
                ids = members["vec_id"].to_numpy()
                low, high = (np.vstack(members[c].to_numpy()).astype(np.int64) for c in ("low", "high"))
                found, scores = rows.best(ids, members["label"].to_numpy(), _matrix(members["v"], width), centres[cluster], low, high)
                m, w, r = np.nonzero(scores != NONE)
                parts.append(pd.DataFrame({"anchor_id": ids[m], "window": w, "vec_id": found[m, w, r], "score": scores[m, w, r]}))
        return pd.concat(parts) if parts else pd.DataFrame({"anchor_id": [], "window": [], "vec_id": [], "score": []})

    return (candidates.groupBy("segment", "block").cogroup(anchors.groupBy("segment", "block"))
                      .applyInPandas(walk, "anchor_id bigint, window int, vec_id bigint, score bigint"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, window: Window = Window()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, v).

    ``is_anchor``: condition on vec_id.  ``vectors`` as ``usable_rows`` gives them.
    """
    spark = vectors.sparkSession
    rows = materialize(vectors, "negative_rows")
    total, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    chosen = rows.filter(is_anchor)
    count = chosen.count()
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    sample = chosen.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toPandas()
    wanted = max(1, min(CLUSTERS, len(sample) // CLUSTER_ROWS))
    centres = fit_centres(_matrix(sample["v"], width), wanted) if len(sample) else np.zeros((1, width))
    n_segments = max(-(-total * width * 8 // BLOCK_BYTES), min(MAX_SEGMENTS, -(-total // SEGMENT_ROWS)), 1)
    n_blocks = max(1, -(-count * width * 8 // BLOCK_BYTES))
    shared = spark.sparkContext.broadcast(centres)  # CLUSTERS rows at most

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(_directions(_matrix(v, shared.value.shape[1])) @ shared.value.T, axis=1), dtype="int32")

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def members(anchors: DataFrame) -> DataFrame:
        return anchors.withColumn("segment", numbers(n_segments))

    anchors = materialize(chosen.withColumn("cluster", nearest("v"))
                                .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))), "negative_anchors")
    candidates = rows.withColumn("segment", F.pmod(F.xxhash64("vec_id"), F.lit(n_segments))).withColumn("block", numbers(n_blocks))
    least, most = F.lit(int(NONE) + 1), F.lit(int(np.iinfo(np.int64).max))
    first = _walked(candidates, members(anchors.withColumns({"low": F.array(least), "high": F.array(most)})), centres, window.positives, True)
    positives = materialize(top_k(first, ["anchor_id"], [F.col("score").desc(), "vec_id"], window.positives, "n")
                            .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "n"), "positives")

    def hundredth(x: Column) -> Column:
        """x / 100 rounded down, in whole numbers."""
        return F.call_function("div", x - F.pmod(x, F.lit(100).cast("long")), F.lit(100).cast("long"))

    score = F.col("positive_score")
    ends = (positives.withColumns({"low": -hundredth(-score * window.low), "high": hundredth(score * window.high)}).groupBy("anchor_id")
                     .agg(F.sort_array(F.collect_list(F.struct("n", "low", "high"))).alias("w")))  # one entry a positive, a few an anchor

    def padded(end: str, nothing: Column) -> Column:
        """The windows' ends, with windows that nothing fits for anchors that have fewer positives."""
        return F.transform(F.sequence(F.lit(0), F.lit(window.positives - 1)), lambda i: F.coalesce(F.get(F.col(f"w.{end}"), i), nothing))

    windows = {"low": padded("low", most), "high": padded("high", least)}
    second = _walked(candidates, members(anchors.join(ends.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumns(windows).drop("w")),
                     centres, window.negatives, False)
    best = top_k(second, ["anchor_id", "window"], [F.col("score").desc(), "vec_id"], window.negatives)
    return (best.withColumn("n", F.col("window") + 1).join(positives, ["anchor_id", "n"])
                .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score")))
