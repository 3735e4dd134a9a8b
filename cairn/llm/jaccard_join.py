"""Similarity join on word n-grams with Bayesian pruning of MinHash candidates.

Documents are sets of five-word shingles (words between ASCII white space, A-Z
folded).  Documents with equal sets form a class and take part once.

1. A MinHash signature per class; classes that agree on all rows of a band share
   a bucket.  With 20 bands of 4 rows a pair of Jaccard similarity 0.8 misses
   all buckets with a chance of 3e-5, less above.  Buckets that repeat another
   bucket's members are left out.
2. A bucket's members are dealt into blocks, and a cell is a pair of blocks, so a
   bucket of any size becomes cells of bounded size and no task holds a bucket.
   A cell looks at the pairs whose first common band is its own and compares
   their MinHash values eight at a time: with a uniform prior, m values of which
   k agree leave P(J >= t) = P(Bin(m + 1, t) <= k); a pair is dropped when that
   is below the tolerance (Satuluri and Parthasarathy, "Bayesian locality
   sensitive hashing").  Only members with pairs left are passed on.
3. Cells get the shingle sets of those members and verify every pair left
   exactly.  They emit, for each member, how many documents it links to and one
   edge to the least member it is connected to: rows per member, not per pair.
4. Links are summed and edges joined into groups by connected components.

Defined cases: a text of one to four words is one shingle of all its words; a
null text or one without words links to nothing; repeated rows are documents of
one class; a null doc_id takes part like any other and a group's id is its
least doc_id that isn't null; an empty table gives an empty result; only doc_id
and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import held_by_worker, materialize, partitions_for
from cairn.llm.components import connected_components

WORDS = 5
SIMILARITY = (4, 5)  # 0.8 as a fraction, for exact comparisons
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
STEP = 8
TOLERANCE = 1e-6
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 1 << 19
TASK_ROWS = 20_000
TASK_SHINGLES = 2_000_000

_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII white space and case only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    mixed = sum(h[i:i + n] * _POWERS[i] for i in range(WORDS))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values: upper halves of the least value of each linear permutation."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096]
        least = np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(t: float = SIMILARITY[0] / SIMILARITY[1], tolerance: float = TOLERANCE) -> list[int]:
    """For each number m of compared values, the fewest agreeing that keep a pair."""
    out = []
    for m in range(HASHES + 1):
        below, k = 0.0, -1
        while below < tolerance:
            k += 1
            below += math.comb(m + 1, k) * t ** k * (1 - t) ** (m + 1 - k)
        out.append(k)
    return out


LEAST = least_matches()


def surviving_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left[i], right[i]) that this band owns and the posterior doesn't drop."""
    bands = sig.view(np.uint64).reshape(len(sig), BANDS, 2)
    for b in range(band):
        other = (bands[left, b] != bands[right, b]).any(axis=1)
        left, right = left[other], right[other]
    agree = np.zeros(len(left), np.int64)
    for m in range(0, HASHES, STEP):
        agree += (sig[left, m:m + STEP] == sig[right, m:m + STEP]).sum(axis=1)
        keep = agree >= LEAST[m + STEP]
        left, right, agree = left[keep], right[keep], agree[keep]
    return left, right


def cell_pairs(block: np.ndarray, c1: int, c2: int) -> tuple[np.ndarray, np.ndarray]:
    if c1 == c2:
        return np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == c1), np.flatnonzero(block == c2)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _cells(pdf: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
    pdf = pdf.sort_values(["band", "key", "c1", "c2", "class_key"], ignore_index=True)
    ids = pdf[["band", "key", "c1", "c2"]].to_numpy(np.int64)
    if len(ids):
        starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1)))
        for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            if b - a > 1:
                yield tuple(ids[a]), pdf.iloc[a:b]


def prune_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """The members of each cell that have a pair left."""
    kept = [pdf.iloc[:0]]
    for (band, _, c1, c2), cell in _cells(pdf):
        sig = np.frombuffer(b"".join(cell["sig"]), np.uint32).reshape(len(cell), HASHES)
        left, right = surviving_pairs(sig, *cell_pairs(cell["block"].to_numpy(), c1, c2), int(band))
        if len(left):
            kept.append(cell.iloc[np.union1d(left, right)])
    return pd.concat(kept)[["band", "key", "c1", "c2", "block", "class_key", "n", "docs"]]


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs, exactly."""
    if len(left) <= 32:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                         for i, j in zip(left, right, strict=True)], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1  # a shingle of one set only is in no intersection
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts[inverse] > 1
    rows, columns = rows[shared], column[inverse[shared]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out, width = np.zeros((len(sets), len(sets)), np.int64), 8192
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        a, b = np.searchsorted(columns, [at, at + width])
        x = np.zeros((len(sets), width), np.float32)
        x[rows[a:b], columns[a:b] - at] = 1
        out += (x @ x.T).astype(np.int64)  # counts of up to 8192: exact in float32
    return out[left, right]


def verify_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each member of each cell: documents and classes linked, and its least connected member."""
    top, bottom = SIMILARITY
    out = []
    for (band, _, c1, c2), cell in _cells(pdf):
        sets = [np.frombuffer(s, np.uint64) for s in cell["shingles"]]
        sig = np.array([signature(s) for s in sets])
        left, right = surviving_pairs(sig, *cell_pairs(cell["block"].to_numpy(), c1, c2), int(band))
        if not len(left):
            continue
        both = common_counts(sets, left, right)
        sizes = np.array([len(s) for s in sets])
        linked = both * bottom >= (sizes[left] + sizes[right] - both) * top
        left, right = left[linked], right[linked]
        docs = cell["docs"].to_numpy(np.int64)
        link_docs, link_classes = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64)
        for i, j in ((left, right), (right, left)):
            np.add.at(link_docs, i, docs[j])
            np.add.at(link_classes, i, 1)
        root = np.arange(len(cell))
        while True:  # members are in order, so the least index is the least key
            new = root.copy()
            np.minimum.at(new, left, root[right])
            np.minimum.at(new, right, root[left])
            new = new[new]
            if (new == root).all():
                break
            root = new
        keys = cell["class_key"].to_numpy()
        has = link_classes > 0
        out.append(pd.DataFrame({"class_key": keys[has], "root": keys[root[has]],
                                 "link_docs": link_docs[has], "link_classes": link_classes[has]}))
    return pd.concat(out) if out else pd.DataFrame(
        {"class_key": [], "root": [], "link_docs": np.zeros(0, np.int64), "link_classes": np.zeros(0, np.int64)})


def shingle_table(docs: DataFrame, with_sets: bool = False) -> DataFrame:
    """doc_id, class_key (digest of the shingle set), n, and the signature or the set of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held_by_worker()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                made = [s.tobytes() if with_sets else signature(s).tobytes() for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "digest": part.column(2),
                    "class_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    "n": pa.array([len(s) for s in sets], pa.int64()), "made": pa.array(made, pa.binary())})

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
                .mapInArrow(run, "doc_id bigint, digest bigint, class_key binary, n bigint, made binary"))


def jaccard_links(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, class_id (least doc_id of its group of
    linked documents), n_links (documents with a similarity of at least 0.8, copies
    included) and n_class_links (different shingle sets among them)."""
    return linked_rows(docs).select("doc_id", "class_id", "n_links", "n_class_links")


def linked_rows(docs: DataFrame) -> DataFrame:
    """``jaccard_links`` with each row's text digest and its group's label (null: no shingle)."""
    table = materialize(shingle_table(docs), "join_signatures")
    classes = materialize(
        table.filter("class_key IS NOT NULL").groupBy("class_key").agg(
            F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("rep_id"), F.first("n").alias("n"),
            F.first("made").alias("sig")), "join_classes")

    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring("sig", b * ROWS * 4 + 1, ROWS * 4)).alias("key"))
                      for b in range(BANDS)])
    banded = classes.select("class_key", "n", F.explode(bands).alias("x")).select("class_key", "n", "x.band", "x.key")
    buckets = (banded.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("held"), F.bit_xor(F.xxhash64("class_key")).alias("x1"),
        F.bit_xor(F.xxhash64("class_key", F.lit(1))).alias("x2")).filter("members > 1")
        .groupBy("members", "held", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("first"))
        .select("first.band", "first.key", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS),
                                                      F.ceil(F.col("held") / BLOCK_SHINGLES)).alias("blocks"), "members"))
    buckets = materialize(buckets, "join_buckets")
    rows = buckets.agg(F.sum(F.col("members") * F.col("blocks"))).first()[0] or 0
    block = F.pmod(F.xxhash64("class_key", F.lit(2)), F.col("blocks"))
    cells = (banded.join(buckets, ["band", "key"]).select("band", "key", "class_key", block.alias("block"),
                                                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
             .select("band", "key", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"),
                     "block", "class_key"))
    task = F.pmod(F.xxhash64("band", "key", "c1", "c2"), F.lit(partitions_for(rows, TASK_ROWS)))
    cell_kind = "band int, key bigint, c1 bigint, c2 bigint, block bigint, class_key binary, n bigint, docs bigint"
    left = materialize(cells.join(classes.select("class_key", "n", "docs", "sig"), "class_key")
                            .groupBy(task).applyInPandas(prune_cells, cell_kind), "join_survivors")

    wanted = (left.select("class_key").distinct().withColumnRenamed("class_key", "wanted")
              .join(classes.select(F.col("class_key").alias("wanted"), "rep_id"), "wanted"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # survivors are a share of the input: one plan at every size, a shuffle of both sides
    texts = texts.hint("merge").join(wanted.select("rep_id").distinct(), F.col("doc_id").eqNullSafe(F.col("rep_id")), "left_semi")
    sets = (shingle_table(texts, with_sets=True).join(wanted, F.col("class_key") == F.col("wanted"), "left_semi")
            .groupBy("class_key").agg(F.first("made").alias("shingles")))
    sets = materialize(sets, "join_sets")
    held = left.agg(F.sum("n")).first()[0] or 0
    task = F.pmod(F.xxhash64("band", "key", "c1", "c2"), F.lit(partitions_for(held, TASK_SHINGLES)))
    verified = materialize(left.join(sets, "class_key").groupBy(task).applyInPandas(
        verify_cells, "class_key binary, root binary, link_docs bigint, link_classes bigint"), "join_verified")

    links = verified.groupBy("class_key").agg(F.sum("link_docs").alias("link_docs"), F.sum("link_classes").alias("link_classes"))
    groups = connected_components(verified.select(F.col("class_key").alias("a"), F.col("root").alias("b")))
    named = (classes.select("class_key", "docs", "rep_id")
             .join(groups.withColumnRenamed("node", "class_key"), "class_key", "left")
             .withColumn("label", F.coalesce("label", "class_key")))
    named = materialize(named.join(links, "class_key", "left"), "join_named")
    ids = materialize(named.groupBy("label").agg(F.min("rep_id").alias("class_id")), "join_ids")
    named = materialize(named.join(ids, "label").select(
        "class_key", "label", "class_id", (F.coalesce("link_docs", F.lit(0)) + F.col("docs") - 1).alias("n_links"),
        F.coalesce("link_classes", F.lit(0)).alias("n_class_links")), "join_classes_named")
    return table.select("doc_id", "digest", "class_key").join(named, "class_key", "left").select(
        "doc_id", "digest", "label", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_class_links", F.lit(0)).cast("bigint").alias("n_class_links"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of linked documents: the least doc_id, a null
    one last; among texts that share it, the least text digest."""
    key = F.struct(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("digest"))
    own = F.struct(F.col("doc_id").alias("id"), "digest")
    kept = (linked_rows(docs).groupBy("label", F.when(F.col("label").isNull(), own).alias("alone"))
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), own.alias("key"))).alias("least"))
            .select(F.col("least.key").alias("__key")))
    # one key for the join and the window, so that the texts are shuffled once
    rows = docs.withColumn("__key", key).hint("merge").join(kept, "__key", "left_semi")
    first = Window.partitionBy("__key").orderBy("__key")  # rows that repeat a doc_id and its text
    return rows.withColumn("__copy", F.row_number().over(first)).filter("__copy = 1").select(*docs.columns)
