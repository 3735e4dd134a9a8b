"""A lexical index of blocks of chunks, bucketed by term, that grows by commits.

* **Blocks.**  Chunks are numbered as they are written; ``BLOCK`` consecutive ones form a block.
  A posting row is one term in one block: place, term frequency and chunk length of the chunks
  that hold it, packed into six bytes each.
* **Buckets.**  Posting rows lie in ``BUCKETS`` files by hash of the term, sorted by term, so a
  search with few terms opens only their buckets.
* **Commits.**  Every batch of documents becomes one segment, written in proportion to the batch: its
  chunks, its postings, and the ids whose earlier versions it replaces or removes.  A
  segment is published by creating a small marker file; what no marker names is never
  read, so a failed or repeated write leaves no trace.  ``FAN`` neighbouring
  segments of one level are merged into one of the next, without the chunks that
  have been replaced, so the number of segments stays logarithmic.
* **Search** is exact BM25 (k1, b; idf = ln(1 + (N - df + 0.5) / (df + 0.5))) over the live chunks of all
  segments: statistics are taken at search time, so a grown index answers as a fresh one.
  The postings of all questions' terms are shuffled once, without the chunks that have gone, and written as
  a row a block.  Questions are taken in groups of a bounded number of terms and broadcast; a group
  passes over the block rows without another shuffle, scored with numpy, so what a search
  writes doesn't grow with the groups.  A sample of the blocks gives each question a threshold first (its
  k-th best score there), which the blocks that a task has seen raise; a question passes by every run of
  ``RUN`` chunks that can't reach it by the sum of its terms' greatest contributions.  In a block its terms
  are added up in whole units, rounded up; only what reaches the threshold so is scored in double.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from cairn.functions import text as T
from cairn.functions.ordinal import top_k
from cairn.operators.retrieval import B, K1, chunk_documents
from cairn.session import delete_path, fresh_path, written

BLOCK, RUN = 65_536, 1_024  # chunks of a block (65,536 at most), and of a run of chunks within it
BUCKETS = 32
FAN = 4  # segments of one level that are merged
GROUP_PAIRS = 1_000_000  # (question, term) pairs searched together: what is collected and broadcast at once
LITERAL_TERMS = 2_000  # terms named in the filter at most, so that buckets are pruned; more are joined
SAMPLE = 16  # one block in so many gives the thresholds
HELD_HITS = 1_000_000  # rows of hits that a task has at once
ROW_GROUP = 16 << 20  # bytes of block rows in a row group
MARGIN = 1e-6  # scores are rounded to six decimals
DENSE = 16  # a term in one of so many chunks of a block, or in more, is held as a row over all its places
LATE = 0.5  # of the threshold: what the commonest terms may add that are looked up only where the others come so close
FEW = 8  # where one run in so many, or fewer, can reach the threshold, only their entries are gathered

_ENTRY = np.dtype([("place", "<u2"), ("tf", "<u2"), ("dl", "<u2")])
_POSTINGS = pa.schema([("term", pa.string()), ("block", pa.int64()), ("entries", pa.binary())])
_POSTINGS_DDL = "term string, block bigint, entries binary"


# ------------------------------------------------------------------ building

def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of chunk rows (block, place, n_tokens, text) in order; a block may come in several pieces."""
    for batch in batches:
        tokens = pc.split_pattern(batch.column("text"), " ")
        sizes = np.diff(tokens.offsets.to_numpy())
        coded = tokens.flatten().dictionary_encode()
        if not len(coded):
            continue
        rows = np.repeat(np.arange(len(sizes)), sizes)
        keys, tfs = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sizes) + rows, return_counts=True)
        terms, rows = keys // len(sizes), keys % len(sizes)
        blocks, places, dls = (batch.column(c).to_numpy()[rows] for c in ("block", "place", "n_tokens"))
        begins = np.flatnonzero(np.append(True, (np.diff(terms) != 0) | (np.diff(blocks) != 0)))
        entries = np.empty(len(keys), _ENTRY)
        entries["place"], entries["tf"], entries["dl"] = places, tfs, dls
        ends = pa.array(np.append(begins, len(keys)) * _ENTRY.itemsize, pa.int32())
        packed = pa.Array.from_buffers(pa.binary(), len(begins), [None, ends.buffers()[1], pa.py_buffer(entries.tobytes())])
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(terms[begins])), pa.array(blocks[begins], pa.int64()), packed], schema=_POSTINGS)


def _placed(chunks: DataFrame) -> DataFrame:
    """Chunk rows with their block and place; written by the caller, since numbers follow the rows' partitions."""
    number = F.monotonically_increasing_id()
    shift = int(math.log2(BLOCK))
    return (chunks.select("doc_id", "chunk_no", "n_tokens", "text").withColumn("_n", number)
                  .withColumn("block", F.shiftright("_n", shift)).withColumn("place", F.col("_n").bitwiseAND(BLOCK - 1).cast("int")).drop("_n"))


def _table(path: str) -> str:
    """The name of the bucketed table over ``path`` in this session's catalog."""
    return "cairn_postings_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _write_postings(chunks: DataFrame, path: str, buckets: int) -> None:
    spark = chunks.sparkSession
    rows = chunks.select("block", "place", "n_tokens", "text").mapInArrow(_post, _POSTINGS_DDL)
    (rows.repartition(buckets, "term").write.bucketBy(buckets, "term").sortBy("term", "block")
         .option("compression", "zstd").option("path", path).mode("overwrite").saveAsTable(_table(path)))


def _read_postings(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    name = _table(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_POSTINGS_DDL}) USING parquet "
              f"CLUSTERED BY (term) SORTED BY (term, block) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


class Snapshot(NamedTuple):
    """The live index as of one commit."""
    postings: DataFrame  # term, block, entries, segment: with the chunks that have gone
    chunks: DataFrame  # segment, block, place, doc_id, chunk_no, n_tokens, text (tokens joined by a space): live ones
    n_docs: int  # live chunks
    avgdl: float
    gone: DataFrame | None  # segment, block, gone: the places in a block whose chunks have gone (none if nothing was replaced)


class BlockIndex:
    """An index in a folder that all executors share; one writer at a time adds to it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ------------------------------------------------------------ commits

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def commits(self) -> list[dict]:
        """All markers in order (a small file a commit)."""
        fs, log = self._fs(f"{self.root}/log")
        if not fs.exists(log):
            return []
        jvm, texts = self.spark.sparkContext._jvm, []
        for status in fs.listStatus(log):
            stream = fs.open(status.getPath())
            texts.append(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return sorted((json.loads(t) for t in texts if t.endswith("}")), key=lambda c: c["number"])

    def _publish(self, commit: dict) -> None:
        fs, marker = self._fs(f"{self.root}/log/{commit['number']:010d}.json")
        try:
            out = fs.create(marker, False)  # fails if another writer was faster
        except Py4JJavaError as e:
            raise RuntimeError(f"commit {commit['number']} was made by another writer") from e
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()

    def live(self) -> list[dict]:
        """The segments that make up the index, oldest first; a merged one stands where its newest part stood."""
        held: list[dict] = []
        for c in self.commits():
            if c["replaces"]:
                at = [i for i, x in enumerate(held) if x["number"] in c["replaces"]]
                held[at[0]:at[-1] + 1] = [c]
            else:
                held.append(c)
        return held

    def _commit(self, chunks: DataFrame | None, gone: DataFrame | None, level: int, replaces: list[int], batch) -> dict:
        number = max((c["number"] for c in self.commits()), default=-1) + 1
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        n = 0
        if chunks is not None:
            _placed(chunks).write.option("compression", "zstd").parquet(f"{path}/chunks")
            placed = self.spark.read.parquet(f"{path}/chunks")
            n = placed.count()
            _write_postings(placed, f"{path}/postings", self.buckets)
        if gone is not None:
            gone.select("doc_id").distinct().write.parquet(f"{path}/gone")
        commit = {"number": number, "path": path, "n_chunks": n, "gone": gone is not None, "level": level, "replaces": replaces, "batch": batch}
        self._publish(commit)
        return commit

    def add(self, docs: DataFrame, size: int = 64, overlap: int = 16, batch=None) -> None:
        """Documents (doc_id, text) join the index; earlier versions of their ids leave it.

        ``batch``: a name by which a repeated call is known and does nothing (a replayed micro-batch).
        """
        if size > np.iinfo(_ENTRY["dl"]).max:
            raise ValueError("a chunk's length has two bytes")
        self.add_chunks(chunk_documents(docs, size=size, overlap=overlap), docs.select("doc_id"), batch)

    def add_chunks(self, chunks: DataFrame, ids: DataFrame | None = None, batch=None) -> None:
        """The same for chunks (doc_id, chunk_no, n_tokens, text: tokens joined by a space); ``ids``: the documents they replace, if any."""
        if batch is not None and any(c["batch"] == batch for c in self.commits()):
            return
        self._commit(chunks, ids, 0, [], batch)

    def remove(self, ids: DataFrame, batch=None) -> None:
        """Documents whose ``doc_id`` is in ``ids`` leave the index."""
        if batch is None or not any(c["batch"] == batch for c in self.commits()):
            self._commit(None, ids, 0, [], batch)

    def merge(self) -> int:
        """Merge the newest ``FAN`` segments while they are of one level; the number of merges."""
        made = 0
        while True:
            newest = self.live()[-FAN:]
            if len(newest) < FAN or len({c["level"] for c in newest}) > 1:
                return made
            chunks, gone = self._chunks(newest), self._gone(newest)
            self._commit(chunks, gone, newest[0]["level"] + 1,
                         [c["number"] for c in newest], None)
            made += 1

    def vacuum(self) -> int:
        """Remove the data of merged segments and of writes that were never published; the number of folders.
        Nobody may be writing, nor reading an older snapshot."""
        kept = {c["path"].rsplit("/", 1)[1] for c in self.live()}
        fs, data = self._fs(f"{self.root}/data")
        names = [s.getPath().getName() for s in fs.listStatus(data)] if fs.exists(data) else []
        for name in names:
            if name not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {_table(f'{self.root}/data/{name}/postings')}")
                delete_path(self.spark, f"{self.root}/data/{name}")
        return len(set(names) - kept)

    # ------------------------------------------------------------ reading

    def _gone(self, segments: list[dict]) -> DataFrame | None:
        """(doc_id, after): the position of the newest segment that replaces or removes a document."""
        out = None
        for at, c in enumerate(segments):
            if c["gone"]:
                ids = self.spark.read.parquet(f"{c['path']}/gone").withColumn("after", F.lit(at))
                out = ids if out is None else out.unionByName(ids)
        return None if out is None else out.groupBy("doc_id").agg(F.max("after").alias("after"))

    def _with_fate(self, segments: list[dict], *columns: str) -> DataFrame:
        """Chunk rows of all segments with ``dead``: whether a later segment replaces or removes their document."""
        out = None
        for at, c in enumerate(segments):
            if c["n_chunks"]:
                rows = (self.spark.read.parquet(f"{c['path']}/chunks").select("doc_id", *columns)
                            .withColumn("segment", F.lit(c["number"])).withColumn("_at", F.lit(at)))
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            empty = "doc_id bigint, chunk_no bigint, n_tokens bigint, text string, block bigint, place int, segment int, dead boolean"
            return self.spark.createDataFrame([], empty).select("doc_id", *columns, "segment", "dead")
        gone = self._gone(segments[1:])  # the oldest has nothing to replace
        if gone is None:
            return out.drop("_at").withColumn("dead", F.lit(False))
        # a written table, so that a skewed join with it can be split
        gone = written(gone.select(F.col("doc_id").alias("_id"), F.col("after") + 1), "index_gone").toDF("_id", "after")
        return (out.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
                   .withColumn("dead", F.coalesce(F.col("after") > F.col("_at"), F.lit(False))).drop("_id", "_at", "after"))

    def _chunks(self, segments: list[dict]) -> DataFrame:
        return self._with_fate(segments, "chunk_no", "n_tokens", "text", "block", "place").filter(~F.col("dead")).drop("dead")

    def snapshot(self) -> Snapshot:
        segments = self.live()
        postings = None
        for c in segments:
            if c["n_chunks"]:
                rows = _read_postings(self.spark, f"{c['path']}/postings", self.buckets).withColumn("segment", F.lit(c["number"]))
                postings = rows if postings is None else postings.unionByName(rows)
        if postings is None:
            postings = self.spark.createDataFrame([], f"{_POSTINGS_DDL}, segment int")
        n, mean = self._with_fate(segments, "n_tokens").filter(~F.col("dead")).agg(F.count(F.lit(1)), F.avg("n_tokens")).first()
        gone = None
        if any(c["gone"] for c in segments[1:]):  # a block's gone places: BLOCK of them at most
            gone = written(self._with_fate(segments, "block", "place").filter("dead").groupBy("segment", "block")
                               .agg(F.collect_set("place").alias("gone")), "index_gone_places")
        return Snapshot(postings, self._chunks(segments), int(n or 0), float(mean or 0.0), gone)


def _unpacked(entries: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All entries one after the other, and how many each row has."""
    sizes = entries.map(len).to_numpy(dtype=np.int64) // _ENTRY.itemsize
    return np.frombuffer(b"".join(entries), dtype=_ENTRY), sizes


_BLOCKS_DDL = "segment int, block bigint, terms array<string>, ns array<bigint>, tfs array<bigint>, entries binary"


def _pack(key: tuple, rows: pa.Table, gone: pa.Table | None = None) -> pa.Table:
    """One row of a block's postings, without the chunks that have gone: its terms in order, each one's chunks and
    occurrences, all entries in the order of terms and places."""
    held = [_entries(c) for c in rows.column("entries").chunks]
    entries = np.concatenate([e for e, _ in held] or [np.empty(0, _ENTRY)])
    coded = rows.column("term").combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    numbers = np.repeat(rank[coded.indices.to_numpy(zero_copy_only=False)], np.concatenate([n for _, n in held] or [np.empty(0, np.int64)]))
    if gone is not None and gone.num_rows:
        alive = np.ones(1 << 16, dtype=bool)
        alive[pc.list_flatten(gone.column("gone")).to_numpy()] = False
        alive = alive[entries["place"]]
        entries, numbers = entries[alive], numbers[alive]
    sorted_ = np.argsort((numbers << 16) | entries["place"], kind="stable")
    ns = np.bincount(numbers, minlength=len(order))
    tfs = np.bincount(numbers, entries["tf"], len(order)).astype(np.int64)
    here = np.flatnonzero(ns)
    n = min(1, len(here))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)][:n + 1], pa.int32()), values)
    return pa.table([pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int64()),
                     one(coded.dictionary.take(pa.array(order[here]))), one(pa.array(ns[here], pa.int64())), one(pa.array(tfs[here], pa.int64())),
                     pa.array([entries[sorted_].tobytes()] * n, pa.binary())], names=["segment", "block", "terms", "ns", "tfs", "entries"])


def _entries(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of an array of packed ones, one after the other, and how many each has."""
    wide = packed.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    if not len(wide):
        return np.empty(0, _ENTRY), np.empty(0, np.int64)
    return np.frombuffer(wide.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(_ENTRY), np.diff(ends) // _ENTRY.itemsize


def block_rows(postings: DataFrame, gone: DataFrame | None) -> DataFrame:
    """The given postings as one row a block; each block meets its gone places once."""
    blocks = postings.select("segment", "block", "term", "entries").groupBy("segment", "block")
    if gone is None:
        return blocks.applyInArrow(lambda key, rows: _pack(key, rows), _BLOCKS_DDL)
    return blocks.cogroup(gone.groupBy("segment", "block")).applyInArrow(
        lambda key, rows, dead: _pack(key, rows, dead), _BLOCKS_DDL)


def term_stats(index: Snapshot) -> DataFrame:
    """(term, df, cf) over the live chunks."""
    rows = block_rows(index.postings, index.gone).select(F.explode(F.arrays_zip("terms", "ns", "tfs")).alias("l"))
    return rows.groupBy(F.col("l.terms").alias("term")).agg(F.sum("l.ns").alias("df"), F.sum("l.tfs").alias("cf"))


# -------------------------------------------------------------------- search

class _Scores:
    """One block's entries, in the order of terms and places, for many questions.

    A question's terms are added up as whole numbers of one byte, each weight rounded up, so that a sum is never less
    than the score; what reaches the threshold is scored again in double.
    """

    def __init__(self, numbers: np.ndarray, places: np.ndarray, weights: np.ndarray, n_terms: int):
        self.begins = np.flatnonzero(np.append(True, np.diff(numbers) != 0))[:len(numbers)]
        self.places, self.weights = places, weights
        self.row_of = np.full(n_terms, -1, np.int32)
        self.row_of[numbers[self.begins]] = np.arange(len(self.begins))
        self.sizes = np.diff(np.append(self.begins, len(numbers)))
        self.n_runs = int(places.max()) // RUN + 1 if len(places) else 0
        self.width = self.n_runs * RUN
        row = np.repeat(np.arange(len(self.begins)), self.sizes)
        self.key = row * self.width + places  # ascending
        cell = row * self.n_runs + places // RUN
        firsts = np.flatnonzero(np.append(True, np.diff(cell) != 0))[:len(cell)]
        greatest = np.zeros(len(self.begins) * self.n_runs, np.float32)
        if len(cell):
            greatest[cell[firsts]] = np.nextafter(np.maximum.reduceat(weights, firsts).astype(np.float32), np.float32(np.inf))
        self.greatest = greatest.reshape(len(self.begins), self.n_runs)
        self.most = self.greatest.max(axis=1, initial=0.0)
        # terms of many chunks are held as rows over all places: adding rows costs less than gathering entries
        self.common = np.flatnonzero(self.sizes >= max(1, self.width // DENSE))
        self.dense_of = np.full(len(self.begins), -1)
        self.dense_of[self.common] = np.arange(len(self.common))
        self.coarse = _unit(8 * max(float(self.most.max(initial=0.0)), 1e-9))
        self.units: dict = {}
        self.sums, self.some = np.zeros(self.width, np.uint16), np.zeros(self.width, np.uint8)

    def best(self, own: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the chunks that reach ``least`` by the terms of these rows; some below the k-th best may be left out."""
        bounds = self.greatest[own].sum(axis=0, dtype=np.float64)
        runs = np.flatnonzero(bounds >= least)
        if not len(runs):
            return runs, np.zeros(0)
        if len(runs) * FEW <= self.n_runs:
            at = self._entries_of(own, runs)
            first = int(runs[0]) * RUN
            scores = np.bincount(self.places[at] - first, weights=self.weights[at])
            found = np.flatnonzero((scores >= least) & (scores > 0))
            return found + first, scores[found]
        if least <= 0:  # fewer than k chunks are known to have a term
            found = np.flatnonzero(self._add_up(own, self.coarse)[0])
            scores = self._exact(own, found)
            return found[scores > 0], scores[scores > 0]
        unit = _unit(least)
        least_sum = math.ceil(least / unit - 1e-6)
        sums, late, slack = self._add_up(own, unit, int(LATE * least_sum))
        likely = np.flatnonzero(sums >= least_sum - slack)  # slack is less than least_sum
        near = sums[likely]
        for row in late:
            near += row[likely]
        kept = near >= least_sum
        likely, near = likely[kept], near[kept]
        if len(likely) > 4 * k:  # the k that seem best raise the threshold
            scores = self._exact(own, likely[_seem_best(near, k)])
            likely = likely[near >= min(255, math.ceil((scores.min() - MARGIN) / unit - 1e-6))]  # 255 may stand for more
        if not len(likely):
            return likely, np.zeros(0)
        scores = self._exact(own, likely)
        kept = (scores >= least) & (scores > 0)
        return likely[kept], scores[kept]

    def threshold(self, own: np.ndarray, k: int) -> float:
        """What k chunks reach, those that seem best; 0 if there are fewer."""
        sums = self._add_up(own, self.coarse)[0]
        return float(self._exact(own, _seem_best(sums, k)).min()) if len(sums) > k else 0.0

    def _entries_of(self, own: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """The positions of these rows' entries in these runs."""
        low = (own[:, None].astype(np.int64) * self.width + runs * RUN).ravel()
        starts, ends = np.searchsorted(self.key, low), np.searchsorted(self.key, low + RUN)
        sizes = ends - starts
        return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def _exact(self, own: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        """Scores of the chunks at these places in double."""
        wanted = own[:, None].astype(np.int64) * self.width + chunks
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.weights[at], 0.0).sum(axis=0)

    def _in_units(self, unit: float) -> tuple[np.ndarray, np.ndarray]:
        """Weights in units, rounded up, and the common terms' rows of them in one byte."""
        if unit not in self.units:
            if len(self.units) > 1:
                del self.units[next(iter(self.units))]
            small = np.minimum(np.ceil(self.weights / unit), 255).astype(np.uint16)
            rows = np.zeros((len(self.common), self.width), np.uint8)
            for i, r in enumerate(self.common):
                held = slice(self.begins[r], self.begins[r] + self.sizes[r])
                rows[i, self.places[held]] = small[held]
            self.units[unit] = small, rows
        return self.units[unit]

    def _add_up(self, own: np.ndarray, unit: float, late: int = 0) -> tuple[np.ndarray, list, int]:
        """Every place's sum in units, without the rows returned, whose sum is the number returned (``late``) at most.

        The sums are overwritten by the next call.
        """
        small, rows = self._in_units(unit)
        dense = self.dense_of[own]
        rare, own, dense = own[dense < 0], own[dense >= 0], dense[dense >= 0]
        order = np.argsort(-self.sizes[own])
        first, most = dense[order].tolist(), np.minimum(np.ceil(self.most[own[order]] / unit), 255).tolist()
        left, slack = [], 0
        while first and slack + most[0] <= late:
            slack += int(most.pop(0))
            left.append(rows[first.pop(0)])
        sums, some = self.sums, self.some
        if len(dense) + len(rare) > 257:  # times 255: more than two bytes
            sums = np.zeros(self.width, np.uint32)
        sums.fill(0)
        while first:
            top = 0
            some.fill(0)
            while first and top + most[0] <= 255:  # one byte holds so many rows
                top += most.pop(0)
                some += rows[first.pop(0)]
            sums += some
        if len(rare):
            held = [slice(b, e) for b, e in zip(self.begins[rare].tolist(), (self.begins[rare] + self.sizes[rare]).tolist())]
            np.add.at(sums, np.concatenate([self.places[h] for h in held]), np.concatenate([small[h] for h in held]).astype(sums.dtype, copy=False))
        return sums, left, slack


def _seem_best(sums: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest of more than k sums."""
    return np.array([sums.argmax()]) if k == 1 else np.argpartition(sums, len(sums) - k)[len(sums) - k:]


def _unit(score: float) -> float:
    """A power of two of which the score is 100 to 200."""
    return 2.0 ** math.ceil(math.log2(score / 200))


class _Questions(NamedTuple):
    """A group of questions: their terms as numbers, each term's idf, and each question's threshold."""
    terms: list  # arrays of term numbers
    idf: np.ndarray
    avgdl: float
    k: int
    thresholds: np.ndarray

    def in_block(self, rows: pd.DataFrame) -> pd.DataFrame:
        """(question, place, score) of one block's chunks that may be among a question's k best."""
        entries, sizes = _unpacked(rows["entries"])
        numbers = np.repeat(rows["number"].to_numpy(), sizes)
        order = np.lexsort((entries["place"], numbers))
        numbers, entries = numbers[order], entries[order]
        places, tf, dl = entries["place"].astype(np.int64), entries["tf"].astype(np.float64), entries["dl"]
        weights = self.idf[numbers] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl))
        gone = [g for g in rows["gone"] if g is not None]
        if gone:
            weights[np.isin(places, gone[0])] = 0.0
        return self._replace(thresholds=self.thresholds.copy()).best_of(numbers, places, weights)

    def best_of(self, numbers: np.ndarray, places: np.ndarray, weights: np.ndarray) -> pd.DataFrame:
        """The same for a block's entries in the order of terms and places.  What is found raises the thresholds."""
        block = _Scores(numbers, places, weights, len(self.idf))
        rows = [block.row_of[terms] for terms in self.terms]
        for q in np.flatnonzero(self.thresholds <= 0).tolist():
            own = rows[q][rows[q] >= 0]
            if len(own):
                self.thresholds[q] = block.threshold(own, self.k)
        out = []
        for q in np.argsort(self.thresholds, kind="stable").tolist():  # so that few units are in use at a time
            own = rows[q][rows[q] >= 0]
            if not len(own):
                continue
            found, scores = block.best(own, self.thresholds[q] - MARGIN, self.k)
            if len(found) >= self.k:
                kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                found, scores = found[scores >= kth - MARGIN], scores[scores >= kth - MARGIN]
                self.thresholds[q] = max(self.thresholds[q], kth)
            if len(found):
                out.append((np.full(len(found), q), found, scores))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("question", "place", "score"), columns)))

    def in_blocks(self, batches: Iterator[pa.RecordBatch], vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
        """``best_of`` of every block row, without what later blocks have passed."""
        mine = self._replace(thresholds=self.thresholds.copy())
        held: list = []

        def kept() -> pa.RecordBatch:
            hits = pd.concat(held)
            held.clear()
            hits = hits[hits["score"].to_numpy() >= mine.thresholds[hits["question"].to_numpy()] - MARGIN]
            return pa.RecordBatch.from_pandas(hits, schema=_HITS, preserve_index=False)

        for batch in batches:
            for i in range(batch.num_rows):
                terms, ns = (batch.column(c)[i].values for c in ("terms", "ns"))
                number = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy()  # ascending, as both are sorted
                sizes = ns.to_numpy()
                wanted = np.flatnonzero(number >= 0)
                if not len(wanted):
                    continue
                entries = np.frombuffer(batch.column("entries")[i].as_buffer(), dtype=_ENTRY)
                if len(wanted) < len(number):
                    entries = entries[np.repeat(number >= 0, sizes)]
                numbers, places, tf = np.repeat(number[wanted], sizes[wanted]), entries["place"].astype(np.int64), entries["tf"].astype(np.float64)
                hits = mine.best_of(numbers, places, self.idf[numbers] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * entries["dl"] / self.avgdl)))
                if len(hits):
                    hits.insert(1, "segment", batch.column("segment")[i].as_py())
                    hits.insert(2, "block", batch.column("block")[i].as_py())
                    held.append(hits)
                if sum(map(len, held)) > HELD_HITS:
                    yield kept()
        if held:
            yield kept()


_HITS = pa.schema([("question", pa.int32()), ("segment", pa.int32()), ("block", pa.int64()), ("place", pa.int32()), ("score", pa.float64())])
_HITS_DDL = "question int, segment int, block bigint, place int, score double"


def search(questions: DataFrame, index: Snapshot, k: int = 3, qid: str = "item_id", text_col: str = "text") -> DataFrame:
    """Top-``k`` chunks per question by BM25: (qid, rank, doc_id, chunk_no, score), exact.

    Scores are rounded to six decimals, ties ordered by document and chunk.  Questions
    without a token, or whose tokens no chunk holds, have no row.  Rows that share an id are one question.
    """
    spark = questions.sparkSession
    named = ST.StructType([ST.StructField("question", ST.IntegerType()), ST.StructField(qid, questions.schema[qid].dataType)])
    words = questions.select(F.col(qid).alias("id"), F.explode(T.tokens(text_col)).alias("term")).distinct()
    asked = written(words.groupBy("id").agg(F.collect_list("term").alias("terms")), "search_questions")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    if not pairs:
        none = index.chunks.limit(0).select("doc_id", "chunk_no", F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
        return none.join(spark.createDataFrame([], named), F.lit(True)).select(qid, "rank", "doc_id", "chunk_no", "score")
    terms = written(asked.select(F.explode("terms").alias("term")).distinct(), "search_terms")
    few = [r["term"] for r in terms.limit(LITERAL_TERMS + 1).collect()]
    rows = question_postings(index, sorted(few)) if len(few) <= LITERAL_TERMS else index.postings.join(terms, "term", "left_semi")
    blocks = _write_blocks(block_rows(rows, index.gone))  # every group's terms at once
    sample = _write_blocks(blocks.filter(F.pmod(F.xxhash64("segment", "block"), F.lit(SAMPLE)) == 0))
    counted = blocks.select(F.explode(F.arrays_zip("terms", "ns")).alias("l")).groupBy(F.col("l.terms").alias("term"))
    dfs = written(counted.agg(F.sum("l.ns").alias("df")), "search_dfs")
    found = None
    n = -(-pairs // GROUP_PAIRS)
    for g in range(n):
        group = asked.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == g).toArrow()
        if not group.num_rows:
            continue
        hits = _search_group(spark, group.column("terms").combine_chunks(), dfs, blocks, sample, index, k)
        names = spark.createDataFrame(pa.table({"question": pa.array(np.arange(group.num_rows), pa.int32()), qid: group.column("id")}), named)
        part = written(hits.join(F.broadcast(names), "question").drop("question"), "search_hits")
        found = part if found is None else found.unionByName(part)
    # the hits of all groups meet the chunks once
    placed = found.join(index.chunks.select("segment", "block", "place", "doc_id", "chunk_no"), ["segment", "block", "place"])
    best = top_k(placed.withColumn("score", F.round("score", 6)), [qid], [F.col("score").desc(), "doc_id", "chunk_no"], k)
    return best.select(qid, "rank", "doc_id", "chunk_no", "score")


def _write_blocks(rows: DataFrame) -> DataFrame:
    """Block rows, written; the writer looks at its memory after every few of them, since a row may have megabytes,
    and begins a row group every few, so that tasks share a file."""
    path = fresh_path(rows.sparkSession, "search_blocks")
    (rows.write.option("parquet.page.size.row.check.min", 2).option("parquet.block.size.row.check.min", 1).option("parquet.block.size", ROW_GROUP)
         .option("compression", "zstd").parquet(path))
    return rows.sparkSession.read.schema(_BLOCKS_DDL).parquet(path)


def question_postings(index: Snapshot, vocabulary: list[str]) -> DataFrame:
    """Posting rows of the vocabulary's terms, each with its term's ``number``."""
    spark = index.postings.sparkSession
    numbered = spark.createDataFrame([(t, i) for i, t in enumerate(vocabulary)], "term string, number int")
    rows = index.postings
    if len(vocabulary) <= LITERAL_TERMS:  # the filter names them, so that other buckets aren't opened
        rows = rows.filter(F.col("term").isin(vocabulary))
    return rows.join(F.broadcast(numbered), "term")  # GROUP_PAIRS rows at most, one question's terms besides


def _search_group(spark: SparkSession, terms: pa.ListArray, dfs: DataFrame, blocks: DataFrame, sample: DataFrame, index: Snapshot, k: int) -> DataFrame:
    """(question, segment, block, place, score) of what may be among a question's k best; a question is a list of terms."""
    coded = terms.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    vocabulary = coded.dictionary.take(order)
    rank = np.empty(len(vocabulary), np.int32)
    rank[order.to_numpy()] = np.arange(len(vocabulary))
    ends, flat = terms.offsets.to_numpy() - terms.offsets[0].as_py(), rank[coded.indices.to_numpy(zero_copy_only=False)]
    here = spark.createDataFrame(pa.table({"term": vocabulary}), "term string")
    held = dfs.join(F.broadcast(here), "term").toArrow()  # a row a term
    df = np.zeros(len(vocabulary))
    df[pc.index_in(held.column("term"), value_set=vocabulary).to_numpy()] = held.column("df").to_numpy()
    idf = np.where(df > 0, np.log(1.0 + (index.n_docs - df + 0.5) / (df + 0.5)), 0.0)

    def scored(rows: DataFrame, thresholds: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((flat, ends, idf, index.avgdl or 1.0, k, thresholds, vocabulary))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, ends, idf, avgdl, k, thresholds, vocabulary = shared.value
            yield from _Questions(np.split(flat, ends[1:-1]), idf, avgdl, k, thresholds).in_blocks(batches, vocabulary)

        return rows.select("segment", "block", "terms", "ns", "entries").mapInArrow(score, _HITS_DDL)

    thresholds = np.zeros(len(terms))
    best = (top_k(scored(sample, thresholds), ["question"], [F.col("score").desc()], k)
            .groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))).filter(F.col("n") >= k).toArrow()  # a row a question
    thresholds = np.zeros(len(terms))
    thresholds[best.column("question").to_numpy()] = best.column("least").to_numpy()
    return scored(blocks, thresholds)
