"""Exact duplicates through counting quotient filters.

Each partition builds filters of its texts' 64-bit fingerprints, one for each
segment (leading bits) of the fingerprint space.  In a filter the next bits of
a fingerprint, its quotient, say which run it belongs to, and the remainders of
a run lie sorted in consecutive slots; an occupied bit marks quotients that have
a run, a run-end bit marks a run's last slot, and a counter bit marks a slot that
holds the count of the remainder before it.  Decoding gives the fingerprints back
in order, so the filters of a segment merge without loss: sorted remainders are
merged and equal ones add their counts (Pandey et al., "A general-purpose counting filter").

Fingerprints that the merged filters count once are unique texts.  The others
go to byte verification: their rows' normalised texts are grouped by the bytes
themselves.  A text held by a third of all rows is one counter in a filter and
one row of each task's partial count.  Joins to its rows read written tables on
both sides, so AQE splits them.  Filters are spread by segment and sized by
the rows, so no task holds the fingerprints of a growing share of the corpus.

Defined cases: null counts as an empty text; case of A-Z is ignored; of equal texts
the largest doc_id stays, and among rows that repeat that doc_id just one; null
doc_ids stay only if their group has no other; an empty table gives an empty table;
only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import fold_case, held_by_worker, materialize

QUOTIENT_BITS = 12  # at most; a filter of few fingerprints has fewer, so that its bitmap grows with them
SEGMENT_ROWS = 1 << 15  # fingerprints in a segment, about
FLUSH = 1 << 20  # fingerprints a task holds before it writes filters


def encode_filter(values: np.ndarray, counts: np.ndarray, segment_bits: int) -> bytes:
    """A filter of distinct sorted fingerprints of one segment and their counts."""
    quotient_bits = min(QUOTIENT_BITS, max(1, len(values).bit_length()))
    remainder_bits = np.uint64(64 - segment_bits - quotient_bits)
    body = values & np.uint64((1 << (64 - segment_bits)) - 1)
    quotients = (body >> remainder_bits).astype(np.int64)
    remainders = body & np.uint64((1 << int(remainder_bits)) - 1)
    many = counts > 1
    slots = np.repeat(remainders, 1 + many)
    place = np.arange(len(values)) + np.cumsum(many) - many  # each remainder's slot
    counters = np.zeros(len(slots), bool)
    counters[place[many] + 1] = True
    slots[place[many] + 1] = counts[many].astype(np.uint64)
    run_ends = np.zeros(len(slots), bool)
    last = np.append(quotients[1:] != quotients[:-1], True) if len(values) else np.zeros(0, bool)
    run_ends[place[last] + many[last]] = True
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients] = True
    return b"".join((np.uint32(len(slots)).tobytes(), np.uint8(quotient_bits).tobytes(), np.packbits(occupied).tobytes(),
                     np.packbits(run_ends).tobytes(), np.packbits(counters).tobytes(), slots.astype("<u8").tobytes()))


def decode_filter(blob: bytes, segment: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints of a filter, sorted, and their counts."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    quotient_bits = blob[4]
    bits, bitmap = (n + 7) // 8, ((1 << quotient_bits) + 7) // 8
    slots_at = 5 + bitmap
    occupied = np.unpackbits(np.frombuffer(blob, np.uint8, bitmap, 5))
    run_ends = np.unpackbits(np.frombuffer(blob, np.uint8, bits, slots_at), count=n)
    counters = np.unpackbits(np.frombuffer(blob, np.uint8, bits, slots_at + bits), count=n).astype(bool)
    slots = np.frombuffer(blob, "<u8", n, slots_at + 2 * bits).astype(np.uint64)
    run = np.cumsum(run_ends) - run_ends
    quotients = np.flatnonzero(occupied)[run].astype(np.uint64)
    remainder_bits = np.uint64(64 - segment_bits - quotient_bits)
    top = np.uint64(segment) << np.uint64(64 - segment_bits) if segment_bits else np.uint64(0)
    values = top | quotients << remainder_bits | slots
    counts = np.ones(n, np.int64)
    counts[np.flatnonzero(counters) - 1] = slots[counters].astype(np.int64)
    return values[~counters], counts[~counters]


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprint runs merged; equal fingerprints add their counts."""
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")  # merges runs that are sorted already
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.add.reduceat(counts, first)


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and SHA-256 of every normalised text (bytes.lower folds A-Z only)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held_by_worker()
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]
            prints = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "fp": pa.array(prints),
                "sha": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())})

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
                .mapInArrow(run, "doc_id bigint, fp bigint, sha string"))


def quotient_filters(digests: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The merged filters (segment, filter) of a table of fingerprints, and the segment bits."""
    segment_bits = max(0, (max(1, rows) // SEGMENT_ROWS).bit_length())

    def flush(prints: np.ndarray) -> pd.DataFrame:
        values, counts = np.unique(prints, return_counts=True)
        segments = (values >> np.uint64(64 - segment_bits)).astype(np.int64) if segment_bits else np.zeros(len(values), np.int64)
        cut = np.flatnonzero(np.append(True, segments[1:] != segments[:-1])) if len(values) else np.zeros(0, int)
        stops = np.append(cut[1:], len(values))
        return pd.DataFrame({"segment": segments[cut], "filter": [
            encode_filter(values[a:b], counts[a:b], segment_bits) for a, b in zip(cut, stops, strict=True)]})

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in frames:
            held.append(pdf["fp"].to_numpy(np.int64).view(np.uint64))
            n += len(pdf)
            if n >= FLUSH:
                yield flush(np.concatenate(held))
                held, n = [], 0
        if n:
            yield flush(np.concatenate(held))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        segment = int(pdf["segment"].iloc[0])
        values, counts = merge_counts([decode_filter(b, segment, segment_bits) for b in pdf["filter"]])
        return pd.DataFrame({"segment": [segment], "filter": [encode_filter(values, counts, segment_bits)]})

    schema = "segment bigint, filter binary"
    partial = digests.select("fp").mapInPandas(build, schema)
    return partial.groupBy("segment").applyInPandas(merge, schema), segment_bits


def repeated_fingerprints(filters: DataFrame, segment_bits: int) -> DataFrame:
    """The fingerprints that the filters count more than once."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for segment, blob in zip(pdf["segment"], pdf["filter"], strict=True):
                values, counts = decode_filter(blob, segment, segment_bits)
                yield pd.DataFrame({"fp": values[counts > 1].view(np.int64), "n": counts[counts > 1]})

    return filters.mapInPandas(run, "fp bigint, n bigint")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    digests = materialize(text_digests(docs).withColumn("row", F.monotonically_increasing_id()), "dedup_digests")
    filters, bits = quotient_filters(digests, digests.count())
    repeated = materialize(repeated_fingerprints(filters, bits), "dedup_repeated")
    routed = materialize(digests.join(repeated, "fp", "left_semi").select("doc_id", "row", "sha"), "dedup_routed")
    ids = routed.select(F.col("doc_id").alias("routed_id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # the routed rows are a share of the input: one plan at every size, a shuffle of both sides
    same_bytes = (texts.hint("merge").join(ids, F.col("doc_id").eqNullSafe(F.col("routed_id")), "left_semi")
                       .groupBy(fold_case(F.col("text")).alias("text")).agg(F.count(F.lit(1)).alias("same"))
                       .select(F.sha2("text", 256).alias("sha"), "same"))
    groups = (routed.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
                    .join(same_bytes, "sha").filter("n = same AND n > 1")
                    .select("sha", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "n"))
    groups = materialize(groups, "dedup_groups")
    return digests.join(groups, "sha", "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    key = F.struct(F.col("doc_id").cast("bigint").alias("id"), F.sha2(fold_case(F.col("text")), 256).alias("sha"))
    kept = exact_duplicates(docs).filter("kept").select(
        F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias("__key"))
    # one key for the join and the window, so that the texts are shuffled once
    rows = docs.withColumn("__key", key).hint("merge").join(kept, "__key", "left_semi")
    first = Window.partitionBy("__key").orderBy("__key")  # rows that repeat a doc_id and its text
    return rows.withColumn("__copy", F.row_number().over(first)).filter("__copy = 1").select(*docs.columns)
