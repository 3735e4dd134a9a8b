"""Token ids as length-delimited binary records with an offset index.

A record is: length (8 bytes, little-endian), masked checksum of those bytes,
the serialized sequence, masked checksum of the sequence (4 bytes each).  The
sequence is a null flag and doc_id, then its ids, 2 bytes each where the
vocabulary has at most 65,536 ids, else 4.  A checksum is a CRC-32 rotated right by 15
bits plus a constant, so that a file's checksum over its own checksums stays
sound.  Each file has an index of its own: the offset of every record, 8 bytes each, so
records can be read in any order, or any part of a file by itself.

Documents are range-partitioned by doc_id; each task streams its range into one
file and one index under a name of its own attempt and reports them in a
manifest row.  The manifest is a Parquet table, written when all tasks are done:
a lost executor's task is run again under another name, and files that no
manifest row names are never read.  Starting positions come from the manifest
(a row per file).  Files go to the shared folder; nothing passes through the driver.

Defined cases: a null or empty text is one record with just the end id; null
doc_ids come first; rows with equal doc_ids are ordered by a digest of their text;
an empty table gives an empty manifest and an empty result; only doc_id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, partitions_for
from cairn.llm.pieces import encoder_of
from cairn.session import fresh_path

MASK = 0xA282EAD8  # fixed value: the constant of masked checksums
SHARD_BYTES = 16 << 20  # text in a file, about
MANIFEST = "shard int, file string, index_file string, records bigint, ids bigint, bytes bigint, width int"


class DamagedRecord(ValueError):
    """A record's checksum doesn't fit its bytes."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> bytes:
    """The payload of the record at an offset; raises where a checksum doesn't fit."""
    head = data[at:at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise DamagedRecord(f"length at {at}")
    size = struct.unpack("<Q", head)[0]
    payload = data[at + 12:at + 12 + size]
    if len(payload) < size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
        raise DamagedRecord(f"sequence at {at}")
    return payload


def serialize(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<?q", doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    known, doc_id = struct.unpack_from("<?q", payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=9)


def open_folder(uri: str):
    """(file system, path) of a folder or file of the shared store."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0,
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every row of ``docs`` (doc_id, text) into record files; returns the manifest."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(spec.value)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, base = open_folder(folder)
        name, end = None, np.array([end_id], "<u4")
        records = ids_written = at = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                if name is None:
                    fs.create_dir(base, recursive=True)
                    shard = TaskContext.get().partitionId()
                    name = f"{base}/part-{shard:06d}-{uuid.uuid4().hex}"
                    out, index = fs.open_output_stream(f"{name}.rec"), fs.open_output_stream(f"{name}.idx")
                offsets = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids = np.concatenate([np.frombuffer(ids, "<u4"), end])
                    record = frame(serialize(doc_id, ids, width))
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                    records += 1
                    ids_written += len(ids)
                index.write(np.array(offsets, "<u8").tobytes())
        if name is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "file": [f"{name}.rec"], "index_file": [f"{name}.idx"],
                "records": [records], "ids": [ids_written], "bytes": [at], "width": pa.array([width], pa.int32())})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = texts.repartitionByRange(partitions_for(size, shard_bytes), *order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(run, MANIFEST), "record_manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest and the number of ids before each file (a row per file: small)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _record_positions(fs, index_file: str, bytes_total: int) -> tuple[np.ndarray, np.ndarray]:
    with fs.open_input_stream(index_file) as f:
        starts = np.frombuffer(f.read(), "<u8").astype(np.int64)
    return starts, np.append(starts[1:], bytes_total)


def read_records(spark: SparkSession, manifest: DataFrame, folder: str, with_ids: bool = False,
                 seed: int | None = None) -> DataFrame:
    """Every record of a manifest's files: doc_id, start, n_tokens, ids_crc32 (and the ids).

    ``seed`` reads each file's records in shuffled order through its index.
    A file is read by runs of about 8 MB in file order, or record by record when shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for batch in batches:
            for m in batch.to_pylist():
                starts, stops = _record_positions(fs, m["index_file"], m["bytes"])
                # ids before each record: its size says how many it holds
                counts = (stops - starts - 16 - 9) // m["width"]
                first = m["start"] + np.cumsum(counts) - counts
                order = np.arange(len(starts))
                if seed is not None:
                    order = np.random.default_rng([seed, m["shard"]]).permutation(order)
                rows = 256 if seed is not None else max(1, int(8e6 // max(1, m["bytes"] // max(1, len(starts)))))
                with fs.open_input_file(m["file"]) as f:
                    for at in range(0, len(order), rows):
                        these = order[at:at + rows]
                        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
                        block, base = b"", 0
                        if seed is None:
                            base = int(starts[these[0]])
                            block = f.read_at(int(stops[these[-1]]) - base, base)
                        for i in these:
                            if seed is not None:
                                base = int(starts[i])
                                block = f.read_at(int(stops[i]) - base, base)
                            doc_id, ids = deserialize(unframe(block, int(starts[i]) - base), m["width"])
                            ids = ids.astype("<u4")
                            out["doc_id"].append(doc_id)
                            out["start"].append(int(first[i]))
                            out["n_tokens"].append(len(ids))
                            out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                            out["ids"].append(ids.astype(np.int64) if with_ids else None)
                        kinds = {k: pa.int64() for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
                        kinds |= {"ids": pa.list_(pa.int64())} if with_ids else {}
                        yield pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in kinds.items()})

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    files = manifest.agg(F.count(F.lit(1))).first()[0]
    return with_starts(manifest).repartition(max(1, files), "shard").mapInArrow(run, schema)


def record_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents as record files in the shared folder, then read them back."""
    folder = fresh_path(docs.sparkSession, "token_records")
    return read_records(docs.sparkSession, write_records(docs, vocabulary, folder), folder)
