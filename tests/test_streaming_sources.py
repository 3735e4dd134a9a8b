"""Streams against their batch answers (several micro-batches, restarts) and file sources."""

import gzip
import os
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cairn.operators import toolcalls as TC
from cairn.session import fresh_path
from cairn.sources import files as FS
from cairn.sources import records as RC
from cairn.streaming import pipelines as PL
from cairn.streaming import runner as RN
from cairn.streaming import toolcalls as TS


def _split_table(src, name, parts, write=None):
    """Write the rows of one landed table as ``parts`` files, in row order
    (only the parts listed in ``write``, when given)."""
    d = tempfile.mkdtemp(prefix="cairn-stream-")
    _write_parts(src, d, name, parts, range(parts) if write is None else write)
    return d


def _write_parts(src, d, name, parts, which):
    """The file source orders files by modification time: give part i time base + i."""
    t = pq.read_table(src)
    step = -(-t.num_rows // parts)
    for i in which:
        path = os.path.join(d, f"{name}_{i}.parquet")
        pq.write_table(t.slice(i * step, step), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def test_tool_calls_stream_equals_batch_over_batches(spark, sf_small):
    d = _split_table(f"{sf_small}/events.parquet", "events", 3)
    stream = TS.tool_call_events(RN.table_stream(spark, d, "events", max_files_per_trigger=1))
    got = RN.run_to_table(TS.tool_calls_stream(stream), "append", "t").select("call_id", "ord")
    batch = TC.kept_events(TS.tool_call_events(spark.read.parquet(d))).select("call_id", "ord")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_ingest_stream_restart_is_idempotent(spark, sf_small):
    src = f"{sf_small}/documents.parquet"
    d = _split_table(src, "documents", 2, write=[0])  # only the first file exists at the first run
    cache_root = fresh_path(spark, "test_cache")
    ckpt = fresh_path(spark, "test_ckpt")
    docs = lambda: RN.table_stream(spark, d, "documents", "doc_id", "text", max_files_per_trigger=1)
    RN.run_foreach_batch(docs(), PL.ingest_batch(cache_root), checkpoint=ckpt)
    first = PL.read_hash_cache(spark, cache_root).count()
    _write_parts(src, d, "documents", 2, [1])  # the second file lands later
    RN.run_foreach_batch(docs(), PL.ingest_batch(cache_root), checkpoint=ckpt)   # restart from checkpoint
    RN.run_foreach_batch(docs(), PL.ingest_batch(cache_root), checkpoint=ckpt)   # nothing new: no-op
    cache = PL.read_hash_cache(spark, cache_root)
    distinct = spark.read.parquet(d).select(F.sha2("text", 256)).distinct().count()
    assert first <= cache.count() == distinct == cache.select("hash").distinct().count()


def test_table_stream_reads_files_and_folders_of_part_files(spark):
    d = fresh_path(spark, "stream_folders")
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string")
    rows(1, 2, 3, 4).repartition(3).write.parquet(f"{d}/documents.parquet")  # a folder, as Spark writes it
    rows(7).write.parquet(f"{d}/labels.parquet")
    ckpt, out = fresh_path(spark, "folders_ckpt"), fresh_path(spark, "folders_out")

    def run():
        RN.run_to_files(RN.table_stream(spark, d, "documents", "doc_id", max_files_per_trigger=1), out, ckpt)
        return sorted(r[0] for r in spark.read.parquet(out).collect())

    assert run() == [1, 2, 3, 4]
    pq.write_table(rows(5).toArrow(), f"{d}/documents_later.parquet")  # later ones: a file beside, part files in both folders
    rows(6).write.parquet(f"{d}/documents_more.parquet")
    rows(8).write.mode("append").parquet(f"{d}/documents.parquet")
    assert run() == [1, 2, 3, 4, 5, 6, 8]


def test_scan_walk_and_read(spark):
    root = fresh_path(spark, "tree")
    rows = [("/r/a.py", "print(1)", False), ("/r/.git/b.py", "x", False), ("/r/_u.py", "y", False),
            ("/r/e.py", "", False), ("/r/z.md", "héllo", True), ("/r/bad.txt", None, False)]
    df = spark.createDataFrame(rows, "path string, content string, gz boolean")
    FS.land_files(df, root, compress=F.col("gz")).write.parquet(root + "_m")
    with open(os.path.join(root, "r", "bad.txt"), "wb") as f:
        f.write(b"\xff\xfe bad")
    scanned = {p.split("/r/")[-1] for p in [r["path"] for r in FS.scan_files(spark, root).collect()]}
    assert scanned == {"a.py", ".git/b.py", "_u.py", "e.py", "z.md.gz", "bad.txt"}  # hidden, '_' and empty files too
    walked = {p.split("/r/")[-1] for p in [r["path"] for r in FS.walk_files(spark, root).collect()]}
    assert walked == {"a.py", ".git/b.py", "_u.py", "e.py", "z.md.gz", "bad.txt"}
    text = {r["path"].split("/r/")[-1]: r["text"] for r in FS.read_corpus(spark, root).collect()}
    assert text == {"a.py": "print(1)", ".git/b.py": "x", "_u.py": "y", "e.py": "", "z.md.gz": "héllo",
                    "bad.txt": None}   # invalid UTF-8 -> null, row kept
    native = {r["path"].split("/r/")[-1]: r["text"] for r in FS.read_text_corpus(spark, root).collect()}
    assert native == text              # Spark's text source and the rest by path agree
    assert gzip.decompress(open(os.path.join(root, "r", "z.md.gz"), "rb").read()) == "héllo".encode()


def test_hash_cache_load_missing_then_roundtrip(spark):
    path = fresh_path(spark, "hc")
    assert RC.load_hash_cache(spark, path).count() == 0
    c = spark.createDataFrame([("h1", "f1"), ("h1", "f1"), ("h2", "f2")], "hash string, file_id string")
    RC.save_hash_cache(c, path)
    assert sorted(map(tuple, RC.load_hash_cache(spark, path).collect())) == [("h1", "f1"), ("h2", "f2")]


def test_watch_polls_until_stopped(spark, sf_small):
    from cairn.operators import stores as ST
    seen = []
    docs = RN.table_stream(spark, sf_small, "documents", "doc_id", "source", "text")
    status = PL.file_status_stream(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    q = RN.watch(ST.store_status(status, "store"), lambda df, i: seen.append(df.count()), every="1 second")
    q.processAllAvailable()
    q.stop()
    assert seen and seen[0] > 0


def test_tool_calls_with_table_state_equal_batch_and_restart(spark, sf_small):
    src = f"{sf_small}/events.parquet"
    d = _split_table(src, "events", 3, write=[0])
    root, ckpt = fresh_path(spark, "tc_table"), fresh_path(spark, "tc_table_ckpt")

    def run():
        ev = TS.tool_call_events(RN.table_stream(spark, d, "events", max_files_per_trigger=1))
        RN.run_foreach_batch(ev, TS.kept_events_batch(root), checkpoint=ckpt)

    run()
    _write_parts(src, d, "events", 3, [1, 2])   # later events arrive after a stop
    run()                                        # restart: completed calls are remembered
    run()                                        # nothing new: no duplicate output
    got = TS.read_kept(spark, root).select("call_id", "ord")
    batch = TC.kept_events(TS.tool_call_events(spark.read.parquet(d))).select("call_id", "ord")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_a_replayed_batch_writes_the_same(spark, sf_small):
    events = TS.tool_call_events(spark.read.parquet(f"{sf_small}/events.parquet"))
    root = fresh_path(spark, "tc_replay")
    step = TS.kept_events_batch(root)
    half = events.filter("ord % 2 = 0"), events.filter("ord % 2 = 1")
    step(half[0], 0)
    step(half[1], 1)
    before = sorted(map(tuple, TS.read_kept(spark, root).collect()))
    step(half[1], 1)
    assert sorted(map(tuple, TS.read_kept(spark, root).collect())) == before


def test_completed_calls_restart(spark, sf_small):
    src = f"{sf_small}/events.parquet"
    d = _split_table(src, "events", 2, write=[0])
    out, ckpt = fresh_path(spark, "cc_out"), fresh_path(spark, "cc_ckpt")

    def run():
        ev = TS.tool_call_events(RN.table_stream(spark, d, "events", max_files_per_trigger=1))
        RN.run_to_files(TS.completed_calls_stream(ev), out, ckpt)

    run()
    _write_parts(src, d, "events", 2, [1])
    run()
    run()
    got = spark.read.parquet(out)
    done = TS.tool_call_events(spark.read.parquet(d)).filter("phase = 'done'").select("call_id").distinct().count()
    assert got.count() == got.select("call_id").distinct().count() == done


def test_oversize_files_are_rejects_and_single_child_roots_fan_out(spark):
    root = fresh_path(spark, "oversize")
    rows = [(f"/r/d{i}/f{j}.py", "x" * (10 if j else 1000), False) for i in range(6) for j in range(2)]
    df = spark.createDataFrame(rows, "path string, content string, gz boolean")
    FS.land_files(df, root).write.parquet(root + "_m")
    small = FS.scan_contents(spark, root, max_bytes=100)
    assert sorted(r["path"][-4:] for r in small.collect()) == ["1.py"] * 6
    rejects = FS.oversize_files(FS.scan_files(spark, root), 100).collect()
    assert len(rejects) == 6 and all(r["length"] == 1000 for r in rejects)
    # one child below the root: its six directories are still listed by several tasks
    listed = FS.walk_files(spark, root)
    assert listed.count() == 12 and listed.rdd.getNumPartitions() > 1
