"""Listing difference, block fingerprints, hash choice, re-weighted summaries and readiness with expiry."""

import collections
import hashlib
import os
import tempfile

import pytest
import regex as re
import xxhash
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import listing as LI
from cairn.operators import summarize as SM
from cairn.plans import catalog
from cairn.session import fresh_path
from cairn.sources import files as FS
from cairn.streaming import readiness as RD
from cairn.streaming import runner as RN


def brute_changes(old, new):
    out = [(p, "changed", p, old[p], new[p]) for p in old if p in new and (old[p] is None or old[p] != new[p])]
    gone = collections.defaultdict(list)
    for p in sorted(set(old) - set(new)):
        gone[old[p] if old[p] is not None else ("gone", p)].append(p)
    for p in sorted(set(new) - set(old)):
        match = gone.get(new[p])
        out.append((p, "moved", match.pop(0), new[p], new[p]) if match else (p, "added", None, None, new[p]))
    return out + [(p, "removed", p, old[p], None) for ps in gone.values() for p in ps]


def test_listing_changes_by_brute_force(spark):
    old = {f"/a/{i}": "empty" if i % 3 == 0 else (None if i % 31 == 0 else f"h{i}") for i in range(200)}
    new = {(f"/b/{i}" if i % 4 == 0 else f"/a/{i}"): (f"n{i}" if i % 5 == 0 else h) for i, h in enumerate(old.values()) if i % 7}
    new |= {"/c/1": "empty", "/c/2": "brand new", "/c/3": None}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, hash string")
    for a, b in ((old, new), (new, old), ({}, new), (old, {})):
        got = [tuple(r) for r in LI.listing_changes(frame(a), frame(b)).collect()]
        assert collections.Counter(got) == collections.Counter(brute_changes(a, b))
    # hashes are known for all here: stores after the changes are those of a fresh build
    a, b = ({p: h for p, h in d.items() if h} for d in (old, new))
    store = F.regexp_extract("path", "^/([^/]*)/", 1)
    members = frame(a).select(store.alias("store"), "path", F.concat(F.lit("file-"), F.substring("hash", 1, 24)).alias("file_id"))
    got = {tuple(r) for r in LI.apply_changes(members, LI.listing_changes(frame(a), frame(b)), store).collect()}
    assert got == {(p.split("/")[1], p, "file-" + h) for p, h in b.items()}


def test_block_fingerprints_by_brute_force(spark):
    root = tempfile.mkdtemp(prefix="cairn-blocks-")
    contents = {"empty": b"", "one": b"x" * 100, "edge": b"y" * 64, "two": b"z" * 65, "many": bytes(range(256)) * 40}
    for name, data in contents.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)

    def tree(data, block, fan):
        nodes = [hashlib.sha256(data[i:i + block]).hexdigest() for i in range(0, max(1, len(data)), block)]
        while len(nodes) > 1:
            nodes = [hashlib.sha256("".join(nodes[i:i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
        return nodes[0]
    listing = FS.scan_files(spark, root)
    got = {r["path"].rsplit("/", 1)[1]: r["hash"] for r in FS.tree_fingerprints(listing, root, 64, 3).collect()}
    assert got == {n: tree(d, 64, 3) for n, d in contents.items()}
    whole = {r["path"].rsplit("/", 1)[1]: r["hash"] for r in FS.tree_fingerprints(listing, root).collect()}
    assert whole == {n: hashlib.sha256(d).hexdigest() for n, d in contents.items()}
    assert FS.tree_fingerprints(listing.filter("length < 0"), root).count() == 0


def test_registered_hashes_by_library(spark, sf_small):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = catalog.queries()["fingerprint_sha3"](spark, sf_small).collect()
    assert {r["doc_id"]: r["hash"] for r in got} == {i: hashlib.sha3_256(t).hexdigest() for i, t in texts.items()}
    for r in catalog.queries()["fingerprint_xxh"](spark, sf_small).collect():
        row = r.asDict()
        t = texts[row.pop("doc_id")]
        assert row == {name: getattr(xxhash, name)(t).hexdigest() for name in row} and len(row) == 5


def brute_summary(text, n):
    parts = [s.strip(" ") for s in re.findall(T.SENTENCE_PATTERN, text)]
    sents = [collections.Counter(re.findall(T.TOKEN_PATTERN, s.lower())) for s in parts]
    tf = sum(sents, collections.Counter())
    w = {t: c * SM.WEIGHT // tf.total() for t, c in tf.items()}
    left, picks = {i for i, s in enumerate(sents) if s}, []
    while left and len(picks) < n:
        top = min({t for i in left for t in sents[i]}, key=lambda t: (-w[t], t.encode()))
        best = min((i for i in left if top in sents[i]),
                   key=lambda i: (-(sum(w[t] * c for t, c in sents[i].items()) * 1000 // sents[i].total()), i))
        left.remove(best)
        picks.append(best)
        for t in sents[best]:
            w[t] = w[t] * w[t] // SM.WEIGHT
    return " ".join(parts[i] for i in sorted(picks))


def test_reweighted_summaries_by_brute_force(spark):
    texts = ["The cat sat. The cat sat again. A dog ran far away. Birds sing songs. The cat sat.", "", "...", "One only",
             "alpha beta alpha. beta gamma. alpha alpha alpha! delta? gamma gamma beta. omega omega omega omega."]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "unit int, text string")
    got = {r["unit"]: r["summary"] for r in SM.summarize_reweighted(df, "unit", n=2).collect()}
    assert all(got.get(i, "") == brute_summary(t, 2) for i, t in enumerate(texts))
    assert got[0].count("The cat sat") <= 1 and 9 not in got


HOUR = 3_600_000


def test_reweighted_summaries_within_tasks_equal_those_by_rounds(spark):
    """documents need no rounds of joins; repeated and null ids, batches that end within a unit."""
    import random

    rnd = random.Random(4)
    words = ["a", "B", "c", "ünd", "z9", "the", "the", "the", "x"]
    text = lambda: "".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) + rnd.choice([". ", "\n", ".. "]) for _ in range(rnd.randint(0, 9)))
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, "", "  . !", *(text() for _ in range(12))])) for _ in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for n in (0, 1, 3):
            rounds, within = (sorted(map(tuple, SM.summarize_reweighted(df, "doc_id", n=n, colocate=c).collect()), key=str) for c in (False, True))
            assert rounds == within and len(within) > 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    within = SM.summarize_reweighted(df, "doc_id", n=3, colocate=True)
    assert "Join" not in within._jdf.queryExecution().optimizedPlan().toString()


def test_readiness_expires_refuses_and_restarts(spark):
    d, out, ckpt = tempfile.mkdtemp(prefix="cairn-ready-"), fresh_path(spark, "ready"), fresh_path(spark, "ready_ckpt")
    batches = [[("a", "created", 1), ("b", "created", 1), ("c", "done", 2), ("d", "done", 13)],  # d: done after its deadline
               [("x", "created", 20)],  # the watermark passes noon
               [("a", "done", 19.5), ("e", "created", 25), ("c", "delta", 19.5), ("f", "created", 26)],  # a: refused
               [("y", "created", 60)]]

    def land(i):
        rows = [(k, p, int(h * HOUR)) for k, p, h in batches[i]]
        df = spark.createDataFrame(rows, "call_id string, phase string, ms bigint").select("call_id", "phase", F.timestamp_millis("ms").alias("ts"))
        df.toPandas().to_parquet(f"{d}/events_{i}.parquet", coerce_timestamps="us")
        os.utime(f"{d}/events_{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))

    def run():
        events = RN.table_stream(spark, d, "events", max_files_per_trigger=1).withColumn("ts", F.col("ts").cast("timestamp"))
        stream = RD.readiness_stream(events, "call_id", F.date_trunc("day", "ts"), 12 * HOUR, 24 * HOUR, "1 hour")
        with RD.rocksdb_state(spark):
            RN.run_to_files(stream, out, ckpt)
        rows = spark.read.schema(RD.OUT).parquet(out)
        return rows, {r["key"]: (r["status"], r["at_ms"] / HOUR) for r in RD.latest_status(rows).collect()}

    land(0)
    land(1)
    _, got = run()
    assert got == {"a": ("expired", 12), "b": ("expired", 12), "c": ("completed", 2), "d": ("expired", 12), "x": ("expired", 12)}
    land(2)  # after a restart from the checkpoint
    _, got = run()
    assert got["a"] == ("expired", 12) and got["c"] == ("completed", 2) and got["f"] == ("in_progress", 24)
    land(3)
    rows, got = run()
    assert got["f"] == ("expired", 36) and got["c"] == ("completed", 2)
    assert rows.groupBy("key", "status").count().filter("count > 1").count() == 0
    with pytest.raises(ValueError):
        RD.readiness_stream(rows, "key", F.col("ts"), 2, 1, "1 hour")


def test_readiness_calls_its_state_once_a_key():
    """every call on the state or a timer is a round trip, and a key made up to eight."""
    from pyspark.sql import Row

    calls = []

    class Value:
        held = None
        get = lambda self: (calls.append("get"), self.held)[1]
        clear = lambda self: calls.append("clear")

        def update(self, v):
            calls.append("update")
            self.held = v

    class Handle:
        value = Value()
        getValueState = lambda self, *a: self.value
        registerTimer = lambda self, at: calls.append(at)

    class Now:
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 12 * HOUR

    p = RD.Readiness(12 * HOUR, 24 * HOUR)
    p.init(Handle())
    rows = [Row(phase="created", at_ms=HOUR, opened_ms=0), Row(phase="done", at_ms=13 * HOUR, opened_ms=0)]
    assert [tuple(r) for r in p.handleInputRows(("k",), iter(rows), None)] == [("k", "in_progress", 0)]
    assert calls == ["get", "update", 12 * HOUR]
    assert [tuple(r) for r in p.handleExpiredTimer(("k",), Now(), Now())] == [("k", "expired", 12 * HOUR)]
    assert calls[3:] == ["get", "update", 24 * HOUR]
    assert list(p.handleInputRows(("k",), iter([Row(phase="done", at_ms=2, opened_ms=0)]), None)) == []


def test_readiness_keeps_a_bucket_of_keys_as_one_value(spark, monkeypatch):
    """every key made calls on its state and timers; a bucket makes as many, however many keys it has."""
    import pandas as pd

    calls = []

    class Value:
        held = None
        get = lambda self: (calls.append("get"), self.held)[1]

        def update(self, v):
            calls.append("update")
            self.held = v

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        value = Value()
        getValueState = lambda self, *a: self.value
        registerTimer = lambda self, at: calls.append(at)
        deleteTimer = lambda self, at: calls.append(-at)

    class At:
        def __init__(self, hour):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: int(hour * HOUR)

    def frame(*rows):
        return pd.DataFrame([(k, p, int(at * HOUR), int(opened * HOUR)) for k, p, at, opened in rows], columns=["key", "phase", "at_ms", "opened_ms"])

    def said(frames):
        return sorted((r.key, r.status, r.at_ms / HOUR) for f in frames for r in f.itertuples())

    p = RD.ReadinessOfMany(12 * HOUR, 24 * HOUR)
    p.init(Handle())
    first = [frame(("a", "created", 1, 0), ("b", "done", 5, 0), ("late", "done", 13, 0), ("gone", "done", 24, 0)), frame(("b", "done", 3, 0), ("c", None, 2, 1))]
    assert said(p.handleInputRows((0,), iter(first), None)) == [("a", "in_progress", 0), ("b", "completed", 3), ("b", "in_progress", 0), ("c", "in_progress", 1),
                                                               ("late", "in_progress", 0)]
    assert calls == ["get", 12 * HOUR, "update"]
    assert said(p.handleInputRows((0,), iter([frame(("c", "done", 4, 1), ("b", "delta", 4, 0))]), None)) == [("c", "completed", 4)]
    assert calls[3:] == ["get", "update"]
    assert said(p.handleExpiredTimer((0,), At(12.5), At(12))) == [("a", "expired", 12), ("late", "expired", 12)]
    assert calls[5:] == ["get", 24 * HOUR, "update"]
    assert said(p.handleInputRows((0,), iter([frame(("a", "done", 11, 0))]), None)) == []  # refused
    assert said(p.handleExpiredTimer((0,), At(24.5), At(24))) == [] and p._get()[0]["key"].tolist() == ["c"]
    assert said(p.handleExpiredTimer((0,), At(26), At(25))) == [] and calls[-2:] == ["get", "clear"]


def test_readiness_by_buckets_equals_readiness_by_keys(spark, monkeypatch):
    """many keys in two buckets, over batches and a watermark that passes deadlines between them."""
    import random

    monkeypatch.setattr(RD, "BUCKETS", 2)
    rnd, d = random.Random(8), tempfile.mkdtemp(prefix="cairn-ready-")
    for i in range(3):
        rows = [(rnd.choice([None, *(f"k{n}-{i + e}" for n in range(15))]), rnd.choice(["created", "delta", "done", None]), (i + e) * 24 * HOUR + rnd.randrange(24 * HOUR))
                for e in (0, 0, 1) for _ in range(25)]
        df = spark.createDataFrame(rows, "call_id string, phase string, ms bigint").select("call_id", "phase", F.timestamp_millis("ms").alias("ts"))
        df.toPandas().to_parquet(f"{d}/events_{i}.parquet", coerce_timestamps="us")
        os.utime(f"{d}/events_{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    events = RN.table_stream(spark, d, "events", max_files_per_trigger=1).withColumn("ts", F.col("ts").cast("timestamp"))
    by_bucket = RD.readiness_stream(events, "call_id", F.date_trunc("day", "ts"), 12 * HOUR, 24 * HOUR, "1 hour")
    rows = events.select(F.col("call_id").alias("key"), "phase", F.unix_millis(F.date_trunc("day", "ts")).alias("opened_ms"), F.unix_millis("ts").alias("at_ms"), "ts")
    by_key = rows.filter("key IS NOT NULL").withWatermark("ts", "1 hour").groupBy("key").transformWithState(RD.Readiness(12 * HOUR, 24 * HOUR), RD.OUT, "Append", "EventTime")
    with RD.rocksdb_state(spark):
        got, expected = (sorted(map(tuple, RN.run_to_table(x, "append", "readiness").collect())) for x in (by_bucket, by_key))
    assert got == expected and {s for _, s, _ in got} == {"in_progress", "completed", "expired"}
