"""The cache's filter, text and summaries of streams by batches, and messages with repeated paths."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions.hashing import sha256_hex
from cairn.operators import cache as C
from cairn.operators import messages as M
from cairn.operators import summarize as SM
from cairn.session import fresh_path, written
from cairn.streaming import pipelines as PL
from cairn.streaming import runner as RN
from cairn.streaming import summaries as SU


def _hashes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string").select(sha256_hex("name").alias("hash"))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_filter_holds_every_key_and_few_others(spark):
    held = _hashes(spark, [f"k{i}" for i in range(20_000)])
    blocks = C.filter_geometry(20_000, 0.01)
    table = written(C.build_filter(held.unionByName(held), blocks), "filter")
    assert table.count() <= blocks
    assert C.may_hold(held, table, blocks).filter("NOT maybe").count() == 0
    absent = _hashes(spark, [f"other{i}" for i in range(20_000)])
    assert C.may_hold(absent, table, blocks).filter("maybe").count() < 0.015 * 20_000


def test_filters_merge_to_the_filter_of_all_keys(spark):
    one, other = _hashes(spark, [f"k{i}" for i in range(500)]), _hashes(spark, [f"k{i}" for i in range(300, 900)])
    both = C.merge_filters(C.build_filter(one, 40), C.build_filter(other, 40))
    assert _rows(both) == _rows(C.build_filter(one.unionByName(other), 40))
    assert C.build_filter(one.limit(0), 40).count() == 0
    assert C.may_hold(one, C.build_filter(one.limit(0), 40), 40).filter("maybe").count() == 0


@pytest.mark.parametrize("limit", [C.FILTER_BYTES, 0])
@pytest.mark.parametrize("blocks", [1, 64])  # one block for 400 keys lets most of the absent pass
def test_filtered_ids_equal_plain_ids(spark, monkeypatch, limit, blocks):
    monkeypatch.setattr(C, "FILTER_BYTES", limit)
    rng = random.Random(3)
    names = [f"t{rng.randrange(900)}" for _ in range(2_000)] + ["hot"] * 1_000
    batch = spark.createDataFrame(list(enumerate(names)), "pos int, content string").withColumn("hash", sha256_hex("content"))
    cache = _hashes(spark, [f"t{i}" for i in range(0, 900, 3)] + ["unused"]).withColumn("file_id", F.concat(F.lit("old-"), "hash"))
    held = written(C.build_filter(cache, blocks), "filter")
    assert _rows(C.assign_file_ids_filtered(batch, cache, held, blocks)) == _rows(C.assign_file_ids(batch, cache))


def test_misses_pass_by_the_cache(spark):
    cache = _hashes(spark, [f"t{i}" for i in range(300)]).withColumn("file_id", F.lit("x"))
    blocks = C.filter_geometry(300)
    batch = _hashes(spark, [f"new{i}" for i in range(3_000)]).distinct().withColumn("first_pos", F.lit(0))
    passed = C.may_hold(batch, C.build_filter(cache, blocks), blocks).filter("maybe").count()
    assert passed < 0.02 * 3_000


def _stream_dir(spark, parts):
    """Turns in one file a batch, oldest first; returns the folder."""
    path = fresh_path(spark, "turns")
    os.makedirs(path)
    schema = "conv_id bigint, turn bigint, role string, text string"
    for i, rows in enumerate(parts):
        target = f"{path}/conversations{i}.parquet"
        spark.createDataFrame(rows, schema).toPandas().to_parquet(target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return path, spark.createDataFrame([r for p in parts for r in p], schema)


WORDS = "rain stone river light bread road house field song wind".split()


def _turns(rng, turns):
    def said():
        return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))).capitalize() + rng.choice(".!?")
                        for _ in range(rng.randint(1, 4)))
    return [(rng.choice([1, 1, 1, 2, 3]), t, rng.choice(["user", "assistant"]), said()) for t in turns]


def _parts():
    rng = random.Random(5)
    order = list(range(60))
    rng.shuffle(order)  # turns come out of order, over several batches
    parts = [_turns(rng, order[i::4]) for i in range(4)]
    parts[1] += [(4, 900, "assistant", None), (4, 901, "assistant", ""), (5, 902, "assistant", "?!")]
    parts[2] += [parts[0][0], (1, 700, "assistant", "stone " * 3_000 + ".")]  # a repeated row, a long text
    return parts


def test_stream_text_equals_batch_text(spark):
    path, turns = _stream_dir(spark, _parts())
    root, checkpoint = fresh_path(spark, "text"), fresh_path(spark, "ckpt")
    stream = RN.table_stream(spark, path, "conversations", "conv_id", "turn", "role", "text", max_files_per_trigger=1)
    for _ in range(2):  # the second run finds nothing new
        RN.run_foreach_batch(PL.response_deltas(stream), PL.deltas_batch(root), "text", checkpoint)
    said = [r for r in turns.filter("role = 'assistant'").collect()]
    want = sorted((c, "".join(r.text or "" for r in sorted((r for r in said if r.conv_id == c), key=lambda r: (r.turn, r.text or ""))),
                   sum(r.conv_id == c for r in said)) for c in {r.conv_id for r in said})
    assert _rows(PL.read_response_text(spark, root).select("conv_id", "response_text", "n_messages")) == want
    first = PL.read_response_text(spark, root, until_batch=0)
    assert first.agg(F.sum("n_messages")).first()[0] == sum(r[2] == "assistant" for r in _parts()[0])


def test_kept_summaries_equal_batch_summaries_after_every_batch(spark):
    parts = _parts()
    path, _ = _stream_dir(spark, parts)
    root, checkpoint = fresh_path(spark, "summaries"), fresh_path(spark, "ckpt")
    stream = RN.table_stream(spark, path, "conversations", "conv_id", "turn", "text", max_files_per_trigger=1)
    RN.run_foreach_batch(stream, SU.summary_batch(root), "summaries", checkpoint)
    so_far = []
    for i, part in enumerate(parts):
        so_far += part
        turns = spark.createDataFrame(so_far, "conv_id bigint, turn bigint, role string, text string")
        assert _rows(SU.read_summaries(spark, root, until_batch=i)) == _rows(SM.summarize(turns, "conv_id", "text", "turn")), i
    before = _rows(SU.read_summaries(spark, root))
    # a replayed batch writes the same
    last = spark.createDataFrame(parts[-1], "conv_id bigint, turn bigint, role string, text string")
    SU.summary_batch(root)(last, len(parts) - 1)
    assert _rows(SU.read_summaries(spark, root)) == before
    # a restarted stream goes on with what is new
    more = [(1, 950, "user", "Bread and wind and bread."), (9, 951, "user", "A new road.")]
    spark.createDataFrame(more, "conv_id bigint, turn bigint, role string, text string").toPandas().to_parquet(f"{path}/conversations9.parquet")
    RN.run_foreach_batch(stream, SU.summary_batch(root), "summaries", checkpoint)
    turns = spark.createDataFrame(so_far + more, "conv_id bigint, turn bigint, role string, text string")
    assert _rows(SU.read_summaries(spark, root)) == _rows(SM.summarize(turns, "conv_id", "text", "turn"))


def test_messages_with_repeated_and_clashing_paths(spark):
    files = [("a", "p1", "x"), ("a", "p1", "x"), ("a", "p1", "y"), ("a", "p0", "z" * 50), ("b", "p9", None), ("b", "p1", "é\n")]
    df = spark.createDataFrame(files, "store string, path string, content string")
    got = M.build_messages(df, limit=60).collect()
    by_store = {s: sorted((r.seq, r.path, r.message) for r in got if r.store == s and r.seq > 0) for s in "ab"}
    assert [(s, p) for s, p, _ in by_store["a"]] == [(1, "p1"), (2, "p1"), (3, "p1")]
    assert sorted(m for _, _, m in by_store["a"]) == ['{"path":"p1","content":"x"}'] * 2 + ['{"path":"p1","content":"y"}']
    assert [(s, p) for s, p, _ in by_store["b"]] == [(1, "p1")]
    heads = {r.store: r.message for r in got if r.seq == 0}
    assert "following 4 messages" in heads["a"] and "following 2 messages" in heads["b"]
