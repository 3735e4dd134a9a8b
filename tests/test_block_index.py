"""The block index: search by brute force, growth against a fresh build, merges, buckets, thresholds."""

import contextlib
import io
import random

import numpy as np
import pytest

from cairn.operators import block_index as BI
from cairn.operators import retrieval as RV
from cairn.plans import retrieval as PR
from cairn.session import fresh_path
from tests.test_ordinal_retrieval import _brute_bm25

SIZE, OVERLAP = 16, 4


def texts(n, seed=7, first=0):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["the"] * 30 + ["and"] * 20
    return [(first + d, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 90)))) for d in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def index_of(spark, *batches):
    index = BI.BlockIndex(spark, fresh_path(spark, "idx_test"), buckets=4)
    for rows in batches:
        index.add(frame(spark, rows), SIZE, OVERLAP)
    return index


def found(spark, index, questions, k=3):
    qdf = spark.createDataFrame(questions, "item_id long, text string")
    got = {}
    for r in BI.search(qdf, index.snapshot(), k=k).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["doc_id"], r["chunk_no"]))
    return got


def brute(docs, questions, k=3):
    return {q: v for q, v in _brute_bm25(docs, questions, SIZE, OVERLAP, k).items() if v}


QUESTIONS = [(q, t) for q, (_, t) in enumerate(texts(12, seed=3))] + [(90, "w1 w59"), (91, "nowhere"), (92, ""), (93, None)]


def asked():
    return [(q, t or "") for q, t in QUESTIONS]


@pytest.mark.parametrize("block, literal", [(2048, 2000), (8, 2000), (8, 0)])
def test_search_in_one_block_and_in_many(spark, monkeypatch, block, literal):
    monkeypatch.setattr(BI, "BLOCK", block)
    monkeypatch.setattr(BI, "RUN", 4)
    monkeypatch.setattr(BI, "SAMPLE", 2)
    monkeypatch.setattr(BI, "LITERAL_TERMS", literal)
    docs = texts(80)
    index = index_of(spark, docs)
    for k in (1, 3, 40):
        assert found(spark, index, QUESTIONS, k) == brute(docs, asked(), k)


def test_questions_in_several_groups_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(BI, "GROUP_PAIRS", 20)
    docs = texts(40)
    index = index_of(spark, docs)
    split = [(0, "w1 the"), (0, "w2 the")] + [q for q in QUESTIONS if q[0] > 2]
    assert found(spark, index, split) == brute(docs, [(0, "w1 w2 the")] + [q for q in asked() if q[0] > 2])


def test_a_grown_index_equals_a_fresh_one(spark, monkeypatch):
    monkeypatch.setattr(BI, "BLOCK", 8)
    monkeypatch.setattr(BI, "RUN", 4)
    index, now, rnd = index_of(spark), {}, random.Random(1)
    for step in range(11):
        if step in (3, 8):
            gone = rnd.sample(sorted(now), len(now) // 4) + [12345]
            index.remove(spark.createDataFrame([(i,) for i in gone], "doc_id long"), batch=f"r{step}")
            index.remove(spark.createDataFrame([(i,) for i in now], "doc_id long"), batch=f"r{step}")  # repeated: nothing
            now = {i: t for i, t in now.items() if i not in gone}
        else:
            rows = texts(12, seed=step, first=rnd.choice([0, 6 * step, 200]))
            index.add(frame(spark, rows), SIZE, OVERLAP, batch=step)
            index.add(frame(spark, texts(5, seed=99, first=900)), SIZE, OVERLAP, batch=step)  # repeated: nothing
            now.update(rows)
        index.merge()
        if step in (3, 5, 10):
            fresh = index_of(spark, sorted(now.items()))
            assert found(spark, index, QUESTIONS) == found(spark, fresh, QUESTIONS) == brute(sorted(now.items()), asked())
            stats = {tuple(r) for r in BI.term_stats(index.snapshot()).collect()}
            assert stats == {tuple(r) for r in BI.term_stats(fresh.snapshot()).collect()}
            chunks = RV.chunk_documents(frame(spark, sorted(now.items())), size=SIZE, overlap=OVERLAP)
            assert stats == {(r["term"], r["df"], r["cf"]) for r in RV.build_index(chunks)[1].collect()}
    live = index.live()
    assert len(live) <= 2 * BI.FAN and max(c["level"] for c in live) >= 1
    kept = len(live)
    before = found(spark, index, QUESTIONS)
    assert index.vacuum() == len(index.commits()) - kept and found(spark, index, QUESTIONS) == before


def test_a_batch_writes_in_proportion_to_itself(spark):
    index = index_of(spark, texts(300), texts(3, first=1000))
    big, small = index.live()
    assert small["n_chunks"] < big["n_chunks"] / 30
    rows = [spark.read.parquet(f"{c['path']}/chunks").count() for c in (big, small)]
    assert rows == [big["n_chunks"], small["n_chunks"]]


def test_unpublished_writes_are_never_read(spark):
    docs = texts(20)
    index = index_of(spark, docs)
    _, marker = index._fs(f"{index.root}/log/0000000001.json")
    fs, _ = index._fs(index.root)
    out = fs.create(marker)
    out.write(bytearray(b'{"number": 1, "pa'))  # a writer that was lost halfway
    out.close()
    assert len(index.commits()) == 1 and found(spark, index, QUESTIONS) == brute(docs, asked())
    with pytest.raises(RuntimeError):
        index._publish({"number": 0})


def test_an_empty_index(spark):
    index = BI.BlockIndex(spark, fresh_path(spark, "idx_test"))
    assert found(spark, index, QUESTIONS) == {} and BI.term_stats(index.snapshot()).count() == 0
    index.add(frame(spark, []), SIZE, OVERLAP)
    index.remove(spark.createDataFrame([(1,)], "doc_id long"))
    assert found(spark, index, QUESTIONS) == {}
    assert found(spark, index_of(spark, texts(5)), []) == {}


def test_a_search_opens_its_terms_buckets_only(spark):
    index = index_of(spark, texts(30))
    buf = io.StringIO()
    # a plan names the buckets only where it also groups by them; files of other buckets are left out either way
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        with contextlib.redirect_stdout(buf):
            BI.question_postings(index.snapshot(), ["w7"]).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in buf.getvalue()


def test_blocks_below_the_threshold_are_passed_by():
    import pandas as pd

    packed = [np.array(e, dtype=BI._ENTRY).tobytes() for e in ([(1, 1, 10), (70, 1, 10)], [(70, 3, 10)])]
    rows = pd.DataFrame({"number": [0, 1], "entries": packed, "gone": [None, None]})
    group = BI._Questions([np.array([0, 1])], np.array([1.0, 2.0]), 10.0, 1, np.zeros(1))
    best = group.in_block(rows)
    assert best["place"].tolist() == [70]
    above = group._replace(thresholds=np.array([best["score"][0] + 0.1]))
    assert len(above.in_block(rows)) == 0
    assert len(group.in_block(rows.assign(gone=[np.array([70])] * 2))) == 1  # only place 1 is left


@pytest.mark.parametrize("few", [0, 1, 10_000])
def test_scores_of_a_block_by_rows_and_by_gathered_entries(monkeypatch, few):
    monkeypatch.setattr(BI, "FEW", few)  # 0: entries always gathered; many: rows over all places first
    rnd = np.random.default_rng(5)
    n_terms, n_places = 40, 1000
    held = rnd.random((n_terms, n_places)) < np.linspace(0.002, 0.7, n_terms)[:, None]
    numbers, places = np.nonzero(held)
    weights = np.round(rnd.random(len(numbers)) * np.linspace(9, 1, n_terms)[numbers], 2)
    table = np.zeros((n_terms, n_places))
    table[numbers, places] = weights
    asked = [np.sort(rnd.choice(n_terms, size, replace=False)) for size in (1, 2, 5, 12, 30)]
    for k in (1, 3):
        for least in (0.0, 12.0):
            group = BI._Questions(asked, np.ones(n_terms), 10.0, k, np.full(len(asked), least))
            got = group.best_of(numbers, places, weights)
            for q, terms in enumerate(asked):
                scores = table[terms].sum(axis=0)
                kth = max(np.sort(scores)[-k], least)
                exp = {p for p in range(n_places) if scores[p] > 0 and scores[p] >= kth - BI.MARGIN / 2}
                rows = got[got["question"] == q]
                assert exp <= set(rows["place"]) and (rows["score"] >= kth - 2 * BI.MARGIN).all()
                assert np.allclose(rows["score"], scores[rows["place"].astype(int)])


def test_a_search_writes_its_postings_once_for_all_groups(spark, monkeypatch):
    """every group of questions wrote and shuffled the postings of its own."""
    from cairn import session

    index = index_of(spark, texts(40)).snapshot()
    wide = []

    def rows_of(pairs):
        monkeypatch.setattr(BI, "GROUP_PAIRS", pairs)
        wide.clear()
        real = session.written
        monkeypatch.setattr(BI, "written", lambda df, kind: wide.append("entries" in df.columns) or real(df, kind))
        blocks = []
        keep = BI._write_blocks
        monkeypatch.setattr(BI, "_write_blocks", lambda df: blocks.append(1) or keep(df))
        qdf = spark.createDataFrame(QUESTIONS, "item_id long, text string")
        out = sorted(map(tuple, BI.search(qdf, index).collect()))
        monkeypatch.setattr(BI, "_write_blocks", keep)
        return out, len(blocks) + sum(wide)

    one, many = rows_of(200_000), rows_of(40)
    assert one[0] == many[0] and one[1] == many[1] == 2  # the blocks and their sample


def test_gone_places_meet_each_block_once(spark):
    """they were joined to every posting row."""
    index = index_of(spark, texts(30), texts(10, seed=2))
    snapshot = index.snapshot()
    assert "gone" not in snapshot.postings.columns and snapshot.gone.count() >= 1
    blocks = BI.block_rows(snapshot.postings, snapshot.gone)
    assert blocks.count() == blocks.select("segment", "block").distinct().count()
    now = {**dict(texts(30)), **dict(texts(10, seed=2))}
    assert found(spark, index, QUESTIONS) == brute(sorted(now.items()), asked())


def test_grown_index_of_the_registered_query(spark, sf_small):
    index = PR.grown_index(spark, sf_small)
    assert index.snapshot().n_docs == PR._index(spark, sf_small).n_docs
    assert max(c["level"] for c in index.live()) == 1


def test_block_rows_lie_in_order(spark, monkeypatch):
    """every group of questions sorted the entries of each block again."""
    monkeypatch.setattr(BI, "BLOCK", 32)
    snapshot = index_of(spark, texts(60), texts(9, seed=2)).snapshot()
    rows = BI.block_rows(snapshot.postings, snapshot.gone).collect()
    assert len(rows) > 3
    for r in rows:
        entries = np.frombuffer(r["entries"], dtype=BI._ENTRY)
        assert r["terms"] == sorted(set(r["terms"])) and sum(r["ns"]) == len(entries)
        assert (np.diff(np.repeat(np.arange(len(r["ns"])), r["ns"]) * 65_536 + entries["place"]) > 0).all()


def test_a_task_reports_what_its_later_blocks_have_not_passed():
    """hits of earlier blocks were shuffled although a later one had raised the threshold."""
    import pyarrow as pa

    entries = [np.array([(0, 1, 10)], BI._ENTRY), np.array([(0, 3, 10)], BI._ENTRY), np.array([(0, 2, 10)], BI._ENTRY)]
    blocks = pa.record_batch({"segment": pa.array([0, 0, 0], pa.int32()), "block": pa.array([0, 1, 2], pa.int64()), "terms": [["a"]] * 3,
                              "ns": [[1]] * 3, "entries": pa.array([e.tobytes() for e in entries], pa.binary())})
    hits = pa.Table.from_batches(BI._Questions([np.array([0])], np.ones(1), 10.0, 1, np.zeros(1)).in_blocks(iter([blocks]), pa.array(["a"])))
    assert hits.column("block").to_pylist() == [1]


@pytest.mark.parametrize("late", [0.0, 0.9])
def test_sums_that_one_byte_does_not_hold(monkeypatch, late):
    monkeypatch.setattr(BI, "LATE", late)
    monkeypatch.setattr(BI, "RUN", 64)
    monkeypatch.setattr(BI, "FEW", 1000)
    rnd = np.random.default_rng(2)
    n_terms, n_places = 300, 640
    held = rnd.random((n_terms, n_places)) < np.linspace(0.01, 0.9, n_terms)[:, None]
    numbers, places = np.nonzero(held)
    weights = rnd.random(len(numbers)) * np.linspace(20, 0.1, n_terms)[numbers]
    table = np.zeros((n_terms, n_places))
    table[numbers, places] = weights
    asked = [np.array([0, 1]), np.arange(300), np.arange(0, 300, 7), np.array([299]), np.array([0, 5, 280, 290])]
    for k in (1, 2, 700):
        for least in (0.0, 1e-3, 0.7, 30.0):
            got = BI._Questions(asked, np.ones(n_terms), 10.0, k, np.full(len(asked), least)).best_of(numbers, places, weights)
            for q, terms in enumerate(asked):
                scores = table[terms].sum(axis=0)
                kth = max(np.sort(scores)[-min(k, n_places)], least)
                rows = got[got["question"] == q]
                assert {p for p in range(n_places) if scores[p] > 0 and scores[p] >= kth} <= set(rows["place"])
                assert np.allclose(rows["score"], scores[rows["place"].astype(int)])
