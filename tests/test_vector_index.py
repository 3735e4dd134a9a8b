"""The approximate vector index: recall by brute force, coverage of all rows, calibration, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import retrieval as RV
from cairn.operators import vector_index as VI
from cairn.plans import retrieval as PR


def clouds(n, dims, seed, groups=20, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    m = centres[rng.integers(0, groups, size=n)] + spread * rng.normal(size=(n, dims))
    return m * rng.uniform(0.2, 5, size=(n, 1))


def frames(spark, m, first=0):
    rows = [(first + i, [float(x) for x in v], "clash") for i, v in enumerate(m)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, code string").repartition(4)
    queries = spark.createDataFrame([(i, v) for i, v, _ in rows if i % 20 == 0], "query_id bigint, embedding array<float>")
    return vectors, queries


@pytest.mark.parametrize("spread", [0.2, 3.0])  # lists that hold neighbours together, and lists that hardly do
def test_recall_and_exact_scores(spark, monkeypatch, spread):
    monkeypatch.setattr(VI, "LIST_ROWS", 50)
    vectors, queries = frames(spark, clouds(3000, 16, 3, spread=spread))
    index = VI.build_vector_index(vectors)
    exact = RV.vector_topk(vectors, queries, k=10, qid="query_id")
    found = VI.search_vectors(index, queries, k=10, qid="query_id")
    per_query = VI.recall(found, exact, "query_id").collect()
    assert len(per_query) == 150 and {r["n_exact"] for r in per_query} == {10}
    assert np.mean([r["recall"] for r in per_query]) >= 0.93
    assert (index.probes < 20) == (spread < 1)
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in exact.collect()}
    hits = found.collect()
    assert all(scores.get((r["query_id"], r["vec_id"]), r["score"]) == r["score"] for r in hits)
    for q in {r["query_id"] for r in hits}:
        own = sorted((r for r in hits if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_every_row_is_in_one_list_and_a_hot_list_in_many_partitions(spark, uncoalesced):
    m = clouds(2000, 8, 5)
    m[:1500] = m[0]  # most rows are one vector
    vectors, queries = frames(spark, m)
    index = VI.build_vector_index(vectors)
    codes = index.codes.select("id", "list", F.input_file_name().alias("f")).collect()
    assert sorted(r["id"] for r in codes) == list(range(2000))
    hot = max({r["list"] for r in codes}, key=lambda x: sum(r["list"] == x for r in codes))
    assert len({r["f"] for r in codes if r["list"] == hot}) > 1
    nearest = VI.search_vectors(index, queries.filter("query_id = 0"), k=3, qid="query_id").collect()
    assert [r["score"] for r in nearest] == [1.0] * 3


def test_all_lists_and_rows_give_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(VI, "LIST_ROWS", 20)
    monkeypatch.setattr(VI, "QUERY_BYTES", 500)  # several groups of queries
    vectors, queries = frames(spark, clouds(300, 6, 9))
    index = VI.build_vector_index(vectors)
    found = VI.search_vectors(index, queries, k=5, qid="query_id", probes=10_000, refine=300)
    exact = RV.vector_topk(vectors, queries, k=5, qid="query_id")
    key = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, exact.select(key).collect()))


def test_rows_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0]),
            (7, [0.9, 0.1]), (7, [0.9, 0.1]), (8, [])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    index = VI.build_vector_index(vectors)
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "label int, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in VI.search_vectors(index, queries, k=9).orderBy("rank").collect()] == [
        (1, 1.0), (7, 0.993884), (7, 0.993884), (6, 0.0)]
    assert VI.search_vectors(index, queries.limit(0)).count() == 0
    assert VI.build_vector_index(vectors.limit(0)) is None


def test_the_registered_index_finds_nine_in_ten(spark):
    got = PR.QUERIES["vector_index_recall"](spark, "/root/testdata/sf0.1").agg(F.avg("recall"), F.count(F.lit(1))).first()
    assert got[0] >= 0.9 and got[1] == 100
