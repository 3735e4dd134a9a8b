"""Distributed ordinals vs plain windows; search and summaries vs brute force."""

import math
import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions.ordinal import global_ordinal, group_ordinal, ordered_concat, top_k
from cairn.session import fresh_path
from cairn.operators import block_index as BI
from cairn.operators import retrieval as RV
from cairn.operators import summarize as SM


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-50, 50)), min_size=1, max_size=60))
def test_global_and_group_ordinal(spark, rows):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g int, v int, i int")
    got = {r["i"]: r["o"] for r in global_ordinal(df, ["v", "i"], "o").collect()}
    exp = {r["i"]: r["o"] for r in df.select("i", F.row_number().over(Window.orderBy("v", "i")).alias("o")).collect()}
    assert got == exp
    got_g = {r["i"]: r["o"] for r in group_ordinal(df, ["g"], ["v", "i"], "o").collect()}
    exp_g = {r["i"]: r["o"] for r in df.select(
        "i", F.row_number().over(Window.partitionBy("g").orderBy("v", "i")).alias("o")).collect()}
    assert got_g == exp_g


def test_ordered_concat_and_top_k(spark):
    rows = [(1, p, f"w{p}") for p in range(600)] + [(2, 5, "b"), (2, 1, "a")]
    df = spark.createDataFrame(rows, "g int, p int, t string")
    out = {r["g"]: r["text"] for r in ordered_concat(df, ["g"], "p", "t", ",", "text", run=64).collect()}
    assert out[1] == ",".join(f"w{p}" for p in range(600)) and out[2] == "a,b"
    tk = top_k(df, ["g"], [F.col("p").desc()], 2).collect()
    assert sorted((r["g"], r["p"]) for r in tk) == [(1, 598), (1, 599), (2, 1), (2, 5)]


def _brute_bm25(docs, questions, size, overlap, k):
    import re
    tok = lambda s: re.findall(r"[^\W_]+", s.lower())  # letters/digits, like [\p{L}0-9]+ on this data
    chunks = []
    for d, text in docs:
        t = tok(text)
        stride = size - overlap
        n = 0 if not t else (1 if len(t) <= size else math.ceil((len(t) - size) / stride) + 1)
        for c in range(n):
            chunks.append(((d, c), t[c * stride:c * stride + size]))
    N = len(chunks)
    avgdl = sum(len(t) for _, t in chunks) / N
    df = {}
    for _, t in chunks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in questions:
        terms = set(tok(text))
        scores = []
        for key, t in chunks:
            s = 0.0
            for w in terms & set(t):
                tf = t.count(w)
                idf = math.log(1 + (N - df[w] + 0.5) / (df[w] + 0.5))
                s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
            if s > 0:
                scores.append((round(s, 6), key))
        scores.sort(key=lambda x: (-x[0], x[1]))
        out[q] = [key for _, key in scores[:k]]
    return out


def test_bm25_pruned_equals_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(40)] + ["the"] * 30 + ["and"] * 20
    docs = [(d, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 150)))) for d in range(60)]
    questions = [(q, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(2, 12)))) for q in range(25)]
    ddf = spark.createDataFrame(docs, "doc_id long, text string")
    qdf = spark.createDataFrame(questions, "item_id long, text string")
    chunks = RV.chunk_documents(ddf, size=16, overlap=4)
    index = BI.BlockIndex(spark, fresh_path(spark, "idx_test"))
    index.add_chunks(chunks)
    hits = BI.search(qdf, index.snapshot(), k=3)
    got = {}
    for r in hits.orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["doc_id"], r["chunk_no"]))
    exp = _brute_bm25(docs, questions, 16, 4, 3)
    assert {q: v for q, v in exp.items() if v} == got


def test_vector_topk_in_one_block_and_in_many(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(120)]
    qs = [(l, [float(x) for x in rnd.normal(size=8)]) for l in range(4)]
    vdf = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    qdf = spark.createDataFrame(qs, "label int, embedding array<double>")
    m = np.array([v for _, v in vecs])
    exp = {}
    for l, q in qs:
        sims = m @ np.array(q) / (np.linalg.norm(m, axis=1) * np.linalg.norm(q))
        order = sorted(range(len(vecs)), key=lambda i: (-round(sims[i], 6), i))[:5]
        exp[l] = order
    for budget in (RV.BLOCK_BYTES, 8 * 8 * 20):  # one block, and blocks of about 20 vectors
        monkeypatch.setattr(RV, "BLOCK_BYTES", budget)
        got = {}
        for r in RV.vector_topk(vdf, qdf, k=5).orderBy("label", "rank").collect():
            got.setdefault(r["label"], []).append(r["vec_id"])
        assert got == exp
    assert RV.vector_blocks(120, 8) == 6
    assert RV.vector_topk(vdf, qdf.limit(0), k=5).count() == RV.vector_topk(vdf.limit(0), qdf, k=5).count() == 0


def test_summary_picks_frequent_sentences(spark):
    text = "Cats purr. Dogs bark loudly today! Cats and cats purr again. Birds sing?\nCats purr."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = SM.summarize(df, "doc_id", "text", None, 2).first()
    assert r["n_sentences"] == 5
    assert r["summary"] == "Cats purr. Cats purr."


def test_global_ordinal_many_partitions(spark):
    df = spark.range(20000).select((F.hash("id") % 997).alias("k"), "id")
    got = global_ordinal(df, ["k", "id"], "o", num_partitions=16)
    exp = df.select("id", F.row_number().over(Window.orderBy("k", "id")).alias("e"))
    bad = got.join(exp, "id").filter(F.col("o") != F.col("e")).count()
    assert got.count() == 20000 and bad == 0
    assert got.agg(F.min("o"), F.max("o")).first() == (1, 20000)


def test_top_k_limits_before_the_shuffle(spark):
    import contextlib
    import io
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("s"), "id")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        top_k(df, ["g"], [F.col("s").desc(), "id"], 3).explain()
    plan = buf.getvalue()
    assert "row_number(), 3, Partial" in plan
    # printed top-down: the partial limit sits below (after) the exchange, i.e. runs map-side
    assert plan.index("Exchange") < plan.index("row_number(), 3, Partial")


def test_co_located_parts_follow_the_texts_bytes(spark, monkeypatch):
    """parts sized by compressed text grew with the table, and so did a task's tokens."""
    from pyspark.sql import functions as F

    from cairn import session as SE
    monkeypatch.setattr(SE, "PART_BYTES", 1000)
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(2000)] + [(None, None), (3, "")], "doc_id long, text string")
    parts = SE.co_located(docs, "doc_id", "text").withColumn("part", F.spark_partition_id())
    sizes = [r[0] for r in parts.groupBy("part").agg(F.sum(F.length("text"))).select("sum(length(text))").collect()]
    assert len(sizes) > 150 and max(sizes) < 5000  # 200 parts were asked for
    assert parts.count() == 2002 and parts.filter("doc_id = 3").select("part").distinct().count() == 1
    assert SE.co_located(docs.limit(0), "doc_id", "text").count() == 0
