"""Quality rules, rule ensemble, mixing: brute force, exact distributions and held-out accuracy."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.llm import mixing as M
from cairn.llm import quality_rules as Q
from cairn.llm import rule_ensemble as E
from tests.llm import edge


def base_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def repetitive():
    r = random.Random(2)
    return [" ".join(r.choice("abc") for _ in range(r.randrange(60))) + r.choice(["", "\n", "\na b\na b\n \n"]) for _ in range(150)]


def test_base_counts_by_brute_force(spark):
    own = edge.rows() + [(100 + i, t, *edge.rows()[0][2:]) for i, t in enumerate(repetitive())]
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = Q.apply_rules(edge.frame(spark, own), labels).collect()
    assert sorted((str((r["doc_id"], *[r[c] for c in COUNTS])) for r in got)) == sorted(str((r[0], *base_counts(r[1]))) for r in own)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # three labels bound nothing
    assert Q.apply_rules(edge.frame(spark, []), labels).count() == 0


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.3), (10, 3, 0.3), (10, 10, 0.3), (2000, 4, 0.005), (3000, 16, 0.005), (50_000, 150, 0.004)])
def test_binomial_tail_is_exact(spark, n, k, p):
    exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
                      for i in range(k + 1))
    row = spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(k).cast("bigint").alias("k")).select(
        Q.binomial_tail(F.col("n"), F.col("k"), F.lit(p)).alias("t"),
        Q.within_limit(F.col("n"), F.col("k"), F.lit(p), F.lit(0.01)).alias("w")).first()
    assert row["t"] == pytest.approx(exact, rel=1e-6) and row["w"] == (exact <= 0.01 and k / n < p)


def labelled_stats(spark, good=6000, bad=600, noisy=0):
    """One stratum whose bad documents have many symbols, and ``noisy`` good ones that do too."""
    rows = [(i, "en", 0.5 if noisy > i else 0.0, 1) for i in range(good)] + [(good + i, "en", 0.5, 0) for i in range(bad)]
    rows += [(10 ** 6 + i, None, 0.9 if i % 2 else 0.0, i % 2 ^ 1) for i in range(40)]  # a stratum with few labels
    df = spark.createDataFrame(rows, "doc_id bigint, stratum string, x double, quality int")
    stats = df.select("doc_id", "stratum", *[(F.col("x") if r == "symbol_ratio" else F.lit(0.0)).alias(r) for r in Q.RULES])
    return stats, df.select("doc_id", "quality")


def test_cutoffs_keep_the_limit_in_every_stratum(spark):
    got = Q.cutoffs(*labelled_stats(spark)).collect()
    assert [(r["stratum"], r["rule"], r["good_rejected"], r["bad_rejected"]) for r in got] == [("en", "symbol_ratio", 0, 600)]
    # 100 of 6,000 good documents lie beyond every cutoff that would help: more than the limit allows
    assert Q.cutoffs(*labelled_stats(spark, noisy=100)).collect() == []
    # a few are admissible
    few = Q.cutoffs(*labelled_stats(spark, noisy=3)).collect()
    assert [(r["good_rejected"], r["bad_rejected"]) for r in few] == [(3, 600)]


def test_rules_reject_bad_documents_of_the_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.apply_rules(docs, labels).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(
        F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] >= 1 - Q.LIMIT and kept[0] < 0.6


def test_tree_paths_become_rules():
    tree = "\n".join(["DecisionTreeClassificationModel: depth=2", "  If (feature 0 <= 0.5)", "   If (feature 0 <= 0.25)", "    Predict: 0.0",
                      "   Else (feature 0 > 0.25)", "    Predict: 1.0", "  Else (feature 0 > 0.5)", "   Predict: 1.0"])
    a, b = E.FEATURES[0], E.FEATURES[1]
    assert E.paths(tree) == {((a, False, 0.5),), ((a, False, 0.25),), ((a, False, 0.5), (a, True, 0.25)), ((a, True, 0.5),)}
    assert b not in str(E.paths(tree))


def test_ensemble_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = E.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got["predicted"] == got["quality"]).mean() > 0.98) and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()


def test_ensemble_on_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    got = E.classify(edge.frame(spark), labels).collect()
    assert len(got) == len(edge.rows()) and all(0 <= r["score"] <= 1 for r in got)
    none = E.classify(edge.frame(spark), labels.filter("quality = 9")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert E.classify(edge.frame(spark, []), labels).count() == 0


def shared_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; what passes a cap is shared again among the others until none does."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > cap * sizes[s] or not sizes[s]]
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, None: 40}, {"z": 10}, {"é": 5, "z": 900, "A": 0, "b": 3, None: 1000}])
def test_targets_by_brute_force(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, rows bigint")
    got = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
    exp = shared_targets(sizes)
    assert set(got) == set(exp) and all(got[s] == pytest.approx(exp[s], abs=1e-6) for s in exp)


def test_hypergeometric_inverts_the_distribution(spark):
    n, marked, drawn = 60, 25, 30
    chance = [math.comb(marked, k) * math.comb(n - marked, drawn - k) / math.comb(n, drawn) for k in range(26)]
    us = [i / 200 for i in range(1, 200)]
    exp = [next(k for k in range(26) if sum(chance[:k + 1]) >= u - 1e-12) for u in us]
    rows = spark.createDataFrame([(i, u, n, marked, drawn) for i, u in enumerate(us)], "i int, u double, n bigint, k bigint, d bigint")
    got = [r["x"] for r in rows.select("i", M.hypergeometric(F.col("n"), F.col("k"), F.col("d"), F.col("u")).alias("x")).orderBy("i").collect()]
    assert got == exp


def test_the_tree_deals_quotas_exactly(spark):
    quotas = {0: 1000, 1: 3, 2: 250, 3: 0}
    df = spark.createDataFrame(list(quotas.items()), "rank int, blocks bigint")
    got = M.split_quotas(df, 4, 9).collect()
    for rank, blocks in quotas.items():
        assert sum(r["blocks"] for r in got if r["rank"] == rank) == blocks
    shards = collections.Counter()
    for r in got:
        assert r["blocks"] >= 0
        shards[r["shard"]] += r["blocks"]
    assert len(shards) == 16 and max(shards.values()) - min(shards.values()) <= 1


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = [M.draw_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "draws").toPandas() for _ in range(2)]
    a, b = [x.sort_values("doc_id").reset_index(drop=True) for x in runs]
    assert a.drop(columns="draws").equals(b.drop(columns="draws")) and a["draws"].map(str).equals(b["draws"].map(str))
    assert (a["taken"] <= 3 * a["size"]).all()
    by = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), all=("source_size", "first"))
    assert (by["size"] == by["all"]).all() and ((by["taken"] - by["target"]).abs() <= 0.01 * by["target"]).all()
    exp = shared_targets(by["size"].to_dict())
    assert all(by["target"][s] == pytest.approx(exp[s]) for s in exp)


def test_mix_on_edge_rows(spark):
    docs = edge.frame(spark)
    got = M.draw_mix(docs).collect()
    assert len(got) == len(edge.rows()) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(r["size"] for r in got) == sorted(base_counts(r[1])[0] for r in edge.rows())
    taken = M.take_mix(docs)
    assert taken.columns == docs.columns
    words = sum(base_counts(r["text"])[0] for r in taken.collect())
    assert words == sum(r["taken"] for r in got)
    assert M.draw_mix(edge.frame(spark, [])).count() == 0 and M.take_mix(edge.frame(spark, [])).count() == 0


def test_mix_meets_the_target_of_lumpy_sources(spark):
    """One document of most of a source's words: small ones fill it up, up to three times."""
    docs = [(i, "w " * 10, "en", "b") for i in range(200)] + [(1000, "w " * 10_000, "en", "b")]
    docs += [(2000 + i, "x y " * (i % 9 + 1), "en", "a") for i in range(594)] + [(3000 + i, "x y " * 5, "en", "a") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    got = M.draw_mix(df, weights=(2, 1)).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert by["target"].to_dict() == {"a": 12_000.0, "b": 6_000.0}
    assert ((by["taken"] - by["target"]).abs() <= 20).all(), by
    draws = got.set_index("doc_id")["draws"]
    assert all(len({d["epoch"] for d in v}) == len(v) for v in draws)
    again = M.draw_mix(df, weights=(2, 1)).toPandas()
    assert again.set_index("doc_id")["taken"].to_dict() == got.set_index("doc_id")["taken"].to_dict()
    assert sum(base_counts(r["text"])[0] for r in M.take_mix(df, weights=(2, 1)).collect()) == got["taken"].sum()


def test_the_mix_plans_little(spark, monkeypatch, capsys):
    """The driver plans an expression for each six levels of the tree, and two tables a round of filling up."""
    df = spark.createDataFrame([(0, 1000), (1, 3)], "rank int, blocks bigint")
    M.split_quotas(df, 12, 9).explain()
    assert capsys.readouterr().out.count("xxhash64") <= 4
    sums = M.split_quotas(df, 7, 9).groupBy("rank").agg(F.sum("blocks"), F.count_distinct("shard")).orderBy("rank").collect()
    assert list(map(tuple, sums)) == [(0, 1000, 128), (1, 3, 128)]
    docs = [(i, "w " * (1 + i % 7), "en", "b") for i in range(200)] + [(1000, "w " * 10_000, "en", "b"), (1001, "w " * 3000, "en", "b")]
    docs += [(2000 + i, "x y " * (i % 9 + 1), "en", "a") for i in range(900)]
    written, real = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, kind: written.append(kind) or real(df, kind))
    M.draw_mix(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), weights=(2, 1)).count()
    rounds = written.count("mix_turns")
    assert rounds > 1 and len(written) <= rounds + 7, written
