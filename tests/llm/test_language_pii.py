"""Language identification and personal data against brute force; the pipeline's stages."""

import collections
import hashlib
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import language_id as L
from cairn.llm import pii as P
from tests.llm import edge


def naive_kneser_ney(words, order=L.ORDER):
    """Probability of a character after a context, by the textbook recursion over dictionaries."""
    counts = collections.Counter()
    for word, n in words.items():
        s = " " * (order - 1) + word + " "
        for i in range(order - 1, len(s)):
            counts[s[i - order + 1:i + 1]] += n
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])
    alphabet = len({g[-1] for g in counts}) + 1
    totals = {n: collections.Counter() for n in tables}
    kinds = {n: collections.Counter() for n in tables}
    discount = {}
    for n, table in tables.items():
        ones, twos = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        discount[n] = ones / (ones + 2 * twos) if ones else 0.5
        for g, c in table.items():
            totals[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(context, char, n=order):
        if n == 0:
            return 1 / alphabet
        context = context[len(context) - (n - 1):] if n > 1 else ""
        if not totals[n][context]:
            return p(context, char, n - 1)
        c = tables[n][context + char]
        return (max(c - discount[n], 0) + discount[n] * kinds[n][context] * p(context, char, n - 1)) / totals[n][context]
    return p


WORDS = {"banana": 5, "band": 2, "an": 9, "nab": 1}


def test_one_model_equals_the_textbook_recursion():
    words = WORDS
    own = collections.Counter()
    for w, n in words.items():
        s = " " * (L.ORDER - 1) + w + " "
        for i in range(L.ORDER - 1, len(s)):
            own[s[i - L.ORDER + 1:i + 1]] += n
    models = L.CharacterModels(pd.DataFrame([("xx", g, n) for g, n in own.items()], columns=["lang", "gram", "n"]))
    p = naive_kneser_ney(words)
    tested = ["banana", "ban", "dnab", "zzz", "b", "abu"]
    for w, row in zip(tested, models.log_probabilities(tested)):
        s = " " * (L.ORDER - 1) + w + " "
        assert row[0] == pytest.approx(sum(math.log(p(s[:i], s[i])) for i in range(L.ORDER - 1, len(s))), abs=1e-4)


def test_gram_counts_by_brute_force(spark):
    texts = [("xx", "Banana band, an nab!"), ("yy", "über Buch"), ("xx", "an an 12 ²"), ("xx", "")]
    exp = collections.Counter()
    for lang, t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            s = " " * (L.ORDER - 1) + w + " "
            for i in range(L.ORDER - 1, len(s)):
                exp[lang, s[i - L.ORDER + 1:i + 1]] += 1
    df = spark.createDataFrame(texts, "lang string, text string")
    assert {(r["lang"], r["gram"]): r["n"] for r in L.gram_counts(df).collect()} == exp


def training(spark):
    """60 languages; the first has letters of its own in every document, so many rare strings."""
    r = np.random.default_rng(3)
    rows = [(f"l{k:02}", " ".join("".join(map(chr, r.integers(0x4E00 + 20 * k, 0x4E14 + 20 * k, 5))) for _ in range(40))) for k in range(60)]
    rows += [("l00", " ".join("".join(map(chr, r.integers(0x6000, 0x7000, 4))) for _ in range(30))) for _ in range(20)]
    return rows, spark.createDataFrame(rows, "lang string, text string")


def test_models_of_all_languages_from_whole_counts(spark):
    rows, df = training(spark)
    models, whole = L.train(df), L.CharacterModels(L.gram_counts(df).toPandas())
    assert models.languages == whole.languages == [f"l{k:02}" for k in range(60)]
    words = [w for _, t in rows[:3] + rows[-3:] for w in L.words_of(t)] + ["zzz", "q"]
    assert np.allclose(models.log_probabilities(words), whole.log_probabilities(words), atol=1e-4)
    totals, _ = L.TextScorer(models).score([t for _, t in rows[:60]])
    assert totals.argmax(axis=1).tolist() == list(range(60))


def test_pruned_models_fit_and_sum_to_one(spark):
    rows, df = training(spark)
    whole = sum(len(t[0][2]) for t in L.train(df).tables)
    models = L.train(df, model_bytes=whole // 3 * L.GRAM_BYTES)
    kept = [len(t[0][2]) for t in models.tables]
    assert len(models.languages) == 60 and whole // 4 < sum(kept) <= whole // 3
    held = sum(a.nbytes for table in models.tables for part in table for a in part)
    assert held <= whole // 3 * L.GRAM_BYTES + 64
    # every context still sums to one, over the characters that were seen and one that wasn't
    grams = L.materialize(L.gram_counts(df), "test_grams")
    tables = L.string_counts(grams)
    alphabet = tables[1].select("gram").distinct().count() + 1
    done = L.probabilities(tables, alphabet)
    least = done[4].approxQuantile("loss", [0.5], 0.0)[0]
    pruned = L.probabilities({n: t.drop("p", "backoff", "kept") for n, t in done.items()}, alphabet, least)
    lower = pruned[1].toPandas()
    for r in lower.groupby("lang"):
        assert r[1]["p"].sum() + (alphabet - len(r[1])) * r[1]["backoff"].iloc[0] / alphabet == pytest.approx(1)
    two = pruned[2].toPandas()
    one = lower.set_index(["lang", "gram"])["p"]
    for (lang, _), own in two.groupby(["lang", two["gram"].str[:1]]):
        below = [one[lang, g[1:]] for g in own["gram"]]
        assert own["p"].sum() + own["backoff"].iloc[0] * (1 - sum(below)) == pytest.approx(1)
    assert pruned[4].filter("kept").count() < tables[4].count()
    totals, _ = L.TextScorer(models).score([t for _, t in rows[:60]])
    assert (totals.argmax(axis=1) == np.arange(60)).all()


def test_predictions_do_not_depend_on_the_bound_of_the_models(spark):
    docs = pd.concat([spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").toPandas(),
                      pd.DataFrame({"doc_id": [None, 5_000_001], "text": [None, "odd one"], "lang": [None, None]})])
    df = spark.createDataFrame(docs.astype(object).where(docs.notna(), None), "doc_id bigint, text string, lang string")
    learned = L.learn(df.filter("lang IS NOT NULL"))
    assert len(learned.groups(1)) == len(learned.languages) > 2 and len(learned.groups(1 << 40)) == 1
    one, many = ({tuple(r) for r in L.identify_languages(df, size).collect()} for size in (L.MODEL_BYTES, 1))
    assert one == many


def test_held_out_accuracy_and_no_clean_rejects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = L.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.99 and got["rejected"].mean() < 0.002
    assert got["score"].between(0, 1).all()


def test_junk_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = np.random.default_rng(0)
    junk = [(10 ** 6 + i, " ".join("".join(map(chr, r.integers(0x61, 0x7B, 9))) for _ in range(80)), None) for i in range(20)]
    all_docs = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    got = {r["doc_id"]: r["rejected"] for r in L.identify_languages(all_docs).collect()}
    assert all(got[i] for i, _, _ in junk)
    kept = L.drop_rejected(all_docs)
    assert kept.columns == all_docs.columns and kept.filter("doc_id >= 1000000").count() == 0 and kept.count() > 990


def test_a_language_left_out_is_rejected_beside_stray_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    r = np.random.default_rng(1)
    stray = [(10 ** 6 + i, "".join(map(chr, r.integers(0x4E00, 0x9000, 1500))), "en") for i in range(8)]
    out = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang"))).unionByName(spark.createDataFrame(stray, docs.schema))
    got = L.identify_languages(out).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id", "left")
    share = {x["left"]: x["share"] for x in got.filter("truth IS NOT NULL").groupBy((F.col("truth") == "fr").alias("left")).agg(
        F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert share[True] > 0.95 and share[False] < 0.002


def test_language_of_edge_rows(spark):
    got = L.identify_languages(edge.frame(spark)).collect()
    assert len(got) == len(edge.rows())
    for r in got:
        text = {x[0]: x[1] for x in edge.rows() if x[0] is not None}.get(r["doc_id"])
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
            assert r["lang_pred"] != "und" or (r["score"] == 0 and r["rejected"])
    assert L.identify_languages(edge.frame(spark, [])).count() == 0
    unlabelled = edge.documents(spark, [(1, "some words"), (3, None)], lang=None)
    assert {r["lang_pred"] for r in L.identify_languages(unlabelled).collect()} == {"und"}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    counts, out = [], []
    for kind, pattern in PATTERNS.items():
        own = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                own.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(own))
        out += own
    return counts, ",".join(out)


def personal():
    r = np.random.default_rng(5)
    alphabet = list("ab1290.@+-_% ()é\n")
    texts = ["".join(r.choice(alphabet, 80)) for _ in range(400)]
    texts += ["a@b.c%x@y.zz q@r", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111",
              "+1 (706) 555-3138 +12 +1-2 é+49.30.1234567 x", "😀 mail me: Ann.Bee@Example.ORG, ann@x", "9" * 40_000, "a" * 40_000 + "@x.y",
              " ".join(f"u{i}@h{i}.com" for i in range(1500)), "@.@ a@b a@-.- a@b..c"]
    return texts


def test_base_spans_by_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(personal())] + [(r[0], r[1]) for r in edge.rows() if r[0] is None]
    got = P.find_personal_data(edge.documents(spark, docs)).collect()
    exp = []
    for i, t in docs:
        counts, spans = brute_spans(t)
        exp.append(str((i, *counts, hashlib.sha256(spans.encode()).hexdigest(), spans)))
    # nothing is disclosing here but terms may stand beside repeated values: compare the base part
    rows = [str((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"],
                 ",".join(s for s in r["spans"].split(",") if not s.startswith("term:")))) for r in got]
    assert sorted(rows) == sorted(exp)


def test_edge_rows_have_rows_and_clean_ones_no_spans(spark):
    got = P.find_personal_data(edge.frame(spark)).collect()
    assert len(got) == len(edge.rows()) and {r["spans"] for r in got} == {""}
    assert P.find_personal_data(edge.frame(spark, [])).count() == 0


def corpus(copies=False):
    """Ann's mail stands beside a nickname that nobody else has, in two different contexts."""
    docs = [(1, "write to zorblax today at ann@example.org please"), (2, "yes zorblax reads ann@example.org every morning, Zorblax 77 says")]
    if copies:
        docs = [(1, docs[0][1]), (2, docs[0][1])]
    return docs + [(10 + i, f"write to someone today please every morning reads says yes number {i} at home") for i in range(60)]


def test_disclosing_terms_are_protected(spark):
    got = {r["doc_id"]: r["spans"] for r in P.find_personal_data(edge.documents(spark, corpus())).collect()}
    text = dict(corpus())
    cut = {i: [text[i][int(a):int(b)] for _, a, b in (s.split(":") for s in got[i].split(","))] for i in (1, 2)}
    assert cut == {1: ["ann@example.org", "zorblax"], 2: ["ann@example.org", "zorblax", "Zorblax"]}
    assert all(not s for i, s in got.items() if i >= 10)
    clean = {r["doc_id"]: r["text"] for r in P.sanitize(edge.documents(spark, corpus())).collect()}
    assert clean[1] == "write to  today at <EMAIL> please" and clean[10] == text[10]


def test_context_reaches_over_numbers_and_neighbouring_entities(spark):
    docs = [(1, "zorblax, exp 12/26, card 4111 1111 1111 1111 ok"),
            (2, "mail: a@b.cc, d@e.ff, 4111-1111-1111-1111 +1 (706) 555-3138 of zorblax in 2024"),
            (3, "one two three four five six seven eight nine x@y.zz 1 2 3 4 5 6 7 8 9"), (4, "no entity \ue000 here")]
    got = {r["doc_id"]: {e["entity"]: e["terms"] for e in r["entities"]} for r in P.base_spans(edge.documents(spark, docs)).collect()}
    assert got[1] == {"card:4111111111111111": ["zorblax", "exp", "12", "26", "card", "ok"]}
    assert got[2] == dict.fromkeys(["email:a@b.cc", "email:d@e.ff", "card:4111111111111111", "phone:17065553138"],
                                   ["mail", "of", "zorblax", "in", "2024"])
    assert got[3] == {"email:x@y.zz": "two three four five six seven eight nine 1 2 3 4 5 6 7 8".split()}
    assert got[4] == {}
    rows = P.find_personal_data(edge.documents(spark, docs[:2] + corpus()[2:])).collect()
    spans = {r["doc_id"]: [dict(docs)[r["doc_id"]][int(a):int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",")) if k == "term"]
             for r in rows if r["doc_id"] < 3}
    assert "zorblax" in spans[1] and "zorblax" in spans[2]


def test_copies_are_one_context(spark):
    got = {r["doc_id"]: r["spans"] for r in P.find_personal_data(edge.documents(spark, corpus(copies=True))).collect()}
    assert "term" not in got[1] + got[2]


def test_common_terms_disclose_nothing(spark):
    rows = P.disclosing_terms(d := edge.documents(spark, corpus()), P.base_spans(d)).collect()
    assert {r["term"] for r in rows} == {"zorblax"} and all(P.THRESHOLD <= r["disclosure"] <= 1 for r in rows)


def test_pipeline_stages(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, ids = rows.columns, {r["doc_id"] for r in rows.select("doc_id").collect()}
    from cairn.session import fresh_path
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, f"test_{name}")
        stage(spark, rows, sf_small).write.parquet(path)
        rows = spark.read.parquet(path)
        sizes.append(rows.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == columns
        assert {r["doc_id"] for r in rows.select("doc_id").collect()} <= ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe_encode"]
    assert sizes[0] == 200 and sizes[1] == 189 and sizes[2] <= sizes[1] and sizes[4] == sizes[3]
    assert "ids_sha256" in rows.columns


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_edge_and_empty_tables(spark, sf_small, stage):
    name, run = stage
    docs = edge.frame(spark)
    out = run(spark, docs, sf_small)
    assert out.count() >= 0 and (name == "bpe_encode" or out.columns == docs.columns)
    assert run(spark, edge.frame(spark, []), sf_small).count() == 0
