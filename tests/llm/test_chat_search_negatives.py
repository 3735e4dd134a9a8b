"""Chat formatting, ranked search and hard negatives against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import chat_format as C
from cairn.llm import hard_negatives as H
from cairn.llm import lexical_search as L
from tests.llm import edge

# ------------------------------------------------------------------- chat

ALPHABET = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<|user|>", "<|end|>", "<|", "|>", "<", "[", "\\", "\\\\", "a", "\n", "é", "😀", ">", "s"])
TEXTS = st.lists(ALPHABET, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS, TEXTS)
def test_a_turn_comes_back_and_holds_no_control_string(role, text):
    escaped = C.CHAT.escape(text)
    assert C.CHAT.unescape(escaped) == text and not any(c in escaped for c in C.CHAT.controls)
    for first, last in ((True, True), (False, False), (True, False)):
        written = "".join(t for t, _ in C.CHAT.segments(role, text, first, last))
        assert C.CHAT.parse(written) == (role, text)


def test_templates_that_could_be_misread_are_refused():
    for bad in (dict(reserved=("<s>x",)), dict(close="a<b"), dict(reserved=("\\x",)), dict(markers={"user": "<|u|>", "assistant": "<|u|>"})):
        with pytest.raises(ValueError):
            replace(C.CHAT, **bad)
    with pytest.raises(ValueError):
        C.CHAT.parse("<|user|>no end")


TURN_SCHEMA = "conv_id bigint, turn bigint, role string, text string, place bigint, state string, part int, segments string"


def chats():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "", "ok", "</s>[INST]\\", "x" * 50]))
            for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of a long one") for t in range(1500)]  # most of all rows
    rows += [(101, 0, "user", "same"), (101, 0, "user", "same"), (101, None, "system", "no turn"), (None, 1, "user", "no id"), (None, 2, "assistant", "\\")]
    return [(*r, 7, "z", 3, "clash") for r in rows]


def expected_chats(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        state, violations, written = "start", 0, "<s>"
        for _, _, role, text, *_ in turns:
            nexts = C.CHAT.order[state]
            violations += (role or "") not in nexts
            state = nexts.get(role or "", role if role in C.CHAT.order else "start")
            marker = C.CHAT.markers.get(role)
            written += (marker if marker is not None else "<|role|>" + C.CHAT.escape(role or "") + "<|text|>") + C.CHAT.escape(text or "") + "<|end|>"
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(), len(written + "</s>"), violations, violations == 0 and state == "assistant", written + "</s>")
    return out


def test_conversations_by_brute_force(spark):
    rows = chats()
    formatted = C.format_conversations(spark.createDataFrame(rows, TURN_SCHEMA).repartition(5)).cache()
    want = expected_chats(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.conversation_digests(formatted).collect()}
    # equal turns of conversation 101 may be ordered by role and text only, which the brute force does too
    assert got == {c: w[:5] for c, w in want.items()}
    checks = {r["conv_id"]: (r["n_turns"], r["violations"], r["valid"]) for r in C.conversation_checks(formatted).collect()}
    assert checks == {c: (w[0], w[5], w[6]) for c, w in want.items()}
    whole = {}
    for r in sorted(formatted.collect(), key=lambda r: r["place"]):
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + "".join(s["text"] for s in r["segments"])
    assert whole == {c: w[7] for c, w in want.items()}
    # the long conversation lies in several partitions, and only texts of the assistant carry loss
    assert formatted.filter("conv_id = 100").select(F.shiftright("place", 33)).distinct().count() > 2
    assert {(s["loss"], r["state"] == "assistant") for r in formatted.filter("conv_id = 100").collect() for s in r["segments"][1:2]} == {(True, True), (False, False)}


def test_begin_states_compose_over_whole_partitions():
    order = C.CHAT.states()
    parts = [{"part": 0, "first": 1, "last": 2, "map": order, "state": "user"},
             {"part": 2, "first": 2, "last": 2, "map": ["user" if s == "user" else "assistant" for s in order], "state": None},
             {"part": 5, "first": 2, "last": 3, "map": order, "state": "system"}, {"part": 7, "first": 4, "last": 4, "map": order, "state": None}]
    assert C.begin_states(C.CHAT, parts) == {0: ((), "start", (2,)), 2: ((2,), "user", (2,)), 5: ((2,), "user", (4,)), 7: ((3,), "system", ())}


def test_no_conversations(spark):
    empty = C.format_conversations(spark.createDataFrame([], TURN_SCHEMA))
    assert empty.count() == 0 and C.conversation_digests(empty).count() == 0 and C.conversation_checks(empty).count() == 0


# ----------------------------------------------------------------- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return TERM.findall(lower)


def brute_search(items, docs, k):
    corpus = [(d, Counter(terms(t))) for d, t in docs]
    corpus = [(d, c) for d, c in corpus if c]
    n, total, df = len(corpus), sum(sum(c.values()) for _, c in corpus), Counter(t for _, c in corpus for t in c)
    asked, out = {}, []
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, words in asked.items():
        scored = []
        for d, c in corpus:
            size = sum(c.values())
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0, size))
        out += [(item, rank, d if there else None, -s) for rank, (s, there, d, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, items, docs, k):
    items_df = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id bigint")
    docs_df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, term string, bits bigint").repartition(3)
    return sorted(map(tuple, L.search(items_df, docs_df, L.build_signatures(docs_df), k).collect()), key=str)


def zipf_docs(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Größe", "日本", "naïve"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 80, 400]))).replace("w7 ", "W7, ")) for i in range(n)]


def test_search_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "TERMS_AT_ONCE", 7)
    docs = zipf_docs(300) + [(1000 + i, "w5 w9 w300") for i in range(40)]  # ties
    items = [(i, t) for i, (_, t) in enumerate(zipf_docs(25, seed=9))] + [(50, "w5 w300"), (51, "nothing such"), (52, None)]
    for k in (1, 10, 50, 1000):
        assert found(spark, items, docs, k) == brute_search(items, docs, k)


def test_search_leaves_out_documents_and_splits_items(spark, monkeypatch):
    docs, items = zipf_docs(400), [(i, f"w{390 - i} w{200 + i} w1") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    index = L.build_signatures(df)
    group = next(L._grouped_items(spark.createDataFrame(items, "item_id bigint, text string"), index))
    blocks = index.blocks.collect()
    exact = {(i, d): s for i, _, d, s in brute_search(items, docs, 400)}
    close = 0
    for b in blocks:
        bounds = group.bounds(np.array(b["sizes"]), b["bits"], bytes(b["slices"]))
        for i, item in enumerate(group.ids):
            for j, d in enumerate(b["doc_ids"]):
                assert bounds[i, j] >= exact.get((item, d), 0)
                close += bounds[i, j] <= 1.5 * exact.get((item, d), 0) + 1
    assert close > 0.8 * len(docs) * len(items)
    monkeypatch.setattr(L, "ITEM_BYTES", 20)
    assert len(list(L._grouped_items(spark.createDataFrame(items, "item_id bigint, text string"), index))) > 3
    assert found(spark, items, docs, 5) == brute_search(items, docs, 5)


def test_search_edge_rows(spark):
    docs = [(r[0], r[1]) for r in edge.rows()]
    items = [(1, "quick brown FOX é"), (1, "over"), (None, "two three 日本語"), (2, ""), (3, "alpha5 omega7 " * 50), (4, "xx " + "x" * 50_000)]
    assert found(spark, items, docs, 50) == brute_search(items, docs, 50)
    assert found(spark, [], docs, 5) == [] and found(spark, items, [], 5) == [] and found(spark, items, [(1, None), (2, " ")], 5) == []


def test_small_blocks_and_lexicons(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_DOCS", 3)
    monkeypatch.setattr(L, "LEXICON_TERMS", 5)
    indexer = L.Indexer()
    rows = [r for d, t in zipf_docs(50) for r in indexer.add(d, t.encode())] + list(indexer.rest())
    docs = [d for r in rows if "slices" in r for d in r["doc_ids"]]
    assert sorted(docs) == list(range(50)) and max(len(r["doc_ids"]) for r in rows if "slices" in r) == 3
    df = Counter()
    for r in rows:
        if "term" in r:
            df[r["term"].decode()] += r["df"]
    assert df == Counter(t for _, text in zipf_docs(50) for t in set(terms(text)))
    assert sum(r.get("docs", 0) for r in rows) == 50 and sum(r.get("terms", 0) for r in rows) == sum(len(terms(t)) for _, t in zipf_docs(50))


# -------------------------------------------------------------- negatives

VECTOR_SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, segment int"


def brute_negatives(rows, every):
    usable = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) or abs(c) > 4096 for c in x):
            continue
        key = (label, [math.floor(256 * float(np.float32(c))) for c in x])
        usable[i] = min(usable.get(i, key), key)
    def dot(a, b):
        return sum(p * q for p, q in zip(a, b))
    out = []
    for a, (label, v) in usable.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, other) for i, (other, w) in usable.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            ok = [(-t, i) for t, i, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(ok, 1)]
    return sorted(out)


def mined(spark, rows, every):
    df = spark.createDataFrame([(i, x, label, "v", 1) for i, x, label in rows], VECTOR_SCHEMA).repartition(3)
    usable = H.usable_rows(df, "vec_id", "embedding", F.col("label"))
    return sorted(map(tuple, H.hard_negatives(usable, F.col("vec_id") % every == 0).collect()))


def clouds(n, dims, seed, tight=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    return [(i, [float(c) for c in (centres[i % 4] + tight * rng.normal(size=dims)) * rng.choice([0.2, 1, 3])], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("dims, tight", [(2, 0.1), (8, 0.4), (16, 2.0)])
def test_negatives_by_brute_force(spark, monkeypatch, dims, tight):
    monkeypatch.setattr(H, "STEP", 7)
    monkeypatch.setattr(H, "SEGMENT_ROWS", 100)
    monkeypatch.setattr(H, "CLUSTER_ROWS", 5)
    rows = clouds(350, dims, dims, tight)
    assert mined(spark, rows, 7) == brute_negatives(rows, 7)


def test_negatives_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 1000)
    rows = clouds(160, 4, 1)
    assert mined(spark, rows, 5) == brute_negatives(rows, 5)


def test_negative_edge_rows(spark):
    same = [(1000 + i, [1.0, 0.5], i % 2) for i in range(60)]  # ties
    odd = [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (5, [1e9, 0.0], 1), (None, [1.0, 1.0], 0),
           (6, [], 0), (7, [0.5], 1), (8, [0.0, 0.0], 0), (10, [0.0, 0.0], 1), (20, [-1.0, -1.0], 1), (30, [4096.0, -4096.0], 0), (1000, [2.0, 2.0], 1),
           (9, [1.0, 1.0], None), (40, [0.004, 0.0], 2), (50, [0.9, 0.55, 0.1], 0)]
    rows = same + odd
    assert mined(spark, rows, 10) == brute_negatives(rows, 10)
    assert mined(spark, [], 10) == [] and mined(spark, odd[:5], 10) == []


def test_a_certified_walk_ends_early():
    rng = np.random.default_rng(2)
    matrix = np.floor(256 * rng.normal(size=(4000, 3)) * rng.choice([0.1, 1.0, 4.0], size=(4000, 1)))
    members = np.floor(256 * (np.array([[1.0, 0, 0]]) + 0.02 * rng.normal(size=(20, 3))))
    walk = H.Walk(np.arange(4000), np.zeros(4000, dtype=int), matrix, 5, True)
    centre = H.fit_centres(members, 1)[0]
    ends = np.full((20, 1), H.NONE + 1), np.full((20, 1), np.iinfo(np.int64).max)
    ids, scores = walk.best(np.full(20, -1), np.zeros(20, dtype=int), members, centre, *ends)
    exact = (members @ matrix.T).astype(np.int64)
    for i in range(20):
        assert ids[i, 0].tolist() == sorted(range(4000), key=lambda r: (-exact[i, r], r))[:5]
    assert walk.walked < 0.3 * 20 * 4000
