"""Contexts, disclosure and sanitised texts against brute force, and texts with very many spans."""

import math
import random
import time

import regex
from pyspark.sql import functions as F

from cairn.llm import pii as P
from tests.llm import edge
from tests.llm.test_language_pii import brute_spans

WORDS = ["john", "Ann", "mail", "é", "x1", "order", "_", "-", "call", "12", "999", "\n", "a", "b.c"]
ENTITIES = ["ann@example.org", "bob@b.co", "+1 (706) 555-3138", "10.0.0.1", "4111 1111 1111 1111", "+49 30 1234567", "4111-1111-1111-1111"]


def texts(n, seed=4):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 40)):
            parts.append(rnd.choice(ENTITIES) if rnd.random() < 0.2 else rnd.choice(WORDS))
        out.append(rnd.choice(["", " "]).join(parts) if rnd.random() < 0.3 else " ".join(parts))
    return out + ["x" + "4111111111111111" + "y", "a@b.cd,e@f.gh", "+14111111111111111 z", "😀 a@b.cd 😀", "w " * 300 + "a@b.cd" + " v" * 300]


def spans_of(text):
    out = []
    for part in filter(None, brute_spans(text)[1].split(",")):
        kind, start, end = part.split(":")
        value = text[int(start):int(end)]
        out.append((int(start), int(end), f"{kind}:" + (value.lower() if kind in ("email", "ip") else regex.sub("[^0-9]", "", value))))
    return sorted(out)


def contexts_of(text):
    """[(entity, distinct terms around it)] by walking the text."""
    found, places, masked, end = spans_of(text), [], "", 0
    n = -1
    for start, stop, entity in found:
        if start >= end:
            masked, n = masked + text[end:start] + f" {P.MARK} ", n + 1
        end = max(end, stop)
        places.append((n, entity))
    tokens = regex.findall(rf"{P.MARK}|[\p{{L}}\p{{N}}]+", (masked + text[end:]).lower())
    marks = [i for i, t in enumerate(tokens) if t == P.MARK]
    out = []
    for place, entity in places:
        at = marks[place]
        before = [t for t in tokens[:at] if t != P.MARK][-P.CONTEXT:]
        after = [t for t in tokens[at:] if t != P.MARK][:P.CONTEXT]
        out.append((entity, tuple(dict.fromkeys(before + after))))
    return out


def test_contexts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 7)
    monkeypatch.setattr(P, "RUN", 3)
    rows = list(enumerate(texts(250)))
    got = {r["doc_id"]: [(e["entity"], tuple(e["terms"])) for e in r["entities"]] for r in P.base_spans(edge.documents(spark, rows)).collect()}
    assert got == {i: contexts_of(t) for i, t in rows}


def test_disclosure_by_brute_force(spark):
    rows = list(enumerate(texts(300, seed=8)))
    docs = edge.documents(spark, rows)
    got = {(r["entity"], r["term"]): r["disclosure"] for r in P.disclosing_terms(docs, P.materialize(P.base_spans(docs), "spans"), threshold=-math.inf).collect()}
    held, seen, have = {}, {}, {}
    for i, text in rows:
        for t in set(regex.findall(r"[\p{L}\p{N}]+", text.lower())):
            have[t] = have.get(t, 0) + 1
        for entity, terms in contexts_of(text):
            held.setdefault(entity, set()).add(i)
            for t in terms:
                seen.setdefault((entity, t), {}).setdefault(i, []).append(terms)
    # a document counts one of its contexts of an entity and term, so a brute force needs documents with one each
    checked = 0
    for key, by_doc in seen.items():
        if any(len(set(c)) > 1 for c in by_doc.values()):
            continue
        contexts = {c[0] for c in by_doc.values()}
        assert (key in got) == (len(contexts) >= P.CONTEXTS and math.log2(len(rows) / len(held[key[0]])) > 0)
        if key in got:
            pmi = math.log2(len(rows) * len(by_doc) / (have[key[1]] * len(held[key[0]])))
            assert abs(got[key] - min(1.0, pmi / math.log2(len(rows) / len(held[key[0]])))) < 1e-9
            checked += 1
    assert checked > 20


def test_sanitised_texts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 5)
    monkeypatch.setattr(P, "RUN", 3)
    rows = list(enumerate(texts(120, seed=2)))
    docs = edge.documents(spark, rows)
    spans = {r["doc_id"]: r for r in P.find_personal_data(docs).collect()}
    got = {r["doc_id"]: r["text"] for r in P.sanitize(docs).collect()}
    for i, text in rows:
        strength = {(t["start"]): t["disclosure"] for t in spans[i]["terms"] or []}
        cuts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in filter(None, spans[i]["spans"].split(","))))
        out, end = "", 0
        for a, b, kind in cuts:
            if a >= end:
                value = text[a:b]
                shape = "<NUMBER>" if regex.fullmatch(r"\p{N}+", value) else "<NAME>" if regex.match(r"\p{Lu}", value) else "<WORD>"
                out += text[end:a] + (f"<{kind.upper()}>" if kind != "term" else "" if strength[a] >= P.REMOVE else shape)
            end = max(end, b)
        assert got[i] == out + text[end:]


def test_work_grows_with_the_spans(spark):
    def seconds(n):
        text = " ".join(f"user{i}@host{i}.example.com since {i}" for i in range(n))
        began = time.perf_counter()
        row = P.base_spans(edge.documents(spark, [(1, text)])).select("n_email", F.size("entities").alias("n"), F.col("entities")[n - 1]["terms"].alias("last")).first()
        assert row["n_email"] == row["n"] == n and str(n - 1) in row["last"]
        return time.perf_counter() - began

    seconds(1000)
    small = min(seconds(10_000) for _ in range(2))
    assert min(seconds(20_000) for _ in range(2)) < 2.5 * small
