"""Exact duplicates and the Jaccard join against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from cairn.llm import exact_dedup as D
from cairn.llm import jaccard_join as J
from cairn.llm.components import connected_components
from tests.llm import edge


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(docs):
    sets = [shingle_set(t) for _, t in docs]
    links = [0] * len(docs)
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(i)
    ids = {}
    for members in groups.values():
        known = [docs[i][0] for i in members if docs[i][0] is not None]
        for i in members:
            ids[i] = min(known) if known else None
    return sorted(((docs[i][0], ids[i], links[i]) for i in range(len(docs))), key=str)


def test_filters_hold_counts_and_merge_without_loss():
    r = np.random.default_rng(0)
    for bits in (0, 3, 9):
        v = r.integers(0, 2 ** 63, 5000, dtype=np.uint64)
        if bits:
            v = (v >> np.uint64(bits)) | (np.uint64(5) << np.uint64(64 - bits))
        v = np.unique(v)
        c = r.integers(1, 4, len(v))
        c[3] = 10 ** 9
        segment = 5 if bits else 0
        a, b = D.decode_filter(D.encode_filter(v, c, bits), segment, bits)
        assert (a == v).all() and (b == c).all()
        halves = [D.decode_filter(D.encode_filter(v[s], c[s], bits), segment, bits) for s in (slice(0, 3000), slice(1000, None))]
        merged = D.merge_counts(halves)
        assert (merged[0] == v).all() and merged[1].sum() == c[:3000].sum() + c[1000:].sum()
    assert len(D.decode_filter(D.encode_filter(v[:0], c[:0], 4), 0, 4)[0]) == 0


def brute_duplicates(docs):
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[(t or "").encode().lower()].append(i)
    out = []
    for i, t in docs:
        own = groups[(t or "").encode().lower()]
        known = [x for x in own if x is not None]
        out.append((i, max(known) if known else None, len(own), hashlib.sha256((t or "").encode().lower()).hexdigest()))
    return sorted(out, key=str)


def test_exact_duplicates_on_edge_rows(spark):
    got = D.exact_duplicates(edge.frame(spark)).collect()
    docs = [(r[0], r[1]) for r in edge.rows()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute_duplicates(docs)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert D.exact_duplicates(edge.frame(spark, [])).count() == 0


def test_a_text_of_a_third_of_all_rows(spark):
    docs = [(i, "Same Text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = D.exact_duplicates(edge.documents(spark, docs)).collect()
    assert {(r["group_size"], r["keep_id"]) for r in got if r["doc_id"] % 3 == 0} == {(1000, 2997)}
    assert sum(r["kept"] for r in got) == 2001


def test_drop_exact_duplicates_keeps_columns_and_one_row_each(spark):
    docs = edge.frame(spark)
    out = D.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert out.count() == len({(r[1] or "").encode().lower() for r in edge.rows()})


def test_posterior_bounds():
    for m in (8, 40, 80):
        assert 0 < J.LEAST[m] <= 0.8 * m and J.LEAST[m] >= J.LEAST[m - 8]
    assert J.LEAST[80] >= 40  # pairs of half the similarity are dropped


def test_links_on_edge_rows(spark):
    got = J.jaccard_links(edge.frame(spark)).collect()
    docs = [(r[0], r[1]) for r in edge.rows()]
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute_links(docs)
    assert J.jaccard_links(edge.frame(spark, [])).count() == 0


def near_copies(n, words=60, seed=3):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(words)] = f"v{r.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_a_large_group_of_near_copies_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 64)  # several blocks, so that pairs meet across them
    texts = near_copies(300) + [" ".join(f"u{i}_{k}" for k in range(30)) for i in range(50)]
    docs = list(enumerate(texts))
    got = J.jaccard_links(edge.documents(spark, docs)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute_links(docs)


def test_links_on_the_small_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = J.jaccard_links(docs).collect()
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute_links(own)


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    docs = edge.documents(spark, list(enumerate(near_copies(40) + ["quite another text of more than five words"])))
    out = J.drop_near_duplicates(docs).collect()
    brute = brute_links(list(enumerate(near_copies(40) + ["quite another text of more than five words"])))
    assert sorted(r["doc_id"] for r in out) == sorted({c for _, c, _ in brute})


@pytest.mark.parametrize("edges,groups", [
    ([(i, i + 1) for i in range(40)], 1), ([(0, i) for i in range(1, 30)] + [(100, 101)], 2), ([], 0)])
def test_components(spark, edges, groups):
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r["node"]: r["label"] for r in connected_components(df).collect()}
    assert len(set(got.values())) == groups and set(got) == {x for e in edges for x in e}
    assert all(got[a] == got[b] and got[a] <= a for a, b in edges)


def test_intersections_by_either_way():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64)) for _ in range(20)]
    left, right = np.triu_indices(20, 1)
    got = J.common_counts(sets, left, right)
    assert got.tolist() == [len(set(sets[i]) & set(sets[j])) for i, j in zip(left, right)]


def test_texts_that_share_a_doc_id_are_decided_one_by_one(spark):
    base = [f"word{i}" for i in range(60)]
    near, other = " ".join(base), " ".join(base[:-1] + ["changed"])
    alone = " ".join(f"other{i}" for i in range(30))
    docs = edge.documents(spark, [(3, near), (3, other), (3, alone), (5, other + " end"), (None, near + " more"), (None, alone + " x y z q w e r t")])
    out = [(r["doc_id"], r["text"]) for r in J.drop_near_duplicates(docs).collect()]
    assert sum(t.startswith("word0 ") for _, t in out) == 1 and all(i == 3 for i, t in out if t.startswith("word0 "))
    assert (3, alone) in out and (None, alone + " x y z q w e r t") in out and len(out) == 3


def test_filter_bytes_do_not_grow_with_the_segments():
    """A task's 8,000 fingerprints, in the segments of ten million up to a hundred thousand million rows."""
    prints = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 8_000, dtype=np.uint64) * np.uint64(2))
    sizes = []
    for rows in (10**7, 10**9, 10**11):
        bits = (rows // D.SEGMENT_ROWS).bit_length()
        segments = prints >> np.uint64(64 - bits)
        total = 0
        for segment in np.unique(segments):
            own = prints[segments == segment]
            blob = D.encode_filter(own, np.ones(len(own), np.int64), bits)
            assert (D.decode_filter(blob, int(segment), bits)[0] == own).all()
            total += len(blob)
        sizes.append(total / len(prints))
    assert max(sizes) < 20, sizes
