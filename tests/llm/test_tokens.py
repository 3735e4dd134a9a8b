"""Token operators against the tokenizers library."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairn.llm import bpe_automaton as B
from cairn.llm import record_files as R
from cairn.llm import token_counts as C
from cairn.llm.pieces import PieceEncoder
from cairn.session import fresh_path
from tests.llm import edge

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    r = random.Random(1)
    out = ["aaaa aaaaaaa aaaaaaaaaaaa", "Hello wörld,  it's 12345 <|endoftext|> DON'T x<|startoftext|>y  ok </w> x</w>", "", None,
           "\xa0 　a\x1cb İ ΑΣ ß é é ́", "😀😀 日本語テキスト 12３ ²¼", "a" * 5000 + " " + "ab" * 3000 + " " + "!" * 3000,
           "<|endoftext|>", "\n\n  ", "'s 't don't I'LL", "a \xa0  b \r\n c", "\t x", "x \x85y", "Ōsaka ŁÓDŹ _under_ score"]
    out += ["".join(r.choice("abcdetin .,'!é\xa0\n") for _ in range(200)) for _ in range(100)]
    return out + ["".join(r.choice("aabtheino") for _ in range(r.randint(1, 60))) for _ in range(500)]


def naive_bpe(word, merges):
    symbols = list(word)
    for u, v in merges:
        i = 0
        while i < len(symbols) - 1:
            if symbols[i] == u and symbols[i + 1] == v:
                symbols[i:i + 2] = [u + v]
            i += 1
    return symbols


@pytest.mark.parametrize("seed", range(20))
def test_automaton_equals_merging_in_order(seed):
    r = random.Random(seed)
    labels, merges = ["a", "b", "c"], []
    while len(merges) < 14:
        u, v = r.choice(labels), r.choice(labels)
        if u + v not in labels:
            merges.append((u, v))
            labels.append(u + v)
    automaton = B.TokenizationAutomaton({s: i for i, s in enumerate(labels)}, merges)
    for n in range(1, 7):
        for word in map("".join, itertools.product("abc", repeat=n)):
            assert [labels[i] for i in automaton.spell(word)] == naive_bpe(word, merges), (word, merges)


def test_two_merges_to_one_label_are_refused():
    with pytest.raises(ValueError):
        B.TokenizationAutomaton({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("aa", "a"), ("a", "aa")])


def test_automaton_tokenizer_equals_the_library():
    lib = Tokenizer.from_file(WORD)
    own = B.AutomatonTokenizer(open(WORD, encoding="utf-8").read())
    for text in odd_texts():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        n, written, decoded = own.written(text)
        assert (n, written, decoded) == (len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))
        assert own.encode(text) == ids and own.decode(ids) == decoded


def test_encode_texts_on_edge_rows(spark):
    import hashlib
    lib = Tokenizer.from_file(WORD)
    got = B.encode_texts(edge.frame(spark), WORD, with_ids=True, with_text=True).collect()
    exp = []
    for r in edge.rows():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        exp.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(text.encode()).hexdigest(), " ".join(map(str, ids)), text))
    assert sorted(map(tuple, got), key=str) == sorted(exp, key=str)
    assert B.encode_texts(edge.frame(spark, []), WORD).count() == 0


def test_pieces_equal_the_library(monkeypatch):
    import cairn.llm.pieces as P
    monkeypatch.setattr(P, "MEMO_ENTRIES", 50)  # the memo turns over
    lib = Tokenizer.from_file(BYTE)
    own = PieceEncoder(open(BYTE, encoding="utf-8").read())
    texts = odd_texts()
    for at in range(0, len(texts), 40):
        for text, ids in zip(texts[at:at + 40], own.encode(texts[at:at + 40])):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text or "", add_special_tokens=False).ids


def test_token_counts_fill_and_use_the_cache(spark, monkeypatch):
    lib = Tokenizer.from_file(BYTE)
    cache = fresh_path(spark, "token_cache_test")
    docs = edge.frame(spark)
    exp = sorted(((r[0], len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 1024)
                  for r in edge.rows()), key=str)
    assert sorted(map(tuple, C.token_counts(docs, BYTE, cache).collect()), key=str) == exp
    distinct = len({r[1] or "" for r in edge.rows()})
    assert spark.read.parquet(cache).count() == distinct
    seen = []
    real = C.count_misses
    monkeypatch.setattr(C, "count_misses", lambda d, m, s: seen.append(m.count()) or real(d, m, s))
    assert sorted(map(tuple, C.token_counts(docs, BYTE, cache).collect()), key=str) == exp
    more = docs.unionByName(edge.frame(spark, [(99, "a new text", *edge.rows()[0][2:])]))
    assert C.token_counts(more, BYTE, cache).count() == len(edge.rows()) + 1
    assert seen == [0, 1] and spark.read.parquet(cache).count() == distinct + 1
    assert C.token_counts(edge.frame(spark, []), BYTE, fresh_path(spark, "c")).count() == 0


def test_record_files_round_trip(spark):
    lib = Tokenizer.from_file(BYTE)
    docs = edge.frame(spark)
    folder = fresh_path(spark, "records_test")
    manifest = R.write_records(docs, BYTE, folder, shard_bytes=100_000)
    assert manifest.count() > 1
    plain = R.read_records(spark, manifest, folder, with_ids=True).collect()
    shuffled = R.read_records(spark, manifest, folder, with_ids=True, seed=4).collect()
    assert sorted(map(str, plain)) == sorted(map(str, shuffled)) and list(map(str, plain)) != list(map(str, shuffled))
    by_start = sorted(plain, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in by_start]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))  # null doc_ids first
    at, exp = 0, sorted(((r[0], lib.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in edge.rows()), key=str)
    for r in by_start:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert sorted(((r["doc_id"], list(r["ids"])) for r in plain), key=str) == exp
    assert R.record_digests(edge.frame(spark, []), BYTE).count() == 0


def test_damaged_records_are_found():
    data = R.frame(b"payload") + R.frame(b"")
    assert R.unframe(data) == b"payload" and R.unframe(data, 23) == b""
    for i in range(len(data)):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(R.DamagedRecord):
            R.unframe(bytes(broken))
            R.unframe(bytes(broken), 23)
