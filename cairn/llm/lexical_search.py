"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature has bits for its (term, level) pairs, where a term has level j if it
occurs at least LEVELS[j] times.  Documents of like size form a block, and a block keeps its
signatures by slice: one bitmap over its documents for every bit position.  The and of a pair's
HASHES slices marks every document that has the pair, and few others.  A level's weight is
what a document's score can gain between that level and the next, so the weighted sum
of a query's slices is an upper bound of each document's score.

A search makes two passes over the signatures.  The first takes each item's k documents of
greatest bound in every block, and of those the k greatest in all; their exact scores give the item's
threshold.  The second keeps every document whose bound reaches the threshold.  All of them are
scored exactly from their whole texts, so no document is left out that isn't provably
below the k-th.

The index doesn't depend on the items: blocks, and a lexicon of every term's document
frequency, come from one pass over the texts.  Python sees bytes only and holds one block at a time;
items are searched in groups of about ITEM_BYTES of text, whose terms and weights are
broadcast.  Pairs of item and document exist only for documents that reach a threshold.

Defined cases: a null or empty text has no term and is never found; a term counts once
an item however often it stands there; rows that share an item_id (null too) are one item with all their terms;
an item without a term that a document holds gives no row; documents that share a doc_id are ranked each by
itself; equal scores are ordered by doc_id (null first), then by length; a long text
is a block of its own if need be; an empty table gives an empty result; only
doc_id, text and item_id are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.ordinal import top_k
from cairn.llm.common import held_by_worker, materialize, partitions_for

HASHES = 3  # bits of a pair
BITS = 12  # bits of a signature for each pair of the largest document of its size, at least
CELLS = 1 << 23  # bits of a block at most, unless one document alone has more
BLOCK_DOCS = 2048  # documents of a block at most
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 1024, 4096, 1 << 16, 1 << 20])
MOST = np.append(LEVELS[1:] - 1, np.int64(1) << 31)  # occurrences of a term at its highest level, at most
LEXICON_TERMS = 100_000  # terms counted in a task before it passes counts on
MEMO_TERMS = 300_000  # terms whose hash a worker remembers
ITEM_BYTES = 128 << 10  # text of the items that are searched together, about
TERMS_AT_ONCE = 2048  # terms whose bounds are worked out at once

# Bytes of terms (digits, letters, everything beyond ASCII), with A-Z lower-cased.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = pa.schema([("term", pa.binary()), ("df", pa.int64()), ("docs", pa.int64()), ("terms", pa.int64()),
                   ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bits", pa.int64()), ("slices", pa.binary())])
_INDEX_DDL = "term binary, df bigint, docs bigint, terms bigint, doc_ids array<bigint>, sizes array<bigint>, bits bigint, slices binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """All terms of a text in UTF-8, in order."""
    return text.translate(_TERM_BYTES).split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def positions(hashes: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """(pairs x HASHES) bit positions of (term hash, level) pairs in signatures of ``bits`` bits, a power of two."""
    first = _mix(hashes + levels.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    step = _mix(first) | np.uint64(1)
    rounds = np.arange(HASHES, dtype=np.uint64)
    return ((first[:, None] + rounds * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


class _Block:
    """Signatures of one size in the making."""

    def __init__(self, bits: int):
        self.bits, self.ids, self.sizes, self.hashes, self.counts = bits, [], [], [], []

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or (len(self.ids) + 8) * self.bits > CELLS

    def row(self) -> dict:
        order = np.arange(len(self.ids))
        width = -(-len(order) // 8)
        cells = np.zeros((self.bits, width * 8), dtype=bool)
        hashes, counts = np.concatenate(self.hashes), np.concatenate(self.counts)
        docs = np.repeat(order, [len(h) for h in self.hashes])
        for level, least in enumerate(LEVELS):
            has = counts >= least
            if not has.any():
                break
            at = positions(hashes[has], np.full(has.sum(), level), self.bits)
            cells[at, docs[has][:, None]] = True
        return {"doc_ids": self.ids, "sizes": self.sizes, "bits": self.bits, "slices": np.packbits(cells, axis=1).tobytes()}


class Indexer:
    """Blocks and counts of one task's documents, as they come."""

    def __init__(self):
        self.blocks: dict[int, _Block] = {}
        self.lexicon: Counter = Counter()
        self.docs = self.terms = 0

    def add(self, doc_id, text: bytes | None) -> Iterator[dict]:
        counts = Counter(terms_of(text))
        if not counts:
            return
        memo = held_by_worker("lexical_search", dict)
        if len(memo) > MEMO_TERMS:
            memo.clear()
        hashes = []
        for term in counts:
            h = memo.get(term)
            if h is None:
                h = memo[term] = xxhash.xxh3_64_intdigest(term)
            hashes.append(h)
        times = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
        size = int(times.sum())
        self.docs, self.terms = self.docs + 1, self.terms + size
        self.lexicon.update(counts.keys())
        pairs = int(np.searchsorted(LEVELS, times, side="right").sum())
        bits = 1 << max(6, math.ceil(math.log2(BITS * pairs)))
        block = self.blocks.setdefault(bits, _Block(bits))
        block.ids.append(doc_id)
        block.sizes.append(size)
        block.hashes.append(np.array(hashes, dtype=np.uint64))
        block.counts.append(times)
        if block.full():
            yield self.blocks.pop(bits).row()
        if len(self.lexicon) > LEXICON_TERMS:
            yield from self.counted()

    def counted(self) -> Iterator[dict]:
        yield {"docs": self.docs, "terms": self.terms}
        for term, df in self.lexicon.items():
            yield {"term": term, "df": df}
        self.lexicon, self.docs, self.terms = Counter(), 0, 0

    def rest(self) -> Iterator[dict]:
        for bits in sorted(self.blocks):
            yield self.blocks[bits].row()
        self.blocks = {}
        yield from self.counted()


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    indexer, rows, held = Indexer(), [], 0

    def made(found: Iterator[dict], last: bool = False) -> Iterator[pa.RecordBatch]:
        nonlocal rows, held
        for row in found:
            rows.append(row)
            held += len(row.get("slices", b"")) + 64
            if held > CELLS // 8:
                yield pa.RecordBatch.from_pylist(rows, schema=INDEX)
                rows, held = [], 0
        if last and rows:
            yield pa.RecordBatch.from_pylist(rows, schema=INDEX)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            yield from made(indexer.add(doc_id, text.as_py()))
    yield from made(indexer.rest(), last=True)


class Signatures(NamedTuple):
    """An index: blocks(doc_ids, sizes, bits, slices), lexicon(term, df), and the corpus's N and L."""
    blocks: DataFrame
    lexicon: DataFrame
    n_docs: int
    n_terms: int


def build_signatures(docs: DataFrame) -> Signatures:
    """The index of documents (doc_id, text), written to the shared folder."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    index = materialize(texts.mapInArrow(_index_batches, _INDEX_DDL), "signatures")
    n_docs, n_terms = index.agg(F.sum("docs"), F.sum("terms")).first()
    lexicon = materialize(index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")), "lexicon")
    return Signatures(index.filter("bits IS NOT NULL").select("doc_ids", "sizes", "bits", "slices"), lexicon, n_docs or 0, n_terms or 0)


def gain(tf, m):
    """What a term of weight 1 adds to a score, in whole numbers (numbers or arrays)."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def spread(size, n_docs: int, n_terms: int):
    """A document's m for its number of terms."""
    return 50 + (50 * size * n_docs) // n_terms


class Items(NamedTuple):
    """Items searched together: their ids, and for each distinct term its hash, weight and the items that hold it."""
    ids: list
    terms: list
    hashes: np.ndarray
    weights: np.ndarray
    holders: np.ndarray  # (items x terms) of 0 and 1, a byte each
    n_docs: int
    n_terms: int

    def bounds(self, sizes: np.ndarray, bits: int, slices: bytes) -> np.ndarray:
        """(items x documents) upper bounds of the scores in one block; 0 where no term can be."""
        n = len(sizes)
        bitmaps = np.frombuffer(slices, dtype=np.uint8).reshape(bits, -1)
        m = spread(sizes, self.n_docs, self.n_terms)
        most = gain(MOST[:, None], m[None, :])
        steps = np.diff(most, axis=0, prepend=0).astype(np.float64)  # what a level adds, exact below 2^53
        total = np.zeros((len(self.ids), n))
        for first in range(0, len(self.terms), TERMS_AT_ONCE):
            part = slice(first, first + TERMS_AT_ONCE)
            hashes = self.hashes[part]
            best, live, marks = np.zeros((len(hashes), n)), np.arange(len(hashes)), None
            for level in range(len(LEVELS)):
                has = np.bitwise_and.reduce(bitmaps[positions(hashes[live], np.full(len(live), level), bits)], axis=1)
                has = has if marks is None else has & marks  # a level is reached only with the ones below it
                some = has.any(axis=1)
                live, marks = live[some], has[some]
                if not len(live):
                    break
                best[live] += np.unpackbits(marks, axis=1, count=n) * steps[level]
            total += self.holders[:, part].astype(np.float64) @ (best * self.weights[part, None])
        return total

    def scores(self, text: bytes, wanted: list[int], place: dict) -> Iterator[tuple[int, int, int]]:
        """(item, score, size) of one document for the items wanted, exact.  ``place``: each term's column."""
        found = terms_of(text)
        counts, size = Counter(found), len(found)
        m = spread(size, self.n_docs, self.n_terms) if size else 0
        column = {place[t]: int(self.weights[place[t]]) * gain(tf, m) for t, tf in counts.items() if t in place}
        if not column:
            return
        at = np.fromiter(column.keys(), dtype=np.int64, count=len(column))
        gains = np.fromiter(column.values(), dtype=np.int64, count=len(column))
        totals = self.holders[np.ix_(wanted, at)].astype(np.int64) @ gains
        for item, score in zip(wanted, totals.tolist()):
            if score > 0:
                yield item, score, size


def _grouped_items(items: DataFrame, index: Signatures) -> Iterator[Items]:
    """The items with their terms' weights, about ITEM_BYTES of text at a time."""
    rows = items.select("item_id", F.col("text").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = partitions_for(total, ITEM_BYTES)
    words = rows.filter("text IS NOT NULL").withColumn("_group", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    for group in range(groups):
        held: dict = {}
        for item_id, text in words.filter(F.col("_group") == group).select("item_id", "text").collect():
            held.setdefault(item_id, set()).update(terms_of(bytes(text)))
        vocabulary = sorted(set().union(*held.values()))
        if not vocabulary:
            continue
        spark = items.sparkSession
        asked = spark.createDataFrame([(bytearray(t),) for t in vocabulary], "term binary")
        df = {bytes(t): n for t, n in index.lexicon.join(F.broadcast(asked), "term").select("term", "df").collect()}
        terms = [t for t in vocabulary if t in df]
        if not terms:
            continue
        ids = sorted(held, key=lambda x: (x is not None, x))
        place = {t: i for i, t in enumerate(terms)}
        holders = np.zeros((len(ids), len(terms)), dtype=np.uint8)
        for i, item_id in enumerate(ids):
            holders[i, [place[t] for t in held[item_id] if t in place]] = 1
        weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[t] + 1))) for t in terms], dtype=np.float64)
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in terms], dtype=np.uint64)
        yield Items(ids, terms, hashes, weights, holders, index.n_docs, index.n_terms)


def search(items: DataFrame, docs: DataFrame, index: Signatures, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, exact."""
    kind = items.schema["item_id"].dataType.simpleString()
    spark = items.sparkSession
    found = [_search_group(group, docs, index, k, kind) for group in _grouped_items(items, index)]
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_group(group: Items, docs: DataFrame, index: Signatures, k: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(group)  # bounded by ITEM_BYTES
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's k documents of greatest bound in a task's blocks."""
        items = shared.value
        kept, held = np.full((len(items.ids), 0), None), np.zeros((len(items.ids), 0))
        for batch in batches:
            for block in batch.to_pylist():
                bounds = items.bounds(np.array(block["sizes"], dtype=np.int64), block["bits"], block["slices"])
                held = np.concatenate([held, bounds], axis=1)
                kept = np.concatenate([kept, np.broadcast_to(np.array(block["doc_ids"], dtype=object), bounds.shape)], axis=1)
                top = np.argpartition(-held, min(k, held.shape[1]) - 1, axis=1)[:, :k]
                held, kept = np.take_along_axis(held, top, axis=1), np.take_along_axis(kept, top, axis=1)
        of, at = np.nonzero(held > 0)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(kept[of, at].tolist(), pa.int64()), pa.array(held[of, at])],
                                         ["item", "doc_id", "bound"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact scores of documents for the items that ask for them."""
        items = shared.value
        place = {t: i for i, t in enumerate(items.terms)}
        for batch in batches:
            rows = [(doc_id, *s) for doc_id, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                                                                 batch.column("items").to_pylist())
                    for s in items.scores(text.as_py() or b"", wanted, place)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                              ((1, pa.int32()), (0, pa.int64()), (2, pa.int64()), (3, pa.int64()))],
                                             ["item", "doc_id", "score", "size"])

    ddl = "item int, doc_id bigint, score bigint, size bigint"
    best = top_k(index.blocks.mapInArrow(leading, "item int, doc_id bigint, bound double"), ["item"], [F.col("bound").desc(), "doc_id"], k)
    first = best.groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # at most k rows an item, so the broadcast side is bounded by the group
    early = texts.join(F.broadcast(first), texts["doc_id"].eqNullSafe(first["doc_id"])).select(texts["doc_id"], "text", "items")
    order = [F.col("score").desc(), "doc_id", "size"]
    kth = top_k(early.mapInArrow(scored, ddl), ["item"], order, k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    thresholds = np.zeros(len(group.ids))
    for item, n, score in kth.collect():  # a row an item
        thresholds[item] = score if n >= k else 0
    limits = spark.sparkContext.broadcast(thresholds)

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that aren't provably below the threshold of some item, with those items."""
        items, least = shared.value, limits.value
        for batch in batches:
            for block in batch.to_pylist():
                bounds = items.bounds(np.array(block["sizes"], dtype=np.int64), block["bits"], block["slices"])
                # a bound is a sum of whole numbers; 1 covers its rounding where it passes 2^53
                near = (bounds * (1 + 1e-12) + 1 >= np.maximum(least, 1)[:, None]) & (bounds > 0)
                of = np.flatnonzero(near.any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array([block["doc_ids"][d] for d in of], pa.int64()),
                                                  pa.array([np.flatnonzero(near[:, d]).tolist() for d in of], pa.list_(pa.int32()))],
                                                 ["doc_id", "items"])

    kept = (materialize(index.blocks.mapInArrow(reaching, "doc_id bigint, items array<int>"), "search_candidates")
            .groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))  # rows that share an id
    late = texts.join(kept, texts["doc_id"].eqNullSafe(kept["doc_id"])).select(texts["doc_id"], "text", "items")
    names = spark.createDataFrame([(i, x) for i, x in enumerate(group.ids)], f"item int, item_id {kind}")
    ranked = top_k(late.mapInArrow(scored, ddl), ["item"], order, k)
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
