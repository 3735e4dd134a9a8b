"""Extractive summaries (SumBasic-style, Nenkova & Vanderwende 2005).

A sentence's score is the mean, over its tokens, of the token's frequency in
the whole unit (document or conversation): sum(tf) / n_tokens, one exact
division of integers.  The top ``n`` sentences (score desc, earlier first)
are joined in their original order.  Everything is aggregation and joins
keyed by the unit, so no unit's text is ever gathered in one place except
the n chosen sentences.  ``summarize_reweighted`` is the paper's greedy form, in which
the words of a chosen sentence count less for the next.  For bounded units (documents) the input is
co-located by unit first and the per-unit term counts are a window; the greedy form then chooses for all
units of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.ordinal import top_k
from cairn.session import co_located, written


def split_sentences(units: DataFrame, unit: str, text: str = "text", part: str | None = None) -> DataFrame:
    """(unit, s_ord, sentence) for every non-blank sentence; s_ord orders by ``part``, then by
    place in the text."""
    p = F.col(part) if part else F.lit(0)
    s = units.select(unit, p.alias("_part"), F.posexplode(T.sentences(text)).alias("_i", "_s"))
    return (s.select(unit, F.struct(F.col("_part").alias("part"), F.col("_i").alias("i")).alias("s_ord"),
                     F.trim("_s").alias("sentence"))
             .filter(F.length("sentence") > 0))


def summarize(units: DataFrame, unit: str, text: str = "text", part: str | None = None,
              n: int = 3, colocate: bool = False) -> DataFrame:
    """(unit, summary, n_sentences).

    ``colocate=True`` hash-partitions the input by unit first, so every later
    aggregation and join keyed by the unit runs without another shuffle; use it
    when a unit is one bounded row (a document), not for units that may be
    arbitrarily large (a conversation), where the default spreads work by term.
    """
    if colocate:
        units = co_located(units, unit, text)
    sents = split_sentences(units, unit, text, part)
    toks = sents.select(unit, "s_ord", F.explode(T.tokens("sentence")).alias("term"))
    if colocate:
        # bounded units, already co-located: the unit's frequency of each token is a
        # window count next to every occurrence (one local sort, no join)
        with_tf = toks.withColumn("tf", F.count(F.lit(1)).over(Window.partitionBy(unit, "term")))
    else:
        # possibly huge units: a partially aggregated count, written, so that the join
        # splits a hot (unit, term)
        tf = written(toks.groupBy(unit, "term").agg(F.count(F.lit(1)).alias("tf")), "unit_terms")
        with_tf = toks.join(tf, [unit, "term"])
    scored = (with_tf.groupBy(unit, "s_ord")
                     .agg((F.sum("tf") / F.count(F.lit(1))).alias("score")))
    return best_sentences(scored, sents, unit, n)


def best_sentences(scored: DataFrame, sents: DataFrame, unit: str, n: int) -> DataFrame:
    """(unit, summary, n_sentences) of scored (unit, s_ord, score) and all sentences (unit, s_ord, sentence)."""
    best = top_k(scored, [unit], [F.col("score").desc(), F.col("s_ord")], n)
    chosen = best.join(sents, [unit, "s_ord"])
    # a unit without any token keeps a row, with an empty summary
    summary = chosen.groupBy(unit).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_ord", "sentence"))),
                                 lambda x: x["sentence"]), " ").alias("summary"))
    counts = sents.groupBy(unit).agg(F.count(F.lit(1)).alias("n_sentences"))
    return counts.join(summary, unit, "left").select(
        unit, F.coalesce("summary", F.lit("")).alias("summary"), "n_sentences")


WEIGHT = 1_000_000  # a word's probability 1 as an integer weight


class _Greedy(NamedTuple):
    """The greedy choice for the sentences (unit, i, sentence, terms) of whole units, many at once."""
    n: int

    def picks(self, unit: np.ndarray, i: np.ndarray, terms: pa.ListArray) -> np.ndarray:
        """Which rows are chosen; ``unit`` ascends.  Rows that share a unit and ``i`` are one sentence."""
        if not len(unit):
            return np.zeros(0, bool)
        width = int(i.max()) + 1
        key, sentence_of = np.unique(unit * width + i, return_inverse=True)
        unit_of = key // width
        chosen = np.zeros(len(key), bool)
        coded = terms.flatten().dictionary_encode()
        if len(coded):
            rank = np.empty(len(coded.dictionary), np.int64)  # ties between terms go by their order
            rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
            sizes = np.diff(terms.offsets.to_numpy())
            held, count = np.unique(np.repeat(sentence_of, sizes) * len(rank) + rank[coded.indices.to_numpy()], return_counts=True)
            sentence, term = held // len(rank), held % len(rank)
            of_unit, word = np.unique(unit_of[sentence] * len(rank) + term, return_inverse=True)
            total = np.bincount(unit_of[sentence], count).astype(np.int64)
            weight = np.bincount(word, count).astype(np.int64) * WEIGHT // total[of_unit // len(rank)]
            for _ in range(self.n):
                left = np.flatnonzero(~chosen[sentence])
                if not len(left):
                    break
                s, t, c, w = sentence[left], term[left], count[left], weight[word[left]]
                units, at = np.unique(unit_of[s], return_index=True)
                each = np.diff(np.append(at, len(left)))
                heaviest = w == np.repeat(np.maximum.reduceat(w, at), each)
                top = heaviest & (t == np.repeat(np.minimum.reduceat(np.where(heaviest, t, len(rank)), at), each))
                ids, at = np.unique(s, return_index=True)
                score = np.add.reduceat(w * c, at) * 1000 // np.add.reduceat(c, at)
                score = np.where(np.maximum.reduceat(top, at), score, -1)
                units, at = np.unique(unit_of[ids], return_index=True)
                best = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, at), np.diff(np.append(at, len(ids)))))
                first = np.unique(unit_of[ids[best]], return_index=True)[1]
                chosen[ids[best[first]]] = True
                said = np.unique(word[left[np.isin(s, ids[best[first]])]])
                weight[said] = weight[said] * weight[said] // WEIGHT
        return chosen[sentence_of]

    def summaries(self, rows: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        codes = rows.column(0).dictionary_encode(null_encoding="encode").combine_chunks()
        unit = codes.indices.to_numpy().astype(np.int64)
        column = lambda c: rows.column(c).chunk(0)
        picked = np.flatnonzero(self.picks(unit, column("i").to_numpy(), column("terms")))
        found: list = [[] for _ in range(len(codes.dictionary))]
        for u, at, text in zip(unit[picked], column("i").to_numpy()[picked], rows.column("sentence").take(pa.array(picked)).to_pylist()):
            found[u].append((at, text))
        known = codes.dictionary.is_valid().to_pylist()  # rows without a unit have no summary
        texts = [" ".join(t for _, t in sorted(f)) if k else "" for f, k in zip(found, known)]
        return pa.RecordBatch.from_arrays([codes.dictionary.cast(schema.field(0).type), pa.array(texts, pa.string()),
                                           pa.array(np.bincount(unit, minlength=len(found)), pa.int64())], schema=schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a unit, of rows in the order of units; the last unit of a batch may go on in the next."""
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch])
            schema = pa.schema([(rows.column_names[0], rows.schema.field(0).type), ("summary", pa.string()), ("n_sentences", pa.int64())])
            codes = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            whole = int(np.flatnonzero(codes == codes[-1])[0])
            if whole:
                yield self.summaries(rows.slice(0, whole), schema)
            kept = rows.slice(whole)
        if kept is not None:
            yield self.summaries(kept, schema)


def _reweighted_within(units: DataFrame, unit: str, text: str, n: int) -> DataFrame:
    """``summarize_reweighted`` for bounded units: each lies whole in one task, so that nothing is joined."""
    sents = split_sentences(co_located(units.select(unit, text), unit, text).sortWithinPartitions(unit), unit, text)
    rows = sents.select(unit, F.col("s_ord.i").cast("bigint").alias("i"), "sentence", T.tokens("sentence").alias("terms"))
    return rows.mapInArrow(_Greedy(n).__call__, f"`{unit}` {units.schema[unit].dataType.simpleString()}, summary string, n_sentences bigint")


def summarize_reweighted(units: DataFrame, unit: str, text: str = "text", part: str | None = None, n: int = 3,
                         colocate: bool = False) -> DataFrame:
    """(unit, summary, n_sentences) by SumBasic's greedy choice.

    A word's weight is its share of the unit's tokens.  Each of the ``n`` picks takes, among
    the sentences left that hold the heaviest word left (ties: the least word), the one of
    the greatest mean weight (ties: the earlier), then squares the weights of its words, so
    that what has been said counts less.  Weights are integers (millionths, rounded down), so
    results don't depend on the order of sums.  A pick is one round of joins and aggregates
    over all units at once; no unit's words are gathered anywhere.  Units without any token
    have an empty summary.  ``colocate=True`` makes all picks of a unit in one task instead, without rounds: use it
    when a unit is one bounded row (a document), not for units that may be arbitrarily large.
    """
    if colocate:
        if part is not None:
            raise ValueError("co-located units have one part")
        return _reweighted_within(units, unit, text, n)
    sents = written(split_sentences(units, unit, text, part), "sentences")
    held = written(sents.select(unit, "s_ord", F.explode(T.tokens("sentence")).alias("term"))
                        .groupBy(unit, "s_ord", "term").agg(F.count(F.lit(1)).alias("n")), "sentence_terms")
    tf = held.groupBy(unit, "term").agg(F.sum("n").alias("tf"))
    totals = written(held.groupBy(unit).agg(F.sum("n").alias("total")), "unit_totals")
    weights = written(tf.join(totals, unit).select(unit, "term", F.expr(f"tf * {WEIGHT} div total").alias("w")), "term_weights")
    chosen = None
    for _ in range(n):
        now = written(held.join(weights, [unit, "term"]), "weighted_terms")
        top = written(now.groupBy(unit).agg(F.min(F.struct((-F.col("w")).alias("least"), "term")).alias("t"))
                         .select(unit, F.col("t.term").alias("term"), F.lit(True).alias("top")), "top_terms")
        scored = (now.join(top, [unit, "term"], "left").groupBy(unit, "s_ord")
                     .agg(F.expr("sum(w * n) * 1000 div sum(n)").alias("score"), F.max("top").alias("top")).filter("top"))
        pick = written(top_k(scored, [unit], [F.col("score").desc(), F.col("s_ord")], 1).select(unit, "s_ord"), "picks")
        chosen = pick if chosen is None else chosen.unionByName(pick)
        said = held.join(pick, [unit, "s_ord"], "left_semi").select(unit, "term", F.lit(True).alias("said"))
        weights = written(weights.join(said, [unit, "term"], "left").select(
            unit, "term", F.when(F.col("said"), F.expr(f"w * w div {WEIGHT}")).otherwise(F.col("w")).alias("w")), "term_weights")
        held = written(held.join(pick, [unit, "s_ord"], "left_anti"), "sentence_terms")
    counts = sents.groupBy(unit).agg(F.count(F.lit(1)).alias("n_sentences"))
    if chosen is None:
        return counts.select(unit, F.lit("").alias("summary"), "n_sentences")
    summary = chosen.join(sents, [unit, "s_ord"]).groupBy(unit).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_ord", "sentence"))),
                                 lambda x: x["sentence"]), " ").alias("summary"))
    return counts.join(summary, unit, "left").select(
        unit, F.coalesce("summary", F.lit("")).alias("summary"), "n_sentences")
