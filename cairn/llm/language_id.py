"""Language identification with interpolated Kneser-Ney character models.

A text's words are its runs of letters, lower-cased; each is padded with blanks,
so every character and the word's end has a full context.  For each language the
highest order counts characters after their context; lower orders count in how
many contexts a string occurs (continuation counts); each order discounts its
counts by n1 / (n1 + 2 n2) and interpolates with the next lower one, down to
a uniform distribution (Chen and Goodman).  The models lie in sorted hash
arrays, one for each order: a hash of the string, and its log-probability in every
language; unseen strings take the next order's value times their context's
back-off weight.

Training counts every training row: tasks count words, turn them into n-gram
counts, and Spark adds these up by (language, n-gram), so a language that holds
most rows is summed before the shuffle.  Continuation counts, discounts, probabilities
and back-offs are computed in Spark from all strings of all languages.  The finished models of
as many languages as ``MODEL_BYTES`` hold are collected and broadcast at a time (one language at least), and
texts pass by one such group after the other, so results don't depend on the bound.  Only if ``train``
is given a size do the strings that add least to their language's cross-entropy go, and their mass to the
back-off of their contexts.

The language with the least cross-entropy per character wins.  Its score is the
posterior probability under a temperature chosen to minimise the log-loss of the
calibration rows.  The calibration rows also set the limit beyond which a document is
rejected, and nothing else does.  A row's deviation is its cross-entropy less its language's median;
its spread sqrt(a + b / characters) is fitted by least squares to these rows' squared deviations
(cut at their ``TRIM`` quantile), so that short texts have more room.  The limit is the ``QUANTILE`` of
deviation over spread over the rows of all languages: from a power-law tail fitted above ``TAIL``, which a
few mislabelled rows hardly move, or the greatest where the rows are too few to have that
quantile.  With fewer than ``LEAST_ROWS`` there is no limit; a language without any has the median of all.  The
calibration rows, a quarter of all, take no part in the counts.  Rows with crc32(doc_id) mod 4 of 2 are held out of both.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and rejected, and so are all if no language can be learned; ties go to the first
language by name; a null doc_id is never trained on; repeated rows each give a
row; an empty table gives an empty result; only doc_id, text and lang are read,
so other columns can't clash, and lang is only read to train.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import held_by_worker, held_out, materialize

ORDER = 4
MODEL_BYTES = 192 << 20  # of the models that are broadcast together
GRAM_BYTES = 40  # of a stored string at most: hash, offset, language and value, and as much for its context
QUANTILE = 0.999
TAIL = 0.95  # quantile from which on the tail is fitted
TRIM = 0.99
LEAST_ROWS = 20
TEMPERATURES = tuple(2.0 ** (i / 2) for i in range(21))
FLUSH_WORDS = 200_000
MEMO_WORDS = 200_000
MEMO_CELLS = 10_000_000  # words times languages
CHUNK_CELLS = 1_000_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if the text has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return []
    return LETTERS.findall(text.lower())


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded words one after the other, and where each word's end is."""
    blank = " " * (ORDER - 1)
    joined = blank + f" {blank}".join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return points, np.cumsum(lengths + ORDER) - 1


def _positions(ends: np.ndarray) -> np.ndarray:
    """Places whose character a model predicts: all but the padding before words."""
    starts = np.append(0, ends[:-1] + 1) + ORDER - 1
    counts = ends - starts + 1
    return np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def hash_strings(points: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n code points up to and with each stop."""
    h = np.full(len(stops), n, np.uint64)
    for i in range(n):
        h = (h ^ points[stops - (n - 1 - i)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def hash_grams(grams: list[str]) -> np.ndarray:
    """Hashes of strings of equal length."""
    n = len(grams[0]) if grams else 0
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return hash_strings(points, np.arange(len(grams)) * n + n - 1, n)


class CharacterModels:
    """Kneser-Ney models of several languages over shared sorted hash arrays.

    Each order has two of them, of strings and of contexts: the sorted hashes, where the
    entries of each begin, and the entries, a language and a value.  Nothing is held
    for a language that lacks a string."""

    def __init__(self, grams: pd.DataFrame):
        """``grams``: lang, gram (ORDER characters), n; one row per language and string."""
        self.languages = sorted(grams["lang"].unique())
        points = np.frombuffer("".join(grams["gram"]).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, ORDER)
        language = np.searchsorted(self.languages, grams["lang"].to_numpy(object).astype(str))
        alphabet = len(np.unique(points[:, -1])) + 1
        size = len(self.languages)
        parts: list[list[tuple]] = [[] for _ in range(ORDER + 1)]
        self.floor = np.zeros(size)
        for k in range(size):
            own, counts = points[language == k], grams["n"].to_numpy(np.float64)[language == k]
            types = {ORDER: (own, counts)}
            for n in range(ORDER - 1, 0, -1):  # in how many contexts each shorter string occurs
                longer = types[n + 1][0][:, 1:]
                _, first, times = np.unique(self._hash(longer), return_index=True, return_counts=True)
                types[n] = (longer[first], times.astype(np.float64))
            lower: dict[str, np.ndarray] = {}
            for n in range(1, ORDER + 1):
                strings, counts = types[n]
                ones, twos = (counts == 1).sum(), (counts == 2).sum()
                discount = ones / (ones + 2 * twos) if ones else 0.5
                context = self._hash(strings[:, :-1]) if n > 1 else np.zeros(len(strings), np.uint64)
                keys, inverse = np.unique(context, return_inverse=True)
                total = np.bincount(inverse, counts)
                backoff = discount * np.bincount(inverse, np.minimum(counts, 1)) / total
                below = np.full(len(strings), 1 / alphabet)
                if n > 1:
                    at = np.searchsorted(lower["keys"], self._hash(strings[:, 1:]))
                    below = lower["p"][at]
                p = np.maximum(counts - discount, 0) / total[inverse] + backoff[inverse] * below
                own_keys = self._hash(strings)
                order = np.argsort(own_keys)
                lower = {"keys": own_keys[order], "p": p[order]}
                parts[n].append((k, lower["keys"], np.log(lower["p"]), keys, np.log(backoff)))
                if n == 1:
                    self.floor[k] = np.log(backoff[0] / alphabet) if len(backoff) else -np.log(alphabet)
        self.tables = [tuple(self._index(*[np.concatenate(x) for x in zip(*[
            (np.full(len(p[at]), p[0]), p[at], p[at + 1]) for p in own], strict=True)]) for at in (1, 3)) for own in parts[1:]]

    @classmethod
    def of_tables(cls, languages: list[str], floor: np.ndarray, tables: list[tuple]) -> CharacterModels:
        """Finished models: for each order (language, hash, value) of its strings, and of its contexts."""
        models = cls.__new__(cls)
        models.languages, models.floor = languages, floor
        models.tables = [tuple(cls._index(*x) for x in table) for table in tables]
        return models

    @staticmethod
    def _hash(strings: np.ndarray) -> np.ndarray:
        n = strings.shape[1]
        return hash_strings(strings.reshape(-1), np.arange(len(strings)) * n + n - 1, n)

    @staticmethod
    def _index(language: np.ndarray, hashes: np.ndarray, values: np.ndarray) -> tuple:
        """Sorted hashes, where the entries of each begin, and the entries."""
        order = np.argsort(hashes, kind="stable")
        keys, starts = np.unique(hashes[order], return_index=True)
        return (keys, np.append(starts, len(order)).astype(np.uint32),
                language[order].astype(np.uint32), values[order].astype(np.float32))

    @staticmethod
    def _entries(table: tuple, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in wanted, language, value) of all entries of the wanted hashes."""
        keys, starts, language, values = table
        if not len(keys):
            return np.zeros(0, np.int64), language, values
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        seen = np.flatnonzero(keys[at] == wanted)
        first = starts[at[seen]].astype(np.int64)
        counts = starts[at[seen] + 1] - first
        entry = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.repeat(seen, counts), language[entry], values[entry]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each padded word in each language."""
        points, ends = _code_points(words)
        stops = _positions(ends)
        lp = np.tile(self.floor.astype(np.float32), (len(stops), 1))
        for n, (strings, contexts) in enumerate(self.tables, 1):
            if n > 1:
                at, language, weights = self._entries(contexts, hash_strings(points, stops - 1, n - 1))
                lp[at, language] += weights
            at, language, values = self._entries(strings, hash_strings(points, stops, n))
            lp[at, language] = values
        counts = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return np.add.reduceat(lp.astype(np.float64), np.cumsum(counts) - counts, axis=0)


class TextScorer:
    """Sums words' log-probabilities, with a bounded memo of words."""

    def __init__(self, models: CharacterModels):
        self.models = models
        self.place: dict[str, int] = {}
        self.values = np.zeros((0, len(models.languages)), np.float32)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability by language, characters predicted) of each text; no words: zeros."""
        split = [words_of(t) for t in texts]
        missing = list(dict.fromkeys(w for words in split for w in words if w not in self.place))
        size = len(self.models.languages)
        if len(self.place) + len(missing) > min(MEMO_WORDS, MEMO_CELLS // size):
            missing = list(dict.fromkeys(w for words in split for w in words))
            self.place, self.values = {}, self.values[:0]
        if missing:
            self.place.update(zip(missing, range(len(self.values), len(self.values) + len(missing)), strict=True))
            step = min(20_000, max(100, CHUNK_CELLS // size))
            new = [self.models.log_probabilities(missing[at:at + step]).astype(np.float32) for at in range(0, len(missing), step)]
            self.values = np.concatenate([self.values, *new])
        totals = np.zeros((len(texts), len(self.models.languages)))
        chars = np.zeros(len(texts), np.int64)
        for i, words in enumerate(split):
            if words:
                totals[i] = self.values[list(map(self.place.__getitem__, words))].sum(axis=0, dtype=np.float64)
                chars[i] = sum(map(len, words)) + len(words)
        return totals, chars


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each string of ORDER characters ends at a predicted place."""
    def flush(lang: str, words: Counter) -> pd.DataFrame:
        points, ends = _code_points(list(words))
        stops = _positions(ends)
        weights = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 1)
        _, first, inverse = np.unique(hash_strings(points, stops, ORDER), return_index=True, return_inverse=True)
        at = stops[first][:, None] - np.arange(ORDER - 1, -1, -1)
        grams = points[at].astype(np.uint32).view(f"<U{ORDER}").ravel()
        return pd.DataFrame({"lang": lang, "gram": [g.ljust(ORDER) for g in grams.tolist()],
                             "n": np.bincount(inverse, weights).astype(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_by_worker()
        held: dict[str, Counter] = {}
        for pdf in frames:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > FLUSH_WORDS:  # of all languages together
                    largest = max(held, key=lambda k: len(held[k]))
                    yield flush(largest, held.pop(largest))
        for lang, words in held.items():
            if words:
                yield flush(lang, words)

    schema = "lang string, gram string, n bigint"
    return training.select("lang", "text").mapInPandas(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def string_counts(grams: DataFrame) -> dict[int, DataFrame]:
    """(lang, gram, n, discount) of every order: counts of the highest, continuation counts
    (in how many contexts a string occurs) of the others, over all strings of every language."""
    tables = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = materialize(tables[n + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(
            F.count(F.lit(1)).alias("n")), f"language_strings_{n}")
    ones, twos = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
    discount = F.when(ones > 0, ones / (ones + 2 * twos)).otherwise(0.5).alias("discount")
    return {n: t.join(F.broadcast(t.groupBy("lang").agg(discount)), "lang") for n, t in tables.items()}  # a row per language


def probabilities(tables: dict[int, DataFrame], alphabet: int, least: float | None = None) -> dict[int, DataFrame]:
    """``tables`` (from string_counts) with p, the back-off of the string's context, loss and kept.

    A string's loss is about what the cross-entropy of its language gains a character if
    the string is dropped.  Given ``least`` and tables with losses, strings of no more loss aren't
    kept: their discounted mass goes to the back-off of their context, which still sums to one."""
    done: dict[int, DataFrame] = {}
    for n in range(1, ORDER + 1):
        of = Window.partitionBy("lang", "context")
        rows = (tables[n].withColumn("kept", F.lit(True) if least is None else F.col("loss") > least)
                .withColumn("context", F.col("gram").substr(1, n - 1)).withColumn("rest", F.expr("substring(gram, 2)")))
        if n == 1:
            rows = rows.withColumn("below", F.lit(1 / alphabet))
        else:
            rows = rows.join(done[n - 1].select("lang", F.col("gram").alias("rest"), F.col("p").alias("below")), ["lang", "rest"])
        share = F.col("n") - F.col("discount")
        left = F.when(F.col("kept"), F.col("discount")).otherwise(F.col("n"))
        rows = rows.withColumn("total", F.sum("n").over(of)).withColumn("backoff", F.sum(left).over(of) / F.col("total"))
        p = F.when(F.col("kept"), share / F.col("total")).otherwise(0.0) + F.col("backoff") * F.col("below")
        rows = rows.withColumn("p", p)
        if least is None:
            all_n = tables[n].groupBy("lang").agg(F.sum("n").alias("all_n"))  # a row per language
            rows = rows.join(F.broadcast(all_n), "lang").withColumn(
                "loss", F.col("n") / F.col("all_n") * F.log(F.col("p") / (F.col("backoff") * F.col("below"))))
        done[n] = materialize(rows.select("lang", "gram", "n", "discount", "p", "backoff", "loss", "kept"), f"language_models_{n}")
    return done


def _collect(rows: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, hash, log) of ``rows`` (lang, gram, p); strings are hashed in tasks."""
    number = {k: i for i, k in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, grams, p = batch.columns
            yield pa.RecordBatch.from_pydict({
                "language": pa.array([number[k] for k in langs.to_pylist()], pa.int32()),
                "key": pa.array(hash_grams(grams.to_pylist()).view(np.int64)),
                "value": pa.array(np.log(p.to_numpy()).astype(np.float32))})

    got = rows.select("lang", "gram", "p").mapInArrow(run, "language int, key bigint, value float").toArrow()
    return got["language"].to_numpy(), got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()


class Learned(NamedTuple):
    """Finished models as tables: (lang, gram, p, backoff, kept) of each order, and each language's floor and strings."""
    languages: list[str]
    floors: dict
    strings: dict
    tables: dict[int, DataFrame]

    def groups(self, model_bytes: int) -> list[list[str]]:
        """The languages in order, as many together as ``model_bytes`` hold."""
        out: list[list[str]] = []
        size = 0
        for lang in self.languages:
            own = self.strings[lang] * GRAM_BYTES
            if not out or size + own > model_bytes:
                out.append([])
                size = 0
            out[-1].append(lang)
            size += own
        return out

    def models(self, languages: list[str]) -> CharacterModels:
        """The models of some of the languages, collected."""
        collected = []
        for n in range(1, ORDER + 1):
            kept = self.tables[n].filter(F.col("kept") & F.col("lang").isin(languages))
            contexts = kept.groupBy("lang", F.col("gram").substr(1, n - 1).alias("gram")).agg(F.first("backoff").alias("p"))
            # a string that has no entry takes the next order's value times its context's weight: 1 if that has none kept
            collected.append((_collect(kept, languages), _collect(contexts if n > 1 else contexts.limit(0), languages)))
        return CharacterModels.of_tables(languages, np.array([self.floors[k] for k in languages]), collected)


def learn(training: DataFrame, prune_to: int | None = None) -> Learned | None:
    """The models of ``training`` (lang, text); None if there is nothing to learn.  ``prune_to``: bytes to prune them to."""
    grams = materialize(gram_counts(training), "language_grams")
    languages = sorted(r["lang"] for r in grams.select("lang").distinct().collect())  # a row per language
    if not languages:
        return None
    tables = string_counts(grams)
    alphabet = tables[1].select("gram").distinct().count() + 1
    done = probabilities(tables, alphabet)
    if prune_to is not None:
        losses = functools.reduce(DataFrame.union, [t.select("loss") for t in done.values()])
        most = prune_to // GRAM_BYTES
        if (strings := losses.count()) > most:
            # the quantile may be off by a share of 1 / 10,000
            share = min(1.0, 1 - most / strings + 1e-4)
            least = losses.agg(F.percentile_approx("loss", share, 10_000)).first()[0]
            done = probabilities({n: t.drop("p", "backoff", "kept") for n, t in done.items()}, alphabet, least)
    floors = {r["lang"]: np.log(r["backoff"] / alphabet) for r in done[1].groupBy("lang").agg(F.first("backoff").alias("backoff")).collect()}
    kept = functools.reduce(DataFrame.union, [t.filter("kept").select("lang") for t in done.values()])
    strings = {r["lang"]: r["count"] for r in kept.groupBy("lang").count().collect()}  # a row per language
    return Learned(languages, floors, {k: strings.get(k, 0) for k in languages}, done)


def train(training: DataFrame, model_bytes: int | None = None) -> CharacterModels | None:
    """Models of all languages of ``training`` (lang, text); ``model_bytes``: size to prune them to."""
    learned = learn(training, model_bytes)
    return learned and learned.models(learned.languages)


def score_texts(docs: DataFrame, models: CharacterModels) -> DataFrame:
    """The columns of ``docs`` but text, chars and the log-probability of every text in each of the models' languages."""
    kept, at_text = [f for f in docs.schema.fields if f.name != "text"], docs.columns.index("text")
    places = [docs.columns.index(f.name) for f in kept]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["chars bigint", "logs array<double>"])
    names = [f.name for f in kept]
    shared, key = docs.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex
    step = min(500, max(10, 25_000 // len(models.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held_by_worker(("languages", key), lambda: TextScorer(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                totals, chars = scorer.score(part.column(at_text).to_pylist())
                yield pa.RecordBatch.from_pydict({
                    **{n: part.column(i) for n, i in zip(names, places, strict=True)}, "chars": pa.array(chars),
                    "logs": pa.array(list(totals), pa.list_(pa.float64()))})

    return docs.mapInArrow(run, schema)


def score_by_groups(docs: DataFrame, learned: Learned, model_bytes: int) -> DataFrame:
    """The same in all languages, one group of them after the other; between groups texts and scores are written."""
    groups = learned.groups(model_bytes)
    if len(groups) == 1:
        return score_texts(docs, learned.models(groups[0]))
    keyed = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "language_rows")
    parts = None
    for group in groups:
        logs = materialize(score_texts(keyed.select("row", "text"), learned.models(group)), "language_logs")
        parts = logs if parts is None else materialize(
            parts.withColumnRenamed("logs", "so_far").join(logs.drop("chars"), "row")
                 .select("row", "chars", F.concat("so_far", "logs").alias("logs")), "language_logs")
    return keyed.drop("text").join(parts, "row").drop("row")


def with_limits(scored: DataFrame, calibration: DataFrame) -> DataFrame:
    """``scored`` (best, chars) with the cross-entropy from which on a text is rejected, from
    the calibration rows (best, chars, cross_entropy) whose language was found."""
    infinite = F.lit(float("inf"))
    centres = calibration.groupBy("best").agg(F.percentile_approx("cross_entropy", 0.5, 10_000).alias("centre"))
    centres = {r["best"]: r["centre"] for r in centres.collect()}  # a row per language
    rows = calibration.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("cross_entropy", 0.5, 10_000).alias("centre")).first()
    if rows["n"] < LEAST_ROWS:
        return scored.withColumn("limit", infinite)
    spark = scored.sparkSession
    centres = F.broadcast(spark.createDataFrame(list(centres.items()), "of string, centre double"))
    own = calibration.join(centres, F.col("best") == F.col("of")).withColumn("deviation", F.col("cross_entropy") - F.col("centre"))
    own = own.withColumn("square", F.col("deviation") * F.col("deviation"))
    half, most = own.agg(F.percentile_approx("square", F.array(F.lit(0.5), F.lit(TRIM)), 10_000)).first()[0]
    square, inverse = F.least(F.col("square"), F.lit(most)), 1 / F.col("chars")
    fit = own.agg(F.regr_slope(square, inverse).alias("b"), F.regr_intercept(square, inverse).alias("a"), F.avg(square).alias("all")).first()
    a, b = (fit["a"], fit["b"]) if (fit["b"] or 0.0) > 0 else (fit["all"], 0.0)
    spread = F.sqrt(F.lit(max(a, half, 1e-6)) + F.lit(b) * inverse)
    own = own.withColumn("z", F.col("deviation") / spread)
    tail, quantile = own.agg(F.percentile_approx("z", F.array(F.lit(TAIL), F.lit(QUANTILE)), 10_000)).first()[0]
    if rows["n"] >= 1 / (1 - QUANTILE) and tail > 0:
        slope = own.filter(F.col("z") > tail).agg(F.avg(F.log(F.col("z") / tail))).first()[0] or 0.0
        quantile = tail * ((1 - TAIL) / (1 - QUANTILE)) ** slope
    out = scored.join(centres, F.col("best") == F.col("of"), "left")
    return out.withColumn("limit", F.coalesce("centre", F.lit(rows["centre"])) + F.lit(quantile) * spread).drop("of", "centre")


def identify_languages(docs: DataFrame, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy and text digest of every row
    of ``docs`` (doc_id, text, lang); the docstring above says how."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.xxhash64("text").alias("digest"), "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    learned = learn(rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & remainder.isin(0, 1)))
    if learned is None:
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"),
                           F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"), "digest")
    names = F.array(*map(F.lit, learned.languages))
    scored = score_by_groups(rows, learned, model_bytes)
    best = F.array_max("logs")
    scored = materialize(scored.select(
        "doc_id", "lang", "digest", "chars", "logs", F.when(F.col("chars") > 0, F.element_at(names, F.array_position("logs", best).cast("int")))
        .alias("best"), F.when(F.col("chars") > 0, -best / F.col("chars")).alias("cross_entropy")), "language_scores")

    def posterior(of, temperature):
        """Chance of the language whose log-probability is ``of``."""
        return 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(F.least((x - of) / temperature, F.lit(700.0))))

    calibration = scored.filter((remainder == 3) & F.col("lang").isin(learned.languages) & (F.col("chars") > 0))
    truth = F.element_at("logs", F.array_position(names, F.col("lang")).cast("int"))
    losses = [F.avg(-F.log(F.greatest(posterior(truth, t), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    found = calibration.agg(*losses).first()
    temperature = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda i: (found[i] or 0.0, i))]
    scored = with_limits(scored, calibration.filter("best = lang"))
    known = F.col("chars") > 0
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(known, F.col("best")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, posterior(best, temperature)).otherwise(0.0).alias("score"),
        F.when(known, F.col("cross_entropy") > F.col("limit")).otherwise(True).alias("rejected"), "cross_entropy", "digest")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language is rejected, all columns kept; of texts that
    share a doc_id, or have none, each is judged for itself."""
    key = F.struct(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("digest"))
    kept = (identify_languages(docs).filter("NOT rejected")
            .select(F.struct(F.col("doc_id").alias("id"), "digest").alias("__key")).distinct())
    return docs.withColumn("__key", key).join(kept, "__key", "left_semi").select(*docs.columns)
