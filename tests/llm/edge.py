"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept boolean, "
          "score double, row string, sha string, fp string, words string, size string, block string, digest string, terms string")
LONG = " ".join(random.Random(7).choice(["alpha", "beta", "gamma", "delta", "omega", "kappa"]) + str(i % 97) for i in range(30_000))


def rows():
    texts = [(1, "The quick brown fox jumps over the lazy dog and runs away again", "en", "a"),
             (2, "the QUICK brown fox jumps over the lazy dog and runs away again", "en", "a"),
             (2, "the QUICK brown fox jumps over the lazy dog and runs away again", "en", "a"),  # repeated row
             (3, None, None, None), (4, "", "en", "b"), (5, " \t\n\x0b ", "fr", None), (6, LONG, "en", "b"),
             (7, LONG + " tail", None, "c"), (None, "no id here but words enough for one shingle or more", "en", "c"),
             (None, None, None, None), (8, "12345 67890 !!! ###", "de", "a"), (9, "one two three", "en", "a"),
             (10, "one two three", "en", "b"), (11, "x" * 50_000, "de", "c"), (12, "é ü ñ <|endoftext|> 日本語 \xa0 😀", "es", "c")]
    return [(i, t, lang, s, len(t or ""), -1, False, -1.0, "r", "s", "f", "w", "z", "b", "d", "t") for i, t, lang, s in texts]


def frame(spark, own=None):
    return spark.createDataFrame(rows() if own is None else own, SCHEMA)


def documents(spark, pairs, lang="en", source="a"):
    return spark.createDataFrame([(i, t, lang, source) for i, t in pairs], "doc_id bigint, text string, lang string, source string")
