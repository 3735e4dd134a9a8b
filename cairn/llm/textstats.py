"""Statistics of whole texts, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE

# The characters counted as symbols, and ASCII punctuation.
SYMBOLS = r"[#*$%&|<>]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
BLANK = r"[\x20\x09-\x0D]"
WINDOW = 5

# Statistics between 0 and 1 that rules and trees look at.
RATIOS = ("symbol_ratio", "punctuation_ratio", "upper_ratio", "digit_ratio", "dup_line_ratio", "repeated_word_ratio")


def _count(text: Column, pattern: str) -> Column:
    """Code points of the text that a one-character pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def _per(count: Column, of: str) -> Column:
    return F.when(F.col(of) > 0, F.least(F.lit(1.0), count / F.col(of))).otherwise(0.0)


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with text never null, its words, lines that have a word, and counts of both."""
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{BLANK[1:]}"))
    return (docs.withColumn("text", F.coalesce("text", F.lit("")))
                .withColumn("words", F.array_remove(F.split("text", SPACE), ""))
                .withColumn("lines", lines)
                .withColumn("n_words", F.size("words").cast("bigint"))
                .withColumn("word_chars", F.length(F.regexp_replace("text", BLANK, "")).cast("bigint"))
                .withColumn("n_symbols", _count(F.col("text"), SYMBOLS))
                .withColumn("n_lines", F.size("lines").cast("bigint"))
                .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")))


def with_ratios(counted: DataFrame) -> DataFrame:
    """The output of ``with_counts`` with the RATIOS and the mean word length."""
    return (counted.withColumn("n_distinct", F.size(F.array_distinct("words")))
            .withColumn("symbol_ratio", _per(F.col("n_symbols"), "word_chars"))
            .withColumn("punctuation_ratio", _per(_count(F.col("text"), PUNCTUATION), "word_chars"))
            .withColumn("upper_ratio", _per(_count(F.col("text"), r"\p{Lu}"), "word_chars"))
            .withColumn("digit_ratio", _per(_count(F.col("text"), "[0-9]"), "word_chars"))
            .withColumn("dup_line_ratio", _per(F.col("n_dup_lines"), "n_lines"))
            .withColumn("repeated_word_ratio", _per(F.col("n_words") - F.col("n_distinct"), "n_words"))
            .withColumn("mean_word", F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(0.0)))


def with_repeated_words(counted: DataFrame) -> DataFrame:
    """The output of ``with_counts`` with n_repeat_words: words inside five-word windows
    that the text has twice or more.

    Windows become hashes whose low bits are replaced by the window's position, so one
    sort of longs brings equal windows together in order of position; neighbours with
    equal hashes are compared by their words.
    """
    mask = (F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_words") + 1.0))) - 1).cast("bigint")

    def window(w: Column, i: Column) -> Column:
        h = F.xxhash64(w, *[F.get("words", i + k) for k in range(1, WINDOW)])
        return h.bitwiseAND(F.bitwise_not(F.col("mask"))).bitwiseOR(i.cast("bigint"))

    def position(x: Column) -> Column:
        return x.bitwiseAND(F.col("mask"))

    def same(x: Column, other: Column) -> Column:
        at = [F.slice("words", (position(v) + 1).cast("int"), F.lit(WINDOW)) for v in (x, other)]
        return F.coalesce((x - position(x) == other - position(other)) & (at[0] == at[1]), F.lit(False))

    def cover(acc: Column, p: Column) -> Column:
        return F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"))

    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    return (counted.withColumn("mask", mask)
            .withColumn("windows", F.when(F.col("n_words") > WINDOW, F.transform(
                F.slice("words", F.lit(1), F.greatest(F.lit(0), F.col("n_words") - WINDOW + 1).cast("int")), window))
                .otherwise(F.array().cast("array<bigint>")))
            .withColumn("windows", F.sort_array("windows"))
            .withColumn("again", F.filter("windows", lambda x, k: same(x, F.get("windows", k + 1)) | same(x, F.get("windows", k - 1))))
            .withColumn("again", F.sort_array(F.transform("again", position)))
            .withColumn("n_repeat_words", F.when(F.size("again") > 0, F.aggregate("again", start, cover)["n"]).otherwise(0).cast("bigint"))
            .drop("mask", "windows", "again"))
