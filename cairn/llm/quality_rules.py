"""Quality rules whose cutoffs are risk-controlled on labelled documents.

A rule rejects a document whose statistic exceeds its cutoff.  Cutoffs come from
a fixed grid and are chosen for each stratum (language) by tests on the labelled
documents of that stratum: a cutoff is admissible if the exact binomial bound
says that it rejects at most ``limit / rules`` of the good documents, that is
if P(Bin(n, limit / rules) <= k) <= confidence / (rules * strata) for k of n
good documents rejected (Clopper and Pearson's upper bound).  The rules share the
limit (union bound), rules and strata share the error of confidence (Bonferroni), and
the cutoffs of one rule are tested from the loosest on, in fixed sequence, up to the
first that fails, which needs no further correction.  Of the admissible cutoffs the
one is taken that separates the labels best (share of bad documents rejected less
``GOOD_COST`` times the share of good ones), the loosest if several do; a rule that doesn't separate, or a
stratum with too few labels to bound anything, gets none.

Everything is DataFrame functions.  All labelled documents take part.  Counts per
stratum, rule and grid step are partial sums before the shuffle; the table of
cutoffs has a row per stratum and is joined as a written table, which Spark
broadcasts if its size allows.

Defined cases: a null text has no words and fails the base rule; a null stratum is a
stratum of its own; a document with several labels is good if all say 1, and null
labels are ignored; repeated rows each give a row, and a label of a repeated doc_id
counts for each; empty documents give an empty result, empty labels no cutoffs;
only doc_id, text and the stratum are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize
from cairn.llm.textstats import RATIOS, with_counts, with_ratios, with_repeated_words

GRID = 50  # cutoffs are multiples of 1 / GRID
LIMIT = 0.03  # of the good documents of a stratum, over all rules
ERROR = 0.05  # chance that any stratum's limit is exceeded
GOOD_COST = 10.0
RULES = (*RATIOS, "repeat_window_ratio")

# Fixed values of the base rule.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def statistics(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum, the base counts and the RULES' statistics of every text."""
    counted = with_counts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(stratum).alias("stratum"), "text"))
    return (with_ratios(with_repeated_words(counted))
            .withColumn("repeat_window_ratio", F.when(F.col("n_words") > 0, F.col("n_repeat_words") / F.col("n_words")).otherwise(0.0))
            .select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES))


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms."""
    def step(acc: Column, i: Column) -> Column:
        return F.struct((acc["log"] + F.log((n - i) / (i + 1.0)) + F.log(p / (1 - p))).alias("log"),
                        (acc["sum"] + F.exp(acc["log"])).alias("sum"))
    zero = F.struct((n * F.log(1 - p)).alias("log"), F.lit(0.0).alias("sum"))
    return F.when(k >= n, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), zero, step)["sum"])


def within_limit(n: Column, k: Column, p: Column, error: Column) -> Column:
    """Whether k of n leaves at most p with the given error; sums only where bounds don't decide."""
    share = k / F.greatest(n, F.lit(1))
    distance = (F.when(k > 0, share * F.log(share / p)).otherwise(0.0) + (1 - share) * F.log((1 - share) / (1 - p)))
    return (F.when((n == 0) | (share >= p), False)
            .when(n * distance > -F.log(error), True)  # Chernoff's bound is above the tail
            .otherwise(binomial_tail(n, k, p) <= error))


def cutoffs(stats: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff, good, good_rejected, bad, bad_rejected): one row per stratum and
    rule that got a cutoff."""
    marks = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality")))
    labelled = stats.join(marks, "doc_id").withColumn("good", (F.col("quality") == 1).cast("int"))
    # a statistic x exceeds the cutoffs 0, 1/GRID, ... (level - 1)/GRID
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), F.least(F.lit(GRID), F.ceil(F.col(r) * GRID)).cast("int").alias("level")) for r in RULES])
    counts = (labelled.select("stratum", "good", F.explode(levels).alias("x"))
              .groupBy("stratum", "x.rule", "x.level").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    counts = materialize(counts, "rule_counts")  # at most GRID + 1 rows for each stratum and rule
    strata = counts.select("stratum").distinct().count()
    grid = counts.select("stratum", "rule").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum", "rule")
    # cutoff step j rejects the levels above j
    both = (counts.select("stratum", "rule", F.col("level").alias("at"), "good", "bad", F.lit(False).alias("cut"))
            .unionByName(grid.select("stratum", "rule", F.col("step").alias("at"), F.lit(0).alias("good"), F.lit(0).alias("bad"),
                                     F.lit(True).alias("cut")))
            .groupBy("stratum", "rule", "at").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("cut").alias("cut")))
    tested = (both.withColumn("good", F.sum("g").over(whole)).withColumn("bad", F.sum("b").over(whole))
              .withColumn("good_rejected", F.coalesce(F.sum("g").over(above), F.lit(0)))
              .withColumn("bad_rejected", F.coalesce(F.sum("b").over(above), F.lit(0)))
              .filter("cut")
              .withColumn("passes", within_limit(F.col("good"), F.col("good_rejected"), F.lit(limit / len(RULES)),
                                                 F.lit(error / (len(RULES) * max(1, strata))))))
    looser = Window.partitionBy("stratum", "rule").orderBy(F.desc("at"))
    gain = F.col("bad_rejected") / F.greatest("bad", F.lit(1)) - GOOD_COST * F.col("good_rejected") / F.greatest("good", F.lit(1))
    return (tested.withColumn("all_pass", F.min("passes").over(looser)).filter("all_pass").withColumn("gain", gain)
            .groupBy("stratum", "rule").agg(F.max(F.struct("gain", "at", "good", "good_rejected", "bad", "bad_rejected")).alias("x"))
            .filter("x.gain > 0")
            .select("stratum", "rule", (F.col("x.at") / GRID).alias("cutoff"), "x.good", "x.good_rejected", "x.bad", "x.bad_rejected"))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and failed_rules of every row of ``docs``
    (doc_id, text and the stratum)."""
    stats = materialize(statistics(docs, stratum), "rule_statistics")
    chosen = cutoffs(stats, labels, limit, error).groupBy(F.col("stratum").alias("of")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # at most a cutoff a rule
    chosen = materialize(chosen, "rule_cutoffs")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col("cutoffs")[r], r) for r in RULES]), lambda r: r.isNotNull())
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (stats.join(chosen, F.col("stratum").eqNullSafe(F.col("of")), "left")
            .withColumn("base_failed", base).withColumn("failed_rules", failed)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules"))
