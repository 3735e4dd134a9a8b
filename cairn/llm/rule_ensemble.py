"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees of a random forest are grown on the statistics of the labelled
training documents; every path from a root to a node is a conjunction of
thresholds, a rule (Friedman and Popescu, "Predictive learning via rule
ensembles").  The rules become 0/1 features of a lasso logistic regression, which
keeps few of them, and the model is compiled into one Spark column expression:
scoring is a scan with built-in functions and no model file.

Trees and regression are fitted by Spark's own learners on all labelled rows
with crc32(doc_id) mod 4 other than 2, numbers only; what reaches the driver is the trees
and one weight per rule.

Defined cases: null and empty texts are scored by their statistics, which are 0; a
document with several labels counts once, as good if all say 1; null labels and
null doc_ids aren't learned from; with labels of one kind only, or none, the score is
the share of good labels (0.5 for none); repeated rows each give a row; an empty table gives
an empty result; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import held_out, materialize
from cairn.llm.textstats import RATIOS, with_counts, with_ratios

FEATURES = (*RATIOS, "mean_word", "log_words", "words_per_line")
TREES = 24
DEPTH = 3
LASSO = 0.002
THRESHOLD = 0.7
TASKS = 16
SEED = 11

Rule = tuple[tuple[str, bool, float], ...]  # (feature, whether above, threshold) of each condition


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the FEATURES of every text."""
    counted = with_ratios(with_counts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")))
    return counted.select("doc_id", *RATIOS, F.least(F.col("mean_word"), F.lit(100.0)).alias("mean_word"),
                          F.log1p("n_words").alias("log_words"),
                          F.log1p(F.col("n_words") / F.greatest("n_lines", F.lit(1))).alias("words_per_line"))


def paths(tree: str, features: tuple[str, ...] = FEATURES) -> set[Rule]:
    """The conjunctions of a tree's printed form, one for each node below the root."""
    found: set[Rule] = set()
    open_conditions: list[tuple[int, tuple[str, bool, float]]] = []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        indent = len(m[1])
        while open_conditions and open_conditions[-1][0] >= indent:
            open_conditions.pop()
        open_conditions.append((indent, (features[int(m[2])], m[3] == ">", float(m[4]))))
        bounds: dict[tuple[str, bool], float] = {}  # the tighter of two bounds on the same side
        for _, (name, above, at) in open_conditions:
            held = bounds.get((name, above))
            bounds[name, above] = at if held is None else max(held, at) if above else min(held, at)
        found.add(tuple(sorted((name, above, at) for (name, above), at in bounds.items())))
    return found


def rule_column(rule: Rule) -> Column:
    holds = F.lit(True)
    for name, above, at in rule:
        holds = holds & (F.col(name) > at if above else F.col(name) <= at)
    return holds


def fit(training: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from rows with the FEATURES and ``good`` (0.0 or 1.0)."""
    # a fixed order in a fixed number of tasks, so that the trees' samples are reproducible
    rows = training.repartition(TASKS, "doc_id").sortWithinPartitions("doc_id", *FEATURES)
    gathered = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="good", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(gathered)
    rules = sorted(set().union(*[paths(t.toDebugString) for t in forest.trees]))
    if not rules:
        return float("nan"), []
    fired = rows.select("good", *[rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="fired").transform(fired)
    model = LogisticRegression(featuresCol="fired", labelCol="good", elasticNetParam=1.0, regParam=LASSO,
                               standardization=False, maxIter=60).fit(fired.select("good", "fired"))
    return model.intercept, [(r, float(w)) for r, w in zip(rules, model.coefficients, strict=True) if w]


def score_column(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The model as an expression over the FEATURES."""
    total = F.lit(float(intercept))
    for rule, weight in rules:
        total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    stats = materialize(statistics(docs), "quality_statistics")
    marks = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("double").alias("good")))
    training = materialize(stats.join(marks, "doc_id").filter(~held_out(F.col("doc_id"))), "quality_training")
    seen = {r["good"]: r["count"] for r in training.groupBy("good").count().collect()}  # one or two rows
    if len(seen) > 1:
        intercept, rules = fit(training)
        score = score_column(intercept, rules) if rules else F.lit(seen.get(1.0, 0) / sum(seen.values()))
    else:
        score = F.lit(float(next(iter(seen))) if seen else 0.5)
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).select(
        "*", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
