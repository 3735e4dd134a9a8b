"""Rule ensemble: the compiled column, the rules and the lasso weights against independent evaluations."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cairn.llm import rule_ensemble as E
from cairn.llm.common import held_out, materialize


@pytest.fixture(scope="module")
def training(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    marks = labels.groupBy("doc_id").agg(F.min("quality").cast("double").alias("good"))
    return materialize(E.statistics(docs).join(marks, "doc_id").filter(~held_out(F.col("doc_id"))), "rule_training")


@pytest.fixture(scope="module")
def fitted(training):
    return E.fit(training)


def holds(rule, row):
    return all(row[name] > at if above else row[name] <= at for name, above, at in rule)


def margin(intercept, rules, row):
    return intercept + sum(w for rule, w in rules if holds(rule, row))


def test_compiled_column_equals_rule_by_rule_evaluation(training, fitted):
    intercept, rules = fitted
    assert rules
    rows = training.select("*", E.score_column(intercept, rules).alias("score")).collect()
    assert rows
    for row in rows:
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-margin(intercept, rules, row))), abs=1e-12)


def test_rows_on_a_threshold_fall_on_the_same_side(spark, fitted):
    intercept, rules = fitted
    base = dict.fromkeys(E.FEATURES, 0.0)
    edges = [base | {name: v} for name, _, at in {c for rule, _ in rules for c in rule}
             for v in (at, math.nextafter(at, math.inf), math.nextafter(at, -math.inf))]
    df = spark.createDataFrame([tuple(e[n] for n in E.FEATURES) for e in edges], ", ".join(f"{n} double" for n in E.FEATURES))
    for row in df.select("*", E.score_column(intercept, rules).alias("score")).collect():
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-margin(intercept, rules, row))), abs=1e-12)


def test_weights_meet_the_lasso_conditions(training, fitted):
    """At the minimum the mean log-loss has a slope of -LASSO * sign(w) along each kept rule, and none along the intercept."""
    intercept, rules = fitted
    rows = training.collect()
    fired = np.array([[holds(rule, r) for rule, _ in rules] for r in rows], float)
    good = np.array([r["good"] for r in rows])
    weights = np.array([w for _, w in rules])
    error = 1 / (1 + np.exp(-(intercept + fired @ weights))) - good
    assert abs(error.mean()) < 1e-3
    slopes = fired.T @ error / len(rows)
    assert np.abs(slopes + E.LASSO * np.sign(weights)).max() < E.LASSO / 2


def test_paths_are_the_nodes_of_the_trees(training):
    data = VectorAssembler(inputCols=list(E.FEATURES), outputCol="features").transform(training)
    forest = RandomForestClassifier(labelCol="good", numTrees=6, maxDepth=3, seed=5, maxBins=64).fit(data)

    def walk(node, conditions):
        if conditions:
            tight = {}
            for name, above, at in conditions:
                tight.setdefault((name, above), []).append(at)
            found.add(tuple(sorted((n, a, max(v) if a else min(v)) for (n, a), v in tight.items())))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, at = E.FEATURES[split.featureIndex()], split.threshold()
            walk(node.leftChild(), [*conditions, (name, False, at)])
            walk(node.rightChild(), [*conditions, (name, True, at)])

    for tree in forest.trees:
        found = set()
        walk(tree._java_obj.rootNode(), [])
        assert E.paths(tree.toDebugString) == found
