"""Conversation summaries kept up to date by the turns that arrive.

A sentence's score in ``operators.summarize`` is ``sum(n * tf) / sum(n)`` over its terms, and
its numerator is linear in the conversation's term counts.  So each micro-batch splits and
counts its own turns only, and writes under its id

* ``sentences``  (unit, s_ord, sentence),
* ``terms``      (unit, s_ord, term, n),
* ``counts``     (unit, term, tf): what the batch adds to the conversation's counts,
* ``points``     (unit, s_ord, points, tokens): what it adds to numerators and denominators, those
  of earlier sentences that share a term with the new turns included.

Counts and points merge by adding, in whole numbers, so the summary after every batch equals
the one computed from all turns so far, in whatever order they came.  Earlier texts are never split again: a
batch meets earlier turns through their term rows alone.  A batch reads earlier batches and overwrites
its own folders, so a replayed batch writes the same.

Defined cases: null and blank texts have no sentence; a unit whose sentences hold no term has an empty
summary; rows that repeat a turn count together, in one batch or in several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import summarize as SM
from cairn.session import written


def _part(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """One kind of rows of all batches, with their ``batch_id``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{kind}")


def summary_batch(root: str, unit: str = "conv_id", text: str = "text", part: str = "turn"):
    """foreachBatch function: add the batch's turns to the tables below ``root``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def put(rows: DataFrame, kind: str) -> DataFrame:
            path = f"{root.rstrip('/')}/{kind}/batch_id={batch_id}"
            rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        def earlier(kind: str) -> DataFrame:
            return _part(spark, root, kind).filter(F.col("batch_id") < batch_id).drop("batch_id")

        sents = put(SM.split_sentences(batch, unit, text, part), "sentences")
        held = put(sents.select(unit, "s_ord", F.explode(T.tokens("sentence")).alias("term"))
                        .groupBy(unit, "s_ord", "term").agg(F.count(F.lit(1)).alias("n")), "terms")
        added = put(held.groupBy(unit, "term").agg(F.sum("n").alias("tf")), "counts")
        # written tables on both sides, so that the joins split a hot conversation's common terms
        before = earlier("counts").join(added.select(unit, "term"), [unit, "term"], "left_semi")
        so_far = written(added.unionByName(before).groupBy(unit, "term").agg(F.sum("tf").alias("tf")), "batch_terms")
        own = held.join(so_far, [unit, "term"]).select(unit, "s_ord", (F.col("n") * F.col("tf")).alias("points"), F.col("n").alias("tokens"))
        moved = earlier("terms").join(added, [unit, "term"]).select(
            unit, "s_ord", (F.col("n") * F.col("tf")).alias("points"), F.lit(0).cast("bigint").alias("tokens"))
        put(own.unionByName(moved).groupBy(unit, "s_ord").agg(F.sum("points").alias("points"), F.sum("tokens").alias("tokens")), "points")
    return run


def read_summaries(spark: SparkSession, root: str, n: int = 3, unit: str = "conv_id",
                   until_batch: int | None = None) -> DataFrame:
    """(unit, summary, n_sentences) of every conversation, now or as it was after ``until_batch``."""
    def rows(kind: str) -> DataFrame:
        found = _part(spark, root, kind)
        return (found if until_batch is None else found.filter(F.col("batch_id") <= until_batch)).drop("batch_id")

    scored = rows("points").groupBy(unit, "s_ord").agg((F.sum("points") / F.sum("tokens")).alias("score"))
    return SM.best_sentences(scored, rows("sentences"), unit, n)
