"""The corpus pipeline: five training-data operators, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers

from cairn.llm.bpe_automaton import encode_texts
from cairn.llm.exact_dedup import drop_exact_duplicates
from cairn.llm.jaccard_join import drop_near_duplicates
from cairn.llm.language_id import drop_rejected
from cairn.llm.mixing import take_mix
from cairn.session import fresh_path, ship_package
from cairn.sources.tables import read_table

ORACLE_SQL = None  # trained models and hashed permutations aren't expressible in SQL; see tests/llm


def language_id(spark, docs, sf_dir):
    """Documents whose language is rejected go (no letters, or like no language learned from ``docs``)."""
    ship_package(spark)
    return drop_rejected(docs)


def exact_dedup(spark, docs, sf_dir):
    """One document of each group of equal texts stays (the largest doc_id)."""
    ship_package(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of linked documents stays (the least doc_id)."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them, shard by shard in a shuffled order."""
    ship_package(spark)
    return take_mix(docs)


def bpe_encode(spark, docs, sf_dir):
    """Every row's ids: their count, and digests of ids and decoded text."""
    ship_package(spark)
    return encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    ship_package(spark)
    rows = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline_{name}")
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
