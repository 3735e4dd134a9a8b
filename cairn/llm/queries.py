"""The registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

from cairn.llm.bpe_automaton import encode_texts
from cairn.llm.chat_format import conversation_digests, format_conversations
from cairn.llm.exact_dedup import exact_duplicates
from cairn.llm.common import materialize
from cairn.llm.hard_negatives import hard_negatives, usable_rows
from cairn.llm.jaccard_join import jaccard_links
from cairn.llm.language_id import identify_languages
from cairn.llm.lexical_search import build_signatures, search
from cairn.llm.mixing import draw_mix
from cairn.llm.pii import find_personal_data
from cairn.llm.quality_rules import apply_rules
from cairn.llm.record_files import record_digests
from cairn.llm.rule_ensemble import classify
from cairn.llm.token_counts import token_counts
from cairn.plans import query_registry
from cairn.session import shared_dir
from cairn.sources.tables import read_table

QUERIES, ORACLE, register = query_registry()


def _texts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


@register("op1_risk_controlled_rules")
def op1(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return apply_rules(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


@register("op2_bayes_jaccard_join")
def op2(spark, sf_dir):
    return jaccard_links(_texts(spark, sf_dir))


@register("op3_kneser_ney_language")
def op3(spark, sf_dir):
    return identify_languages(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@register("op4_sparse_rule_ensemble")
def op4(spark, sf_dir):
    return classify(_texts(spark, sf_dir), read_table(spark, sf_dir, "labels", "doc_id", "quality"))


@register("op5_hypergeometric_mix")
def op5(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return draw_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "draws")


@register("op6_digest_cache_counts")
def op6(spark, sf_dir):
    # one cache for each corpus folder, shared by all runs on it
    corpus = hashlib.sha256(sf_dir.encode()).hexdigest()[:24]
    cache = f"{shared_dir(spark).rstrip('/')}/token_cache/{corpus}"
    return token_counts(_texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), cache)


@register("op7_quotient_filter_dedup", """
    WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM t WINDOW g AS (PARTITION BY text_sha256)""")
def op7(spark, sf_dir):
    return exact_duplicates(_texts(spark, sf_dir))


@register("op8_disclosure_pii")
def op8(spark, sf_dir):
    return find_personal_data(_texts(spark, sf_dir)).drop("digest", "terms")


@register("op9_automaton_bpe")
def op9(spark, sf_dir):
    return encode_texts(_texts(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@register("op10_record_files")
def op10(spark, sf_dir):
    return record_digests(_texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


# The turns of conversation -1, whose texts hold control strings of chat formats.
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@register("op11_state_machine_chat", """
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, regexp_replace(replace(text, chr(92), chr(92) || chr(92)),
                      '(<|\\[)(s>|/s>|\\|(?:system|user|assistant|role|text|end|endoftext)\\|>|/?INST\\])', '\\1' || chr(92) || chr(92) || '\\2', 'g') AS x FROM t)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(7 + sum(length(x) + 7 + CASE role WHEN 'system' THEN 10 WHEN 'user' THEN 8 WHEN 'assistant' THEN 13 ELSE 16 + length(role) END) AS BIGINT)
        AS formatted_chars
    FROM e GROUP BY conv_id""")
def op11(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id bigint, turn bigint, role string, text string")
    formatted = materialize(format_conversations(turns.unionByName(planted)), "chat")
    return conversation_digests(formatted)


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@register("op12_bit_sliced_search", f"""
    WITH d AS (SELECT *, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL) WHERE len(t) > 0),
    c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
    p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
          FROM (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term), c),
    s AS (SELECT item_id, doc_id,
                 CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""")
def op12(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return search(read_table(spark, sf_dir, "benchmark", "item_id", "text"), docs, build_signatures(docs))


@register("op13_anchor_cluster_negatives", """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
          FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                 row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
    g AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score
            AND 100 * s.score <= 95 * positive_score WHERE n <= 5)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 3""")
def op13(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable_rows(vectors, "vec_id", "embedding", label), F.col("vec_id") % 50 == 0)


def queries():
    from cairn.plans.catalog import _shipped

    return {name: _shipped(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(ORACLE)
