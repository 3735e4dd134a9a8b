"""The registered queries: their columns, types and rows on the smallest tables."""

import pytest

import __spark_entry__ as E
from cairn.llm import queries as Q

CONTRACT = {
    "op1": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
            "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op2": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op8": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
            "base_sha256": "string", "spans": "string"},
    "op9": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op11": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string",
             "formatted_chars": "bigint"},
    "op12": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint",
             "negative_score": "bigint"},
}


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = E.queries()
    assert {n.split("_")[0] for n in Q.QUERIES} == set(CONTRACT) and set(Q.QUERIES) <= set(names) and "pipeline" in names
    assert set(Q.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_contract(spark, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    kinds = dict(df.dtypes)
    wanted = CONTRACT[name.split("_")[0]]
    assert {c: kinds.get(c) for c in wanted} == wanted
    rows = df.select(*wanted).collect()
    assert not any(v is None for r in rows for v in r)
    if name.startswith("op11"):
        assert len(rows) == 1 + spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id").distinct().count()
    if name.startswith(("op11", "op12", "op13")):
        return
    docs = [r["doc_id"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
