"""Every registered query of the subpackage on the smallest tables: columns of its contract, a row for each input row, and SQL where there is any."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import heddle.llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CONTRACT = {
    "op1_suffix_dedup": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}),
    "op2_subword_lattice": ("documents", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}),
    "op3_site_style_tree": ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    "op4_reply_trees": (None, {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}),
    "op5_minhash": ("documents", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}),
    "op6_best_fit": (None, {"doc_id": "bigint"}),
    "op7_merge_dropout": ("documents", {"doc_id": "bigint"}),
    "op8_simhash": ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    "op9_transport_streams": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}),
    "op11_pcy_phrases": (None, {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}),
    "op12_ranked_search": (None, {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}),
    "op13_banded_minhash": ("documents", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}),
    "op10_nnpu_toxicity": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
}


def test_all_are_registered():
    names = entry.queries().keys()
    assert {f"op{n}_" for n in range(1, 14)} <= {k.split("_")[0] + "_" for k in names} and "pipeline" in names
    assert CONTRACT.keys() == heddle.llm.queries().keys()


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, name):
    table, columns = CONTRACT[name]
    df = heddle.llm.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    n = df.count()
    assert n > 0 and (table is None or n == spark.read.parquet(f"{SF}/{table}.parquet").count())


@pytest.mark.parametrize("name", sorted(heddle.llm.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = heddle.llm.queries()[name](spark, SF)
    sql = con.sql(heddle.llm.oracle_sql()[name])
    at = [sql.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in sql.fetchall())
