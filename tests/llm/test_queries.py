"""The queries over the smallest of the given tables: contract columns and, where there is one, SQL."""

import hashlib
import os
import zlib

import pytest

from panelwright.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")

COLUMNS = {
    "op1_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op2_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_language_id": "doc_id held_out lang_pred score",
    "op5_packing": "doc_ids cu_seqlens position_resets input_ids",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8_topk": "query_id rank vec_id score",
    "op9_passage_dedup": "doc_id n_spans kept_docs spans",
    "op10_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11_kmeans": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op12_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_token_counts": "doc_id n_bytes n_tokens over_limit",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if "doc_id" in got.columns:
        assert got.count() == n


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def test_control_strings_in_texts(spark):
    row = queries.op2_chat_format(spark, SF).filter("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_held_out_rows(spark):
    for name, n in (("op4_language_id", 4), ("op10_lm_scoring", 7)):
        for r in queries.QUERIES[name](spark, SF).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == 2)
